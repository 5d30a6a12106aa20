"""Embedding near-dedup by Euclidean p-stable hashing and exact cosine checks.

Unit vectors at cosine c are sqrt(2 - 2c) apart.  A table hashes a vector to the tuple of
floor((a_i . x + b_i) / WIDTH) over PROJECTIONS Gaussian a_i.  With the values below two vectors
at cosine 0.9 meet in one of the tables with probability 0.99, at 0.95 with 0.9998.  Vectors that
share a bucket are compared exactly, in double precision, in blocks of matrix products.

Equal vectors are collapsed first into classes, numbered in a written table.  Buckets are dealt into
cells of bounded size (``cells``).  A cell emits counts and a spanning forest of its links, never the
pairs; a pair counts in the first table in which it meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .cells import BLOCK, deal, whole_cells
from .common import materialize, read
from .components import connected_components

TABLES, PROJECTIONS, WIDTH, SEED = 20, 8, 2.0, 42
MIN_COSINE = 0.9


def projections(dim: int):
    import numpy as np

    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def table_keys(unit):
    """(n, dim) unit vectors -> (n, TABLES) int32: each table's bucket, hashed."""
    import numpy as np

    a, b = projections(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    key = np.zeros(cells.shape[:2], np.uint64)
    for i in range(PROJECTIONS):
        key = (key ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _usable(column):
    """Arrow list column -> [(rows, (n, dim) doubles)] by width, without vectors that link with
    nothing."""
    import numpy as np

    by_dim: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(column):
        v = v.values
        if v is None or v.null_count or not len(v):
            continue
        x = v.to_numpy(zero_copy_only=False)
        if np.isfinite(x).all() and x.any():
            rows, vs = by_dim.setdefault(len(x), ([], []))
            rows.append(i)
            vs.append(x)
    return [(rows, np.array(vs, np.float64)) for rows, vs in by_dim.values()]


def scaled(x):
    """Rows times powers of two, exactly, so that their largest components are near 1 and no square or
    product runs over or under."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _digests(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        out = [None] * len(batch)
        for rows, x in _usable(batch.column(1)):
            x = x + 0.0  # -0.0 is 0.0
            for i, v in zip(rows, x):
                out[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(1)], names=["id", "dig", "vec"])


def _hashes(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for rows, x in _usable(batch.column(1)):
            x = scaled(x)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([x.shape[1]] * len(rows), pa.int32()), pa.array(list(table_keys(unit)), pa.list_(pa.int32()))],
                names=["node", "dim", "keys"],
            )


def links_in(ids, counts, keys, x, table: int, left, right):
    """Exact links of one cell.  left, right: row numbers of its two blocks, or the same array.
    -> (linked rows, their numbers of linked vectors, [(id, smallest linked id)])."""
    import numpy as np

    norm = np.sqrt((x * x).sum(axis=1))
    cos = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None, :]
    near = cos >= MIN_COSINE
    for i, j in zip(*np.nonzero(np.abs(cos - MIN_COSINE) < 1e-12)):  # a matrix product may round otherwise
        a, b = x[left[i]], x[right[j]]
        near[i, j] = float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)) >= MIN_COSINE
    if left is right:
        np.fill_diagonal(near, False)
    for t in range(table):
        if not near.any():
            break
        near &= keys[left, t][:, None] != keys[right, t][None, :]
    n_left, n_right = near @ counts[right], counts[left] @ near
    big = np.iinfo(np.int64).max
    low_left = np.where(near, ids[right][None, :], big).min(axis=1, initial=big)
    low_right = np.where(near, ids[left][:, None], big).min(axis=0, initial=big)
    edges = []
    if near.any():  # a spanning forest: label propagation over the cell's links
        label_l, label_r = np.minimum(ids[left], low_left), np.minimum(ids[right], low_right)
        while True:
            new_l = np.minimum(label_l, np.where(near, label_r[None, :], big).min(axis=1, initial=big))
            new_r = np.minimum(label_r, np.where(near, new_l[:, None], big).min(axis=0, initial=big))
            if (new_l == label_l).all() and (new_r == label_r).all():
                break
            label_l, label_r = new_l, new_r
        some_l, some_r = near.any(axis=1), near.any(axis=0)
        edges = [(ids[left][some_l], label_l[some_l]), (ids[right][some_r], label_r[some_r])]
    if left is right:
        n_right = np.zeros_like(n_right)
    return n_left, n_right, edges


def _cells(batches):
    """Rows sorted by cell -> (id, n, root): links counted and a forest edge."""
    import numpy as np
    import pyarrow as pa

    cell = ["tab", "key", "dim", "bi", "bj"]
    for t, cuts in whole_cells(batches, cell):
        at = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in cell], axis=1)
        ids, counts, block = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "cnt", "block"))
        keys = np.array(t.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), TABLES)
        values = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(at[:, 2], dtype=np.int64)]
        out_id, out_n, out_root = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            x = scaled(values[ends[a] : ends[b]].reshape(b - a, -1).astype(np.float64))
            tab, _, _, bi, bj = at[a]
            rows = np.arange(b - a)
            left = rows if bi == bj else rows[block[a:b] == bi]
            right = left if bi == bj else rows[block[a:b] == bj]
            n_left, n_right, edges = links_in(ids[a:b], counts[a:b], keys[a:b], x, int(tab), left, right)
            for part, n in ((left, n_left), (right, n_right)):
                hit = n > 0
                out_id.append(ids[a:b][part][hit])
                out_n.append(n[hit])
                out_root.append(ids[a:b][part][hit])
            for i, root in edges:
                out_id.append(i)
                out_n.append(np.zeros(len(i), np.int64))
                out_root.append(root)
        if out_id:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_id, out_n, out_root)], names=["id", "n", "root"])


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """-> (id, n_links, component_id, kept) per row of ``vectors``.

    The row is what links: rows that share an id are vectors of their own, and so are rows with a
    null id.  n_links counts the other rows linked directly (cosine of MIN_COSINE or more found in
    a shared bucket); component_id is the smallest id reachable, null where only null ids are;
    kept says whether it is the row's own.  Null, empty or zero vectors and vectors with null or
    non-finite components link with nothing, nor do vectors of different widths.  Equal vectors
    always link.  An empty table gives no rows; other columns are ignored.  Ids are integers.
    """
    field = vectors.schema[vec_col].dataType.simpleString()
    kind = "array<float>" if field == "array<float>" else "array<double>"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    own = materialize(map_arrow(src, _digests, f"id long, dig binary, vec {kind}"), "digests")
    one = own.where("dig is not null").groupBy("dig").agg(F.min("id").alias("rep"), F.count("*").alias("cnt"), F.first("vec").alias("vec"))
    classes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = materialize(map_arrow(classes.select("node", "vec"), _hashes, "node long, dim int, keys array<int>"), "keys")
    ids = deal(keys.select("node", "dim", F.posexplode("keys").alias("tab", "key")), ["tab", "key", "dim"], BLOCK)
    dealt = (
        ids.join(keys.select("node", "keys").join(classes.select("node", "cnt", "vec"), "node"), "node")
        .select("tab", "key", "dim", "bi", "bj", "block", "node", "cnt", "keys", "vec")
        .repartition("tab", "key", "dim", "bi", "bj")
        .sortWithinPartitions("tab", "key", "dim", "bi", "bj")
    )
    found = materialize(map_arrow(dealt, _cells, "id long, n long, root long"), "links")
    links = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    cc = connected_components(found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    rooted = materialize(
        classes.select("node", "dig", "rep", "cnt").join(links, F.col("node") == F.col("id"), "left").drop("id")
        .join(cc.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
        .selectExpr("dig", "rep", "coalesce(n, 0) + cnt - 1 as n_links", "coalesce(component, node) as root"),
        "rooted",
    )
    low = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "low")
    label = materialize(rooted.join(low, "root").select("dig", "n_links", "component_id"), "label")
    return own.select("id", "dig").join(label, "dig", "left").selectExpr(
        "id", "coalesce(n_links, 0) as n_links", "if(n_links is null, id, component_id) as component_id",
        "if(n_links is null, id, component_id) <=> id as kept",
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
