"""Approximate nearest vectors: an inverted file of cells, stored and searched by partition.

Spherical k-means on a bounded sample (SAMPLE vectors, by a hash of the id) gives the cells' centres.  Every
vector goes to the folder of its SPILL nearest cells; a cell of many rows has several files.  A search looks
into the ``probes`` cells nearest to a query: the folders of other cells are not read.  ``probes_for`` finds how
many a wanted recall needs, by the exact neighbours of a bounded sample.  Within a cell, blocks of points
meet groups of queries, so a hot cell is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..shipping import map_arrow, ship

#: Vectors that centres are fitted on, rounds of the fit, most cells of a width, rows of a block, queries of a group.
SAMPLE, FIT_ROUNDS, MOST_CELLS, BLOCK, GROUP = 16_384, 10, 4096, 4096, 256
#: Cells a vector is put into, and bytes of scores and copies that a task makes at a time.
SPILL, PLACE_BYTES = 2, 8 << 20
POINTS = "id long, vec array<double>, block int, dim int, cell int"
HITS = "query long, id long, score double"


@dataclass(frozen=True)
class Cells:
    """An index below ``folder``.  ``centres``: by width (cells, width) unit rows; ``sizes``: rows by (width,
    cell).  Both are bounded by MOST_CELLS for each width."""

    spark: SparkSession
    folder: str
    centres: dict
    sizes: dict

    def points(self, dim: int, cells: list[int]) -> DataFrame:
        t = self.spark.read.schema(POINTS).parquet(f"{self.folder}/points")
        return t.where((F.col("dim") == dim) & F.col("cell").isin(cells))

    @property
    def rows(self) -> int:
        return sum(self.sizes.values())


def unit(x):
    import numpy as np

    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = np.divide(x, most, out=np.zeros(x.shape), where=most > 0)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros(x.shape), where=norm > 0)


def fit(x, cells: int):
    """Unit rows -> (cells, width) centres: k-means by cosine from evenly spaced rows on; an empty cell keeps
    its centre."""
    import numpy as np

    distinct = np.unique(x, axis=0)
    start = np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).round().astype(int)
    c = distinct[np.random.default_rng(0).permutation(len(distinct))[start]] if len(distinct) else distinct
    for _ in range(FIT_ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros(c.shape)
        np.add.at(total, at, x)
        some = np.bincount(at, minlength=len(c)) > 0
        c = np.where(some[:, None], unit(total), c)
    return c


def _nearest(x, centres, n: int):
    """The n nearest centres of each row, nearest first."""
    import numpy as np

    s = unit(x) @ centres.T
    n = min(n, len(centres))
    top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def _placed(centres: dict, n: int):
    """Arrow batches (id, vec) -> (id, vec, dim, cell), a row for each of a vector's n cells."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            width = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(width):
                if int(dim) not in centres:
                    continue
                every, own = np.nonzero(width == dim)[0], centres[int(dim)]
                step = max(1, PLACE_BYTES // (8 * (2 * len(own) + min(n, len(own)) * int(dim))))
                for rows in (every[at : at + step] for at in range(0, len(every), step)):
                    vecs = batch.column(1).take(pa.array(rows))
                    cells = _nearest(vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), own, n)
                    again = pa.array(np.repeat(np.arange(len(rows)), cells.shape[1]))
                    ids = batch.column(0).take(pa.array(rows)).take(again)
                    yield pa.RecordBatch.from_arrays([ids, vecs.take(again), pa.array(np.full(cells.size, dim, np.int32)), pa.array(cells.ravel().astype(np.int32))], names=["id", "vec", "dim", "cell"])

    return run


def build(points: DataFrame, folder: str, id_col: str = "id", vec_col: str = "vector", cells: int | None = None, sample: int = SAMPLE, spill: int = SPILL) -> Cells:
    """Index ``points`` below ``folder``; ``cells`` is the number of cells of a width, by default the square
    root of the rows.  Rows without id or vector, and vectors with null components, are left out; vectors of
    each width are an index of their own, and a width that the sample missed has one cell."""
    import numpy as np

    spark = points.sparkSession
    own = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    widths = dict(own.groupBy(F.size("vec").alias("dim")).count().collect())
    centres = {}
    taken = own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    for dim, n in widths.items():
        x = np.array([r["vec"] for r in taken if len(r["vec"]) == dim], np.float64).reshape(-1, dim)
        k = max(1, min(MOST_CELLS, cells or round(n**0.5)))
        centres[dim] = fit(unit(x), k) if len(x) else np.zeros((1, dim))
    placed = written(map_arrow(own, _placed(centres, spill), "id long, vec array<double>, dim int, cell int"), "placed")
    sizes = {(r["dim"], r["cell"]): r["count"] for r in placed.groupBy("dim", "cell").count().collect()}
    split = spark.createDataFrame([(d, c, -(-n // BLOCK)) for (d, c), n in sizes.items()], "dim int, cell int, blocks int")
    dealt = placed.join(F.broadcast(split), ["dim", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))  # a row a cell is broadcast
    dealt = dealt.select("id", "vec", "block", "dim", "cell").repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block")
    dealt.write.partitionBy("dim", "cell").mode("overwrite").parquet(f"{folder}/points")
    rows = [(d, c, centres[d][c].tolist(), sizes.get((d, c), 0)) for d in centres for c in range(len(centres[d]))]
    spark.createDataFrame(rows, "dim int, cell int, centre array<double>, n long").write.mode("overwrite").parquet(f"{folder}/cells")
    return Cells(spark, folder, centres, sizes)


def load(spark: SparkSession, folder: str) -> Cells:
    import numpy as np

    by: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{folder}/cells").collect(), key=lambda r: (r["dim"], r["cell"])):
        by.setdefault(r["dim"], []).append(r)
    return Cells(spark, folder, {d: np.array([r["centre"] for r in rs]) for d, rs in by.items()}, {(d, r["cell"]): r["n"] for d, rs in by.items() for r in rs if r["n"]})


def probes_for(index: Cells, points: DataFrame, k: int = 10, recall: float = 0.95, id_col: str = "id", vec_col: str = "vector", sample: int = 128) -> int:
    """The least number of cells to look into for ``recall`` of the k nearest, measured on ``sample`` of the
    points, by a hash of the id, against all of them."""
    import numpy as np

    from .search import dense_topk

    asked = points.where(f"{id_col} is not null and size({vec_col}) > 0").select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).cast("array<double>").alias("vector"))
    asked = [r for r in asked.orderBy(F.xxhash64("query", F.lit(1)), "query").limit(sample).collect() if len(r["vector"]) in index.centres and None not in r["vector"]]
    if not asked:
        return 1
    near = dense_topk(points, index.spark.createDataFrame(asked, "query long, vector array<double>"), k, id_col, vec_col)
    where = index.spark.read.schema(POINTS).parquet(f"{index.folder}/points").select("id", "dim", "cell")
    found = where.join(near.select("query", "id"), "id").distinct().collect()  # k rows a query and cell
    order = {r["query"]: np.argsort(_nearest(np.array([r["vector"]], np.float64), index.centres[len(r["vector"])], MOST_CELLS)[0]) for r in asked}
    first: dict = {}
    for r in found:
        pair = (r["query"], r["id"])
        first[pair] = min(first.get(pair, MOST_CELLS), int(order[r["query"]][r["cell"]]) + 1)
    ranks = sorted(first.values())
    return ranks[min(len(ranks) - 1, int(len(ranks) * recall))] if ranks else 1


def _meet(k: int, least: float | None):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        from .search import DIGITS, best_of

        empty = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        rows = lambda t: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("vec").chunks]).reshape(len(t), -1)
        x, q = unit(rows(left)), unit(rows(right))
        ids, names, scores = left.column("id").to_numpy(), right.column("query").to_numpy(), q @ x.T
        out = []
        for name, s in zip(names, scores):
            hit = np.arange(len(ids)) if least is None else np.nonzero(s >= least)[0]
            best = hit[best_of(s[hit], ids[hit], k)] if len(hit) else hit
            out.append((np.full(len(best), name), ids[best], np.round(s[best], DIGITS)))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query", "id", "score"), zip(*out))})

    return run


def search(index: Cells, queries: DataFrame, k: int, probes: int = 8, least: float | None = None) -> DataFrame:
    """``queries (query bigint, vector)`` -> (query, id, score, rank): of the points in the ``probes`` nearest
    cells the k nearest by cosine, ``least`` being the smallest score that counts.  With ``probes`` at
    the number of cells the result is exact."""
    from functools import reduce

    from .search import ranked

    spark = index.spark
    ship(spark)
    own = queries.select(F.col("query").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vec")).where("id is not null and vec is not null and not exists(vec, x -> x is null)")
    probed = written(map_arrow(own, _placed(index.centres, probes), "id long, vec array<double>, dim int, cell int").withColumn("grp", F.expr("cast(0 as int)")), "probes")
    n = probed.groupBy("dim", "cell").count().collect()  # a row a cell
    found = []
    for dim in sorted({r["dim"] for r in n}):
        asked = {r["cell"]: r["count"] for r in n if r["dim"] == dim and (dim, r["cell"]) in index.sizes}
        if not asked:
            continue
        shape = spark.createDataFrame([(c, -(-m // GROUP), -(-index.sizes[dim, c] // BLOCK)) for c, m in asked.items()], "cell int, groups int, blocks int")
        left = index.points(dim, sorted(asked)).join(F.broadcast(shape), "cell").select("cell", "block", F.explode(F.expr("sequence(0, groups - 1)")).alias("grp"), "id", "vec")
        right = probed.where(F.col("dim") == dim).join(F.broadcast(shape), "cell").select("cell", F.expr("cast(pmod(xxhash64(id), groups) as int)").alias("grp"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("id").alias("query"), "vec")
        keys = ["cell", "block", "grp"]
        found.append(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k, least), HITS))
    empty = spark.createDataFrame([], HITS)
    hits = reduce(DataFrame.unionByName, found, empty)
    return ranked(hits.dropDuplicates(["query", "id"]), k)
