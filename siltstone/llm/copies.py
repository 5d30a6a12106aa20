"""Near copies by SimHash and Golay keys: five-word shingles, similarity 0.8 or more.

op6's fingerprints link at two bits of 64, which finds little but equal texts.  Texts whose sets of
word shingles have a Jaccard similarity of 0.8 differ in about 15 % of their SimHash bits, so this
operator takes longer fingerprints and more keys:

1. A text's set of shingles gives a fingerprint of BITS bits.  Texts with equal sets are collapsed
   into a class first.
2. Keys: a table decodes one 23-bit segment to its nearby Golay codewords (one or six indices) and
   adds EXACT bits drawn from the rest.  Segments that differ in one bit always share an index, those
   of similar texts mostly do; a pair meets in one of the TABLES with probability 0.94 at
   similarity 0.8 and 0.99 from 0.85 on.  EXACT keeps unlike texts apart: in each table two of
   them meet with probability 36 / 2**(12 + EXACT), so beyond some 10**8 texts raise it, with TABLES.
3. Classes that share a key are compared in cells of bounded size (``cells``).  Of the others within
   REACH bits a class proposes the nearest and the smallest, so a cell emits two pairs a row at most;
   a cell with further pairs in reach also gives its rows, once each.
4. Proposed pairs are verified exactly on their sets of shingles; verified ones are links.
5. In those cells all further pairs in reach whose classes these links have not joined are
   verified as well.  Groups are then those that all pairs in reach of all cells give.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .cells import deal, whole_cells
from .common import fresh, keyed, materialize, slices, small, without
from .components import connected_components
from .simhash import golay_keys

WORDS, SIMILARITY = 5, 0.8
BITS, SEGMENT, TABLES, EXACT, SEED = 384, 23, 64, 16, 42
#: Bits by which similar fingerprints may differ: 58 on average at similarity 0.8, and 3 deviations.
REACH = 80
#: Texts whose keys one task makes, and one batch: a text has some 340 keys, so a task counts 1.4
#: million of them in memory before the shuffle, and as many after it, without a spill.
TASK_TEXTS, BATCH_TEXTS = 4096, 512
#: Pairs of classes, and rows of cells.
PAIRS = "key long, bi int, bj int, a long, b long"
#: Odd 64-bit multipliers that stretch a shingle's hash to BITS bits.
STRETCH = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def shingle_set(text: bytes | None, n: int = WORDS):
    """A text's distinct shingles as sorted hashes: lower-cased words between ASCII white space;
    of fewer than n words the whole sequence; none for a blank text."""
    import numpy as np
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def fingerprint(shingles) -> bytes:
    """BITS bits; a bit is set if it is in more than half of the shingles' stretched hashes."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        h = shingles[at : at + (1 << 12), None]
        h = (h ^ (h >> np.uint64(31))) * np.array(STRETCH, np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(STRETCH[1])
        ones += np.unpackbits((h ^ (h >> np.uint64(32))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


@lru_cache(maxsize=1)
def tables():
    """For each table the first bit of its segment and its EXACT other bits."""
    import numpy as np

    rng, segments = np.random.default_rng(SEED), BITS // SEGMENT
    out = []
    for t in range(TABLES):
        low = t % segments * SEGMENT
        rest = np.setdiff1d(np.arange(BITS), np.arange(low, low + SEGMENT))
        out.append((low, rng.choice(rest, EXACT, replace=False)))
    return out


def table_keys(fps):
    """(n, BITS // 8) bytes -> (rows, keys): each fingerprint's distinct keys."""
    import numpy as np

    bits = np.unpackbits(fps, axis=1).astype(np.int64)
    rows, keys = [], []
    for t, (low, exact) in enumerate(tables()):
        near = golay_keys(bits[:, low : low + SEGMENT] @ (1 << np.arange(SEGMENT)))
        own = (t << EXACT | bits[:, exact] @ (1 << np.arange(EXACT)))[:, None] << 12 | near
        new = np.ones(own.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :1]
        at = np.nonzero(new)
        rows.append(at[0])
        keys.append(own[at])
    return np.concatenate(rows), np.concatenate(keys)


def _far(fps, left, right):
    """The bits by which the rows of two blocks differ."""
    import numpy as np

    a, b = fps[left].view(np.uint64), fps[right].view(np.uint64)
    far = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        far += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return far


def in_reach(fps, left, right):
    """Row numbers of all pairs of one cell in reach, each pair once."""
    import numpy as np

    close = _far(fps, left, right) <= REACH
    x, y = np.nonzero(np.triu(close, 1) if left is right else close)
    return left[x], right[y]


def propose(nodes, fps, left, right):
    """(src, dst) pairs of one cell: for each row its nearest and its smallest partner in reach."""
    import numpy as np

    far = _far(fps, left, right)
    if left is right:
        np.fill_diagonal(far, BITS + 1)
    out = []
    for d, own, other in ((far, nodes[left], nodes[right]), (far.T, nodes[right], nodes[left])):
        close = d <= REACH
        hit = np.nonzero(close.any(axis=1))[0]
        if len(hit):
            lowest = np.where(close[hit], other[None, :], np.iinfo(np.int64).max).min(axis=1)
            out += [(own[hit], other[d[hit].argmin(axis=1)]), (own[hit], lowest)]
        if left is right:
            break
    return out


def _signatures(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, "text"):
            sets = [shingle_set(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary())],
                names=["id", "key", "dig", "fp"],
            )


def _placed(batches):
    """Batches of (node, fp) -> (batch, rows, keys), BATCH_TEXTS texts at a time."""
    import numpy as np

    for batch in batches:
        for at in range(0, len(batch), BATCH_TEXTS):
            part = batch.slice(at, BATCH_TEXTS)
            fps = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), BITS // 8)
            yield part, *table_keys(fps)


def _keys(batches):
    import pyarrow as pa

    for part, rows, keys in _placed(batches):
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(keys)], names=["node", "key"])


def _key_counts(batches):
    """(key, m): how often each key comes among the texts of a task, TASK_TEXTS at a time."""
    import numpy as np
    import pyarrow as pa

    held, texts = [], 0

    def counted():
        found, m = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)]), pa.array(m[at : at + (1 << 16)])], names=["key", "m"])

    for part, _, keys in _placed(batches):
        held.append(keys)
        texts += len(part)
        if texts >= TASK_TEXTS:
            yield from counted()
            held, texts = [], 0
    if held:
        yield from counted()


def _halves(t, cuts):
    """Tables of whole cells -> for each cell of two rows or more its rows, and those of its two blocks (the
    same if it has one)."""
    import numpy as np

    bi, bj, block = (t.column(c).to_numpy() for c in ("bi", "bj", "block"))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < 2:
            continue
        rows = np.arange(a, b)
        left = rows if bi[a] == bj[a] else rows[block[a:b] == bi[a]]
        yield rows, left, left if bi[a] == bj[a] else rows[block[a:b] == bj[a]]


def _fps(t):
    import numpy as np

    return np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(len(t), BITS // 8)


def _ordered(x, y):
    import numpy as np

    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


def _cells(batches):
    """-> PAIRS: proposed pairs (a, b), without a key; of cells with further pairs in reach the rows, b being
    the block of a."""
    import numpy as np
    import pyarrow as pa

    for t, cuts in whole_cells(batches, ["key", "bi", "bj"]):
        nodes, fps = t.column("node").to_numpy(), _fps(t)
        found, rest = [], []
        for rows, left, right in _halves(t, cuts):
            own = propose(nodes, fps, left, right)
            if own:
                pairs = _ordered(np.concatenate([p for p, _ in own]), np.concatenate([q for _, q in own]))
                found.append(pairs)
                if len(rows) > 2 and in_reach(fps, left, right)[0].size > len(pairs):
                    rest.append(rows)
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            none = pa.nulls(len(pairs), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "bi", "bj", "a", "b"])
        if rest:
            at = pa.array(np.concatenate(rest))
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(at).combine_chunks() for c in ("key", "bi", "bj", "node")), t.column("block").take(at).combine_chunks().cast(pa.int64())], names=["key", "bi", "bj", "a", "b"])


def _rest(batches):
    """Rows of cells with their ``root`` -> all pairs in reach whose roots differ."""
    import numpy as np
    import pyarrow as pa

    for t, cuts in whole_cells(batches, ["key", "bi", "bj"]):
        nodes, roots, fps = t.column("node").to_numpy(), t.column("root").to_numpy(), _fps(t)
        for _, left, right in _halves(t, cuts):
            x, y = in_reach(fps, left, right)
            apart = roots[x] != roots[y]
            pairs = _ordered(nodes[x[apart]], nodes[y[apart]])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _sets(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, "text"):
            sets = [shingle_set(t).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """-> (own, groups): ``own (id, key, dig)``, a row per row of ``docs``, where key stands for id and
    text; ``groups (dig, id, key)``, by class of equal shingle sets the id and key of the row that
    its group keeps: the smallest id (a null before all), of those the smallest key.

    Blank and null texts are one class without links.  An empty table gives no rows; other columns
    are not looked at.
    """
    with_key, key = keyed(docs, id_col, text_col)
    src = with_key.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    own = materialize(map_arrow(src, _signatures, "id long, key long, dig binary, fp binary"), "copies")
    one = own.groupBy("dig").agg(F.min(F.struct("id", "key")).alias("rep"), F.min("fp").alias("fp"))
    classes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    marked = classes.where("fp is not null").select("node", "fp")
    tasks = max(1, -(-classes.count() // TASK_TEXTS))
    spread = marked.repartition(tasks, "node")
    # as many partitions after the shuffle, which Spark does not merge: a key is there once a task at most
    counted = map_arrow(spread, _key_counts, "key long, m long").repartition(tasks, "key").groupBy("key").agg(F.sum("m").alias("m"))
    placed = deal(map_arrow(spread, _keys, "node long, key long"), ["key"], counted=counted)
    cells = placed.join(marked, "node").select("key", "bi", "bj", "block", "node", "fp").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    met = materialize(map_arrow(cells, _cells, PAIRS), "met")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(_verified(materialize(pairs.distinct(), "pairs"), classes, src), "links")

    links = linked(met.where("key is null").select("a", "b"))
    cc = connected_components(links)
    rest = met.where("key is not null").join(cc.withColumnRenamed("node", "member"), F.col("a") == F.col("member"), "left")
    rest = materialize(rest.selectExpr("key", "bi", "bj", "a as node", "cast(b as int) as block", "coalesce(component, a) as root"), "rest")
    apart = rest.groupBy("key", "bi", "bj").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "bi", "bj")
    open_ = materialize(rest.join(apart, ["key", "bi", "bj"]), "open")
    if open_.limit(1).count():
        open_ = open_.join(marked, "node").select("key", "bi", "bj", "block", "node", "root", "fp").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        cc = connected_components(links.unionByName(linked(map_arrow(open_, _rest, "a long, b long"))))
    rooted = materialize(
        classes.select("node", "dig", "rep").join(cc.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
        .selectExpr("dig", "rep", "coalesce(component, node) as root"),
        "rooted",
    )
    keep = materialize(rooted.groupBy("root").agg(F.min("rep").alias("keep")), "keep")
    return own.select("id", "key", "dig"), rooted.join(keep, "root").select("dig", "keep.id", "keep.key")


def _verified(pairs: DataFrame, classes: DataFrame, src: DataFrame) -> DataFrame:
    """``pairs (a, b)`` of classes whose sets of shingles are similar, as (src, dst)."""
    wanted = pairs.selectExpr("explode(array(a, b)) as node").distinct().join(classes.selectExpr("node", "rep.key as want"), "node")
    wanted = small(materialize(wanted, "wanted"))
    texts = src.select("key", "text").join(wanted, F.col("key") == F.col("want")).select("node", "text")
    sets = materialize(map_arrow(texts, _sets, "node long, shingles array<bigint>").dropDuplicates(["node"]), "sets")
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.join(x, "a").join(y, "b").selectExpr("a", "b", "size(x) + size(y) as n", "size(array_intersect(x, y)) as both")
    return both.where(f"both >= {SIMILARITY}D * (n - both)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id (``copy_groups``).

    Rows without an id and different texts under one id are rows of their own; of rows that repeat
    one id and text, one stays, the same for all columns or not.  An empty table gives no rows.
    """
    own, groups = copy_groups(docs, id_col, text_col)
    kept = groups.withColumnRenamed("id", "keep_id").withColumnRenamed("key", "keep_key")
    marked = materialize(own.join(kept, "dig").selectExpr("key", "key = keep_key as stays"), "marked")
    lost = marked.where("not stays").select(F.col("key").alias("id")).distinct()
    repeated = materialize(marked.where("stays").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("id")), "repeated")
    with_key, key = keyed(docs, id_col, text_col)
    if repeated.limit(1).count() == 0:
        return without(with_key, key, lost).drop(key)
    mark = fresh(with_key, "again")
    again = with_key.join(repeated.withColumnRenamed("id", mark), F.col(key) == F.col(mark), "left_semi").dropDuplicates([key])
    return without(with_key, key, lost.unionByName(repeated)).unionByName(again).drop(key)
