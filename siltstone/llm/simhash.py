"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A, B, C of 22, 21 and 21 bits.  The binary Golay code
[23,12,7] puts each segment within distance 3 of exactly one codeword; its key set is that
codeword's index and, for a segment at distance 3, those of the five codewords at distance 4.
Two segments that differ in one bit at most share such an index: the codeword within 3 of one is
within 4 of the other.  Of two fingerprints that differ in two bits at most, one segment is equal
and the next one (in the cycle A -> B -> C -> A) differs in one bit at most:

    errors (2,0,0): B equal, C equal      (1,1,0): C equal, A one bit
    errors (0,2,0): C equal, A equal      (1,0,1): B equal, C one bit
    errors (0,0,2): A equal, B equal      (0,1,1): A equal, B one bit

So the three families "A exact + Golay(B)", "B exact + Golay(C)", "C exact + Golay(A)", 18 keys
of about 33 bits at most, find every link; a join on the key verifies the Hamming distance.
Equal fingerprints are collapsed first, so a group of exact copies is one row there.  A key of more
than BLOCK different fingerprints is dealt into blocks, and each pair of its blocks is joined on its own.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .cells import BLOCK
from .common import materialize, slices, small
from .components import connected_components

#: Generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


@lru_cache(maxsize=1)
def golay_tables():
    """By 11-bit syndrome: the coset leader, and the codewords to add to the nearest one (0 for
    the nearest itself; repeated zeros where there are no others at distance 4)."""
    import numpy as np

    leader = np.zeros(2048, np.int64)
    more = np.zeros((2048, 6), np.int64)
    words = np.array([m << 11 | _remainder(m << 11) for m in range(4096)], np.int64)
    sevens = [int(w) for w in words if int(w).bit_count() == 7]
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            v = sum(1 << b for b in bits)
            s = _remainder(v)
            leader[s] = v
            if n == 3:
                more[s, 1:] = [w for w in sevens if w & v == v]
    parts = [np.array([_remainder(b << shift) for b in range(256)], np.int64) for shift in (0, 8)]
    parts.append(np.array([_remainder(b << 16) for b in range(128)], np.int64))
    return leader, more, parts


def golay_keys(segment):
    """Array of 23-bit integers -> (n, 6) codeword indices, repeated where there are fewer."""
    leader, more, (low, mid, high) = golay_tables()
    s = low[segment & 255] ^ mid[segment >> 8 & 255] ^ high[segment >> 16]
    return ((segment ^ leader[s])[:, None] ^ more[s]) >> 11


def fuzzy_keys(fingerprints):
    """uint64 array -> (rows, keys): each fingerprint's distinct keys, with its row number."""
    import numpy as np

    f = fingerprints.astype(np.uint64)
    seg = [((f >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    rows, keys = [], []
    for family in range(3):
        exact, near = seg[family], golay_keys(seg[(family + 1) % 3])
        own = ((family << 22 | exact) << 12)[:, None] | near
        fresh = np.ones(own.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :1]
        at = np.nonzero(fresh)
        rows.append(at[0])
        keys.append(own[at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """Contract: ASCII-lower-cased words between ASCII white space, n-word shingles with
    repeats, XXH64 with seed 42; a bit is set if it is in more than half of the hashes."""
    import numpy as np
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """-> (id, fp bigint): one row per row of ``docs``; null and blank texts get 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                out = [fingerprint(t, n) for t in part.column(1).cast(pa.binary()).to_pylist()]
                fps = pa.array(np.array(out, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), fps], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "id long, fp long")


def fingerprint_links(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``reps (fp)``, distinct -> (src, dst): all pairs at Hamming distance 2 at most (a pair
    may come more than once).  What is joined at once is two blocks of a key at most."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])

    keys = materialize(map_arrow(reps.select("fp"), run, "key long, fp long"), "keys")
    hot = keys.groupBy("key").agg(F.count("*").alias("m")).where(f"m > {block}")
    hot = materialize(hot.selectExpr("key", f"cast(ceil(m / {block}) as int) as nb"), "hot-keys")
    dealt = keys.join(small(hot), "key", "left").selectExpr("key", "fp", "coalesce(nb, 1) as nb").selectExpr("*", "cast(pmod(xxhash64(fp), nb) as int) as block")
    cell = "transform(sequence(0, nb - 1), j -> struct(least(block, j) as bi, greatest(block, j) as bj))"
    cells = dealt.selectExpr("key", "fp", "block", f"explode({cell}) as c").select("key", "fp", "block", "c.bi", "c.bj")
    a, b = cells.alias("a"), cells.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "bi", "bj")]
    own = (F.col("a.bi") == F.col("a.bj")) | (F.col("a.block") != F.col("b.block"))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    return a.join(b, same[0] & same[1] & same[2] & (F.col("a.fp") < F.col("b.fp")) & own & near).select(
        F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, fp, component_id): component_id is the smallest id reachable over links of two
    differing bits or fewer.

    Null, empty and blank texts have fingerprint 0 and link like any other.  Ties and repeated
    rows: equal ids give equal rows, each returned.  An empty table gives no rows; other columns
    of ``docs`` are not looked at, whatever their names.
    """
    own = materialize(fingerprints(docs, id_col, text_col), "fp")
    reps = materialize(own.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    cc = connected_components(fingerprint_links(reps))
    member = materialize(cc.join(reps, cc["node"] == reps["fp"]).select("fp", "rep", F.col("component").alias("root")), "member")
    # the smallest fingerprint of a component has no row of its own in cc
    roots = member.select("root").distinct().join(reps, F.col("root") == F.col("fp")).select("fp", "rep", "root")
    member = materialize(member.unionByName(roots).distinct(), "member")
    low = materialize(member.groupBy("root").agg(F.min("rep").alias("low")), "low")
    linked = member.join(low, "root").select("fp", "low")
    label = materialize(
        reps.join(linked, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id")), "label"
    )
    return own.join(label, "fp").select("id", "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
