"""Buckets of any size as cells of bounded size.

Rows that share a bucket are to be compared with each other.  A bucket of more than ``block`` rows
is dealt into blocks by a hash of the node, and each pair of its blocks is a cell of its own, so a
hot bucket spreads over many tasks and no task holds more than two blocks of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1024


def deal(placed: DataFrame, keys: list[str], block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """``placed (node, *keys)`` -> (node, *keys, block, bi, bj): a row per cell in which a node of
    a bucket of two or more has its place.  Sizes are counted before their shuffle, or come as
    ``counted (*keys, m)``, and the join back has a plain exchange on either side, so Spark can
    split a hot bucket."""
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("m")) if counted is None else counted
    sizes = materialize(sizes.where("m > 1").selectExpr(*keys, f"cast(ceil(m / {block}) as int) as nb"), "buckets")
    cell = (
        "explode(if(nb = 1, array(named_struct('bi', 0, 'bj', 0)), transform(sequence(0, nb - 1), "
        "j -> named_struct('bi', least(block, j), 'bj', greatest(block, j))))) as c"
    )
    return (
        placed.join(sizes, keys)
        .withColumn("block", F.expr("cast(pmod(xxhash64(node), nb) as int)"))
        .selectExpr("node", *keys, "block", cell)
        .selectExpr("node", *keys, "block", "c.bi", "c.bj")
    )


def whole_cells(batches, cell: list[str]):
    """Arrow batches sorted by the integer columns ``cell`` -> (table, cuts): tables of whole cells;
    the i-th is rows cuts[i] to cuts[i + 1]."""
    import numpy as np
    import pyarrow as pa

    def cut(t):
        key = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in cell], axis=1)
        return np.nonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])[0]

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(rest):
            continue
        cuts = cut(rest)
        if len(cuts) > 2:
            yield rest.slice(0, int(cuts[-2])).combine_chunks(), cuts[:-1]
            rest = rest.slice(int(cuts[-2]))
    if rest is not None and len(rest):
        yield rest.combine_chunks(), cut(rest)
