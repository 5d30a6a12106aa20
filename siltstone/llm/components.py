"""Connected components of a large edge table by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond").

Minima are pre-aggregated before their shuffle and written out, so each join has a plain
exchange on either side and Spark can split the partition of a hot node.  Each round cuts the
lineage through a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges (src bigint, dst bigint)`` -> ``(node, component)``, component = smallest node
    reachable.  Nodes without an edge to another node are not returned; loops and repeated
    edges are allowed; no edges give no rows."""
    e = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low"
        )
        large = materialize(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large"
        )
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hops = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(hops.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
