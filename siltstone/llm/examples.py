"""A bounded sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(docs: DataFrame, known: DataFrame, rows: int, size: int) -> DataFrame:
    """``docs (doc_id, text)`` of ``known (doc_id, y)``: at most ``rows`` rows whose texts have at most
    ``size`` bytes together -> (doc_id, y, text).

    Rows are taken in the order of a hash of the id; one that would bring the texts over ``size`` is
    passed over, and the next that fits is taken.  Equal rows count once.  The driver sees ids and
    sizes of at most ``rows`` rows.  Nulls are empty texts.  ValueError if there are labelled rows and
    none fits.
    """
    order = [F.xxhash64("doc_id"), "y"]
    chosen = known.select("doc_id", "y").distinct().orderBy(*order).limit(rows)
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    heads = found.select("doc_id", "y", "h", F.octet_length("text").alias("b")).orderBy(*order, "h").limit(rows).collect()
    take, left = set(), size
    for r in heads:
        key = (r["doc_id"], r["y"], r["h"])
        if r["b"] <= left and key not in take:
            take.add(key)
            left -= r["b"]
    if heads and not take:
        raise ValueError(f"no labelled text has at most {size} bytes")
    keys = docs.sparkSession.createDataFrame(sorted(take), "doc_id long, y int, h long")
    return found.join(F.broadcast(keys), ["doc_id", "y", "h"]).dropDuplicates(["doc_id", "y", "h"]).select("doc_id", "y", "text")
