"""Quality classifier: hashed word n-gram logistic regression, FTRL updates, sparse dot products.

Fitting is bounded: at most ``SAMPLE`` labelled documents of together ``SAMPLE_BYTES`` bytes, by a hash of
their id (``examples.sampled``), are turned into sparse rows on the executors and passed over
``EPOCHS`` times on the driver.  Scoring is one narrow pass over all whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import keyed, read, slices, without
from .examples import sampled
from .features import Ftrl, Hashing

#: Bounds of the labelled rows a model is fitted on, and of their texts.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
EPOCHS = 6
THRESHOLD = 0.7
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", hashing: Hashing = Hashing(), sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """Weights (last one the bias) learnt from ``labels (doc_id, label)`` outside the held-out
    quarter.  Labels other than 0 and 1, of unknown documents or without an id are ignored; no
    usable label gives weights of 0, a model that scores 0.5.  A document's rows with different texts or
    labels each count, equal ones once.  A text that would bring the sample over ``sample_bytes`` is passed
    over; ValueError if there are labels and no text fits.  Ids are integers."""
    import numpy as np

    known = labels.where(f"not ({HELD_OUT}) and {label_col} in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = sampled(docs, known, sample, sample_bytes).select("doc_id", "text", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                cols, values = [], []
                for c, v in hashing.sparse(part.column(1)):
                    cols.append(c)
                    values.append(v.astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                    names=["doc_id", "y", "cols", "vals"],
                )

    table = map_arrow(rows, run, "doc_id long, y int, cols array<int>, vals array<float>").toArrow().combine_chunks()
    y, ids = table["y"].to_numpy(), table["doc_id"].to_numpy()
    model = Ftrl(1 << hashing.bits)
    order = sorted(range(len(y)), key=lambda i: (hash_id(int(ids[i])), int(y[i])))
    cols, vals = table["cols"], table["vals"]
    data = [(cols[i].values.to_numpy(), vals[i].values.to_numpy().astype(np.float64), int(y[i])) for i in order]
    for _ in range(EPOCHS):
        for c, v, label in data:
            model.update(c, v, label)
    return model.weights().astype(np.float32)


def hash_id(x: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(x))


def score(docs: DataFrame, weights, hashing: Hashing = Hashing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, score): the probability of label 1 for every row.  A null or blank text has no
    features and scores the bias; repeated rows score alike; an empty table gives no rows; other
    columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                out = [w[c].astype(np.float64) @ v for c, v in hashing.sparse(part.column(1))]
                p = 1 / (1 + np.exp(-(np.array(out, np.float64) + float(w[-1]))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "id long, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return out.selectExpr("doc_id", f"{HELD_OUT} as held_out", "score", f"cast(score >= {THRESHOLD} as int) as predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored below the threshold.  Every row is judged by its own text,
    those without an id or with one id too; equal rows fare alike.  Where nothing was learnt (no usable
    label) all rows stay."""
    weights = fit(docs, labels)
    if not weights.any():
        return docs
    with_key, key = keyed(docs)
    bad = score(with_key, weights, id_col=key).where(F.col("score") < THRESHOLD).select("id").distinct()
    return without(with_key, key, bad).drop(key)
