"""Shared pieces: the shared scratch folder, materialised tables, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to so many rows, and so many bytes of its longest row times its rows.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_own_dir: list[str] = []
#: Folders written inside the open ``scratch`` blocks, innermost last.
_open: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where that is unset, a temporary
    folder of this process, on a local master only; on a cluster that is an error, for executors
    would each write to a disk of their own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="siltstone-"))
        root = _own_dir[0]
    return f"{root.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, survives lost executors, and, unlike an RDD
    checkpoint, is columnar and compressed.  ``scratch`` and ``clear_scratch`` remove what was
    written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables written inside, save those whose path was taken out of the
    list it gives.  A DataFrame that still reads one of them must have been written out by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables this application materialised.  Results not yet consumed need them."""
    delete(spark, scratch_root(spark))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (materialised) with a broadcast hint if it has at most ``rows`` rows and, counting
    every row as long as the longest, ``most`` bytes; a larger one is joined by shuffle."""
    wide = [f"coalesce(octet_length(to_json(struct(`{f.name}`))), 0)" for f in df.schema.fields if f.dataType.typeName() in ("array", "string", "struct", "map", "binary")]
    size = " + ".join([str(8 * len(df.columns)), *wide])
    got = df.limit(rows + 1).selectExpr(f"{size} as b").agg(F.count("*").alias("n"), F.max("b").alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and got["n"] * (got["b"] or 0) <= most else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch, column: str, limit: int = 4 << 20):
    """Zero-copy slices of an Arrow batch with about ``limit`` bytes of ``column`` each (one row
    at least), so that a task's memory follows ``limit`` and the longest text only."""
    import numpy as np
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind().itemsize)
    start = 0
    while start < len(col):
        stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column that stands for id and text, and its name: a filter decides by it, so
    rows without an id, and different texts under one id, are each judged on their own."""
    name = fresh(docs, "key")
    return docs.withColumn(name, F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))), name


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is among ``ids (id)``; a null matches a null."""
    name = fresh(docs, "drop")
    return docs.join(ids.select(F.col("id").alias(name)), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
