"""Python workers need this package: send it to the executors of a session once."""

from __future__ import annotations

import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame

_sent: set[str] = set()


def ship(spark) -> None:
    """Add the package's sources to the session's Python files."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="siltstone-code-")) / "siltstone_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _sent.add(sc.applicationId)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` whose function may come from this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


@contextmanager
def small_batches(spark, rows: int = 1024, size: str = "4m"):
    """What runs inside hands its Python functions Arrow batches of at most ``rows`` rows and about ``size``."""
    put = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {name: spark.conf.get(name, None) for name in put}
    for name, value in put.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def parts_of(batch, column: int, most: int = 4 << 20):
    """Slices of an Arrow batch with about ``most`` bytes of the string ``column`` each, a row at least: what a
    task holds follows ``most`` and its longest text, not the rows of a batch."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(batch):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
