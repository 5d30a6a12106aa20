"""Copy-on-write keyed upsert into sorted Parquet files of bounded size.

A table is a folder of Parquet files sorted by an integer key, each of at most ``max_rows`` rows.  A change
belongs to the file whose key range begins last at or below its key, its home.  ``upsert``

1. drops deletes of absent keys by the homes' footers (smallest and largest key) and by a Bloom filter of
   each home's keys,
2. joins what is left exactly with the rows of its homes, and keeps the changes that alter a row,
3. reads the files of altered rows, merges the changes in, numbers the rows in key order and writes
   them as new files beside the old ones, which it deletes once the new ones are committed.

What the driver holds is one entry a file (key range, rows) and one a shuffle partition.  Rows and keys stay
on the executors: numbering is a range sort whose partitions are counted, Bloom filters meet the deletes in
salted groups.  All files are written by Spark's committed writer, one task a file.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .common import delete, fresh, materialize, new_path, read

#: Deletes that meet one copy of a home's Bloom filter, and the filter's bits a key and probes.
SALT_ROWS, BITS, PROBES = 100_000, 10, 7


@dataclass(frozen=True)
class File:
    path: str
    first: int | None
    last: int | None
    rows: int
    columns: str

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


def _listed(spark: SparkSession, folder: str, schema) -> list[str]:
    return spark.read.schema(schema).parquet(folder).inputFiles()


def footers(spark: SparkSession, paths: list[str], key: str) -> list[File]:
    """The files in key order, from their footers alone.  A file without keys comes first."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                names = meta.schema.to_arrow_schema().names
                low = [s for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(names.index(key)).statistics) is not None and s.has_min_max]
                out.append((path, min((s.min for s in low), default=None), max((s.max for s in low), default=None), meta.num_rows, ",".join(names)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["path", "first", "last", "rows", "columns"]) if out else pa.RecordBatch.from_pylist([])

    if not paths:
        return []
    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 24))
    found = [File(*r) for r in map_arrow(table, run, "path string, first long, last long, rows long, columns string").collect()]
    return sorted(found, key=lambda f: (f.first is not None, f.first or 0, f.path))


def _numbered(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """``df`` sorted by ``by`` and written, with a column that numbers its rows from 0, and its name."""
    spark = df.sparkSession
    part, place, rank = (fresh(df, x) for x in ("part", "place", "rank"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    done = materialize(done, "numbered")
    counts = dict(done.groupBy(part).count().collect())  # one row a partition of the sort
    before, starts = 0, []
    for p in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(p, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in starts or [0]])
    return done.withColumn(rank, F.col(place) + starts[F.col(part)]).drop(part, place), rank


def _write(rows: DataFrame, rank: str, starts: list[int], columns: list, folder: str) -> None:
    """Append ``rows`` to the folder: a file for each of ``starts``, its first row's number."""
    ship(rows.sparkSession)

    @F.pandas_udf("int")
    def file_of(r):
        import numpy as np
        import pandas as pd

        return pd.Series((np.searchsorted(starts, r.to_numpy(), "right") - 1).astype("int32"))

    out = fresh(rows, "file")
    dealt = rows.withColumn(out, file_of(rank)).repartitionById(len(starts), F.col(out)).sortWithinPartitions(rank)
    dealt.select(*columns).write.mode("append").parquet(folder)


def write_sorted(df: DataFrame, folder: str, key: str, max_rows: int) -> list[File]:
    """``df`` as Parquet files sorted by ``key`` of ``max_rows`` rows, the last holding the rest, in a new
    folder.  Rows of one key are in no particular order; null keys come first.  No rows give no file."""
    spark = df.sparkSession
    rows, rank = _numbered(df, key)
    total = rows.count()
    if not total:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return []
    _write(rows, rank, list(range(0, total, max_rows)), [F.col(f"`{c}`") for c in df.columns], folder)
    return footers(spark, _listed(spark, folder, df.schema), key)


def with_home(changes: DataFrame, files: list[File], key: str, name: str = "home") -> DataFrame:
    """``changes`` with the number of each key's home; without files every home is 0."""
    import numpy as np

    ship(changes.sparkSession)
    firsts = np.array([f.first for f in files if f.first is not None], np.int64)
    blank = len(files) - len(firsts)

    @F.pandas_udf("int")
    def home(k):
        import pandas as pd

        at = np.searchsorted(firsts, k.to_numpy(np.int64), "right")
        return pd.Series(np.where(at > 0, at + blank - 1, 0).astype("int32"))

    return changes.where(F.col(key).isNotNull()).withColumn(name, home(F.col(key).cast("long")))


def _probes(ids, bits: int):
    """(n,) keys -> (n, PROBES) bit numbers."""
    import numpy as np

    x = ids.astype(np.int64).view(np.uint64)
    h = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        y = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h.append(y ^ (y >> np.uint64(29)))
    return ((h[0][:, None] + np.arange(PROBES, dtype=np.uint64) * (h[1] | np.uint64(1))[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom(ids) -> bytes:
    import numpy as np

    flags = np.zeros(-(-max(1, len(ids)) * BITS // 8) * 8, bool)
    flags[_probes(ids, len(flags)).ravel()] = True
    return np.packbits(flags).tobytes()


def may_hold(ids, data: bytes):
    import numpy as np

    flags = np.unpackbits(np.frombuffer(data, np.uint8)).view(bool)
    return flags[_probes(ids, len(flags))].all(axis=1)


def blooms(rows: DataFrame, key: str) -> DataFrame:
    """``rows (file, key)`` -> (file, bits): each file's Bloom filter."""

    def run(k, t):
        import pyarrow as pa

        return pa.table({"file": pa.array([k[0].as_py()], pa.int32()), "bits": pa.array([bloom(t.column(1).to_numpy())], pa.binary())})

    return rows.groupBy("file").applyInArrow(run, "file int, bits binary")


def prune_deletes(deletes: DataFrame, files: list[File], rows: DataFrame, key: str) -> DataFrame:
    """``deletes (key, home, ...)`` without keys that are absent for certain: outside the home's footer
    range, or not in its Bloom filter.  ``rows (file, key)`` are the table's."""
    spark = deletes.sparkSession
    ship(spark)
    if not files:
        return deletes.limit(0)
    low, high = (F.array(*[F.lit(x).cast("long") for x in xs])[F.col("home")] for xs in ([f.first for f in files], [f.last for f in files]))
    inside = materialize(deletes.where((low <= F.col(key)) & (F.col(key) <= high)), "deletes")
    counts = dict(inside.groupBy("home").count().collect())  # at most one row a file
    if not counts:
        return inside
    salts = F.array(*[F.lit(-(-counts.get(i, 0) // SALT_ROWS)) for i in range(len(files))])
    asked = inside.withColumn("salt", F.pmod(F.xxhash64(key), salts[F.col("home")]).cast("int"))
    filters = blooms(rows.where(salts[F.col("file")] > 0), key).withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("file")] - 1)))

    def test(left, right):
        return left.filter(_mask(may_hold(left.column(key).to_numpy(), right.column("bits")[0].as_py()))) if len(left) and len(right) else left.slice(0, 0)

    kept = asked.groupBy("home", "salt").cogroup(filters.groupBy("file", "salt")).applyInArrow(test, asked.schema)
    return kept.drop("salt")


def _mask(flags):
    import pyarrow as pa

    return pa.array(flags)


def layout(files: int, counts: dict[int, int], max_rows: int) -> list[int | None]:
    """Sizes of the files in key order after rewriting those in ``counts`` (file -> rows it now has); None
    stands for a file left alone.  A rewritten file becomes the fewest of at most ``max_rows`` rows, sizes
    at most one apart and larger first; then each joins its left neighbour where both are rewritten and
    fit into one."""
    out: list[int | None] = []
    for f in range(files):
        if f not in counts:
            out.append(None)
            continue
        n, k = counts[f], -(-counts[f] // max_rows)
        for size in (n // k + (j < n % k) for j in range(k)):
            if out and out[-1] is not None and out[-1] + size <= max_rows:
                out[-1] += size
            else:
                out.append(size)
    return out


def upsert(spark: SparkSession, folder: str, schema, files: list[File], changes: DataFrame, key: str, values: list[str], max_rows: int) -> list[File]:
    """Apply ``changes (key, home, gone boolean, *values)``, one row a key, to the table of ``files`` in
    ``folder`` -> its files in key order.

    A key that is ``gone`` loses its rows; another gets ``values`` (nulls too), as a new row if it is absent,
    whose other columns are null.  The table's columns may have any names; in ``changes``, ``home`` and ``gone`` are
    taken.  Equal values, nulls included, alter nothing.  Null keys are ignored.
    If the table repeats a key, a change meets all its rows.  Files without an altered row are left alone, path and all.
    """
    place = {f.name: f"c{i}" for i, f in enumerate(schema.fields)}  # the table's columns may have any names
    k, kept = place[key], [place[v] for v in values]
    names = spark.createDataFrame([(i, f.name) for i, f in enumerate(files)], "file int, name string")

    def of(which: list[int], columns: list[str]) -> DataFrame:
        """Columns of some files' rows, by place, with the file's number."""
        picked = [F.col(f"`{c}`").alias(place[c]) for c in columns]
        if not which:
            return spark.createDataFrame([], schema).select(*picked, F.lit(None).cast("int").alias("file"))
        t = spark.read.schema(schema).parquet(*[files[i].path for i in which]).select(*picked, F.col("_metadata.file_name").alias("name"))
        return t.join(F.broadcast(names), "name").drop("name")  # one row a file is broadcast

    changes = changes.where(F.col(key).isNotNull()).select(F.col(key).alias(k), "home", "gone", *[F.col(f"`{v}`").alias(place[v]) for v in values])
    changes = materialize(changes, "changes")
    deletes = prune_deletes(changes.where("gone"), files, of(list(range(len(files))), [key]).select("file", k), k)
    left = materialize(deletes.unionByName(changes.where("not gone")), "changes-left")
    homes = {r["home"] for r in left.select("home").distinct().collect()}  # at most one row a file
    for h in list(homes):  # a repeated key may end the files before
        while h and h < len(files) and files[h - 1].last is not None and files[h - 1].last == files[h].first:
            h -= 1
            homes.add(h)
    new = left.select(k, "home", "gone", *[F.col(v).alias(f"new_{v}") for v in kept])
    met = new.join(of(sorted(h for h in homes if h < len(files)), [key, *values]), k, "left")
    same = F.lit(True)
    for v in kept:
        same = same & F.col(v).eqNullSafe(F.col(f"new_{v}"))
    absent = F.col("file").isNull()
    altered = F.when(F.col("gone"), ~absent).otherwise(absent | ~same)
    effects = materialize(met.where(altered).select(k, "gone", *[f"new_{v}" for v in kept], F.coalesce("file", "home").alias("file"), absent.alias("added")), "effects")
    touched = sorted(r["file"] for r in effects.select("file").distinct().collect())  # at most one row a file
    if touched:
        columns = list(place.values())
        one = effects.where("not added").dropDuplicates([k]).select(F.col(k).alias("k"), "gone", *[f"new_{v}" for v in kept])
        old = of([t for t in touched if t < len(files)], list(place))
        mixed = old.join(one, F.col(k) == F.col("k"), "left").where(F.coalesce(~F.col("gone"), F.lit(True)))
        merged = mixed.select("file", *[F.when(F.col("k").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in columns])
        added = effects.where("added").select("file", *[F.col(f"new_{c}").alias(c) if c in kept else F.col(c) if c == k else F.lit(None).cast(schema[i].dataType).alias(c) for i, c in enumerate(columns)])
        rows, rank = _numbered(merged.unionByName(added), "file", k)
        counts = {t: 0 for t in touched} | dict(rows.groupBy("file").count().collect())
        at, starts = 0, []
        for size in layout(max(len(files), 1), counts, max_rows):
            if size is not None:
                starts.append(at)
                at += size
        if starts:
            _write(rows, rank, starts, [F.col(c).alias(name) for name, c in place.items()], folder)
        for t in touched:
            if t < len(files):
                delete(spark, files[t].path)
    return footers(spark, _listed(spark, folder, schema), key)


def winners(changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each key's changes the one highest by ``order`` (nulls lowest), then by all its columns."""
    best = F.max(F.struct(*order, *columns)).alias("w")
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "w.*")


def digests(spark: SparkSession, folder: str, schema, key: str, cents: str, texts: list[str]) -> DataFrame:
    """-> (name, n_rows, cents, rows_crc, ids_sha256) per file, its rows in file order."""
    line = []
    for t in texts:
        line += [F.lit("|"), F.coalesce(F.col(t).cast("string"), F.lit(""))]
    rows = spark.read.schema(schema).parquet(folder).select(
        F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("i"), F.col(key).cast("string").alias("k"),
        F.coalesce(F.floor(F.col(cents) * 100 + 0.5), F.lit(0)).cast("long").alias("cents"), F.crc32(F.concat(*line[1:])).alias("crc"),
    )

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        kind = [("name", pa.string()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((name, *sums, sha.hexdigest()), kind)], schema=pa.schema(kind))

        name = None
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.nonzero(np.diff(codes))[0] + 1, len(codes)] if len(codes) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(int(a), int(b - a))
                if part.column(0)[0].as_py() != name:
                    if name is not None:
                        yield row()
                    name, sums, sha = part.column(0)[0].as_py(), [0, 0, 0], hashlib.sha256()
                sha.update((("," if sums[0] else "") + ",".join(x or "" for x in part.column(2).to_pylist())).encode())
                sums = [sums[0] + len(part), sums[1] + int(part.column(3).to_numpy().sum()), sums[2] + int(part.column(4).to_numpy().sum())]
        if name is not None:
            yield row()

    return map_arrow(rows.repartition("name").sortWithinPartitions("name", "i"), run, "name string, n_rows long, cents long, rows_crc long, ids_sha256 string")


VALUES = ["source", "segment", "city", "balance"]


def op11(spark, sf_dir: str) -> DataFrame:
    """Without a starting file nothing has a home, so no change applies.  Rows of ``clients`` without an id
    fail its filter."""
    clients, changes = read(spark, sf_dir, "clients"), read(spark, sf_dir, "client_changes")
    max_rows = 1 + clients.count() // 1000
    folder = new_path(spark, "clients")
    files = write_sorted(clients.where("crc32(cast(client_id as string)) % 7 > 3"), folder, "client_id", max_rows)
    best = with_home(winners(changes, "client_id", ["seq", "change_id"], ["op", *VALUES]), files, "client_id")
    h = F.array(*[F.lit(None if f.first is None else zlib.crc32(str(f.first).encode()) % 16).cast("int") for f in files] or [F.lit(None).cast("int")])[F.col("home")]
    due = best.withColumn("h", h).where("h <= 7").selectExpr("client_id", "home", "coalesce(op = 'D', false) or coalesce(crc32(cast(change_id as string)) % 8 < h, false) as gone", *VALUES)
    before = {f.path for f in files}
    after = upsert(spark, folder, clients.schema, files, due, "client_id", VALUES, max_rows)
    known = spark.createDataFrame([(f.name, f.first, f.columns, f.path.removeprefix("file://"), f.path not in before) for f in after], "name string, first_id long, columns string, path string, rewritten boolean")
    out = digests(spark, folder, clients.schema, "client_id", "balance", ["source", "segment", "city"])
    return known.join(out, "name").select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten")
