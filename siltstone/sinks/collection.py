"""A keyed table with atomic commits: rows in buckets by hashed key, and numbered manifests.

A manifest names, for each bucket, the folder that holds its rows and how many there are.  A change writes the buckets
it touches into new folders, then creates the next manifest; the highest whole one is the table.  A change that
fails before has no effect, and of two that run at once one finds its number taken and fails.  Buckets that a
change doesn't touch are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import filesystem

BUCKETS = 64


class Conflict(Exception):
    """Another change was committed meanwhile."""


@dataclass
class Collection:
    spark: SparkSession
    path: str

    def _manifests(self) -> list[str]:
        fs, p = filesystem(self.spark, f"{self.path}/_manifests")
        return sorted((str(s.getPath()) for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []

    def manifest(self) -> dict | None:
        """The newest manifest that was written whole."""
        for path in self._manifests():
            fs, p = filesystem(self.spark, path)
            stream = fs.open(p)
            try:
                data = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            try:
                return json.loads(data)
            except ValueError:
                continue
        return None

    def exists(self) -> bool:
        return self.manifest() is not None

    def _commit(self, manifest: dict) -> None:
        fs, p = filesystem(self.spark, f"{self.path}/_manifests/{manifest['version']:020d}.json")
        data = json.dumps(manifest).encode()
        if fs.exists(p):
            raise Conflict(f"version {manifest['version']} is there")
        out = fs.create(p, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def init(self, schema: str | StructType, key: str = "id", buckets: int = BUCKETS) -> Collection:
        """An empty table, unless there is one."""
        if not self.exists():
            kind = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
            self._commit({"version": 0, "schema": kind.json(), "key": key, "buckets": buckets, "folders": {}, "rows": {}, "applied": {}})
        return self

    def drop(self) -> None:
        fs, p = filesystem(self.spark, self.path)
        fs.delete(p, True)

    def _schema(self, m: dict) -> StructType:
        return StructType.fromJson(json.loads(m["schema"]))

    def _rows(self, m: dict, buckets=None) -> DataFrame:
        folders = [f for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        schema = self._schema(m)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as it is now; later changes don't touch what this reads."""
        return self._rows(self._known())

    def _known(self) -> dict:
        m = self.manifest()
        if m is None:
            raise ValueError(f"no collection at {self.path}")
        return m

    def count(self) -> int:
        """Rows, from the manifest alone."""
        return sum(self._known()["rows"].values())

    def _bucket(self, m: dict):
        return F.expr(f"cast(pmod(xxhash64(`{m['key']}`), {m['buckets']}) as int)")

    def _change(self, m: dict, changed: DataFrame, merge, mark: tuple[str, int] | None) -> int:
        """Rewrite the buckets of ``changed`` (which has a column bucket__) by ``merge(old, new)``; -> how many."""
        touched = sorted(r[0] for r in changed.select("bucket__").distinct().collect())  # at most so many buckets
        if touched:
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            merged = merge(self._rows(m, set(touched)), changed.drop("bucket__")).withColumn("bucket__", self._bucket(m))
            merged.repartition("bucket__").write.partitionBy("bucket__").parquet(folder)
            rows = dict(self.spark.read.parquet(folder).groupBy("bucket__").count().collect()) if filesystem(self.spark, folder)[0].globStatus(filesystem(self.spark, f"{folder}/bucket__=*")[1]) else {}
            for b in map(str, touched):
                m["folders"].pop(b, None)
                m["rows"].pop(b, None)
                if int(b) in rows:
                    m["folders"][b], m["rows"][b] = f"{folder}/bucket__={b}", rows[int(b)]
        if mark:
            m["applied"][mark[0]] = mark[1]
        if touched or mark:
            self._commit(m | {"version": m["version"] + 1})
        return len(touched)

    def upsert(self, rows: DataFrame, order: str | None = None, mark: tuple[str, int] | None = None) -> int:
        """Insert rows or replace those of the same key; of a key's new rows the highest by ``order``, then by all
        columns, counts.  Rows without a key are left out.  -> how many buckets were rewritten."""
        m = self._known()
        names = self._schema(m).names
        new = rows.where(F.col(m["key"]).isNotNull())
        first = [F.col(order).alias("order__")] if order else []
        best = F.max(F.struct(*first, *names)).alias("w")
        new = new.groupBy(F.col(m["key"]).alias("k__")).agg(best).select(*[F.col("w")[n].alias(n) for n in names])
        return self._change(m, new.withColumn("bucket__", self._bucket(m)), lambda old, n: old.join(n.select(m["key"]), m["key"], "left_anti").select(*names).unionByName(n), mark)

    def delete(self, keys: DataFrame) -> int:
        """Take out the rows of ``keys`` (a column named as the key) -> how many buckets were rewritten."""
        m = self._known()
        names = self._schema(m).names
        gone = keys.where(F.col(m["key"]).isNotNull()).select(m["key"]).distinct()
        return self._change(m, gone.withColumn("bucket__", self._bucket(m)), lambda old, n: old.join(n, m["key"], "left_anti").select(*names), None)

    def vacuum(self) -> int:
        """Delete folders that the table no longer needs -> how many.  Readers of older versions must be done."""
        fs, p = filesystem(self.spark, f"{self.path}/data")
        keep = {f.rsplit("/", 2)[-2] for f in self._known()["folders"].values()}
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in keep] if fs.exists(p) else []
        for x in old:
            fs.delete(x, True)
        return len(old)

    def upsert_stream(self, points: DataFrame, checkpoint: str, order: str | None = None, name: str = "points"):
        """Every micro-batch of a stream as one change.  A batch that was committed before a restart is not
        applied again."""

        def apply(batch: DataFrame, epoch: int) -> None:
            if self._known()["applied"].get(name, -1) < epoch:
                self.upsert(batch, order, (name, epoch))

        return points.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
