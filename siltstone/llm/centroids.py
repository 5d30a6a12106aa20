"""Centroid clustering: exact integer k-means whose assignment is sort-means.

A round is one narrow pass.  A vector starts from the centroid it was assigned to; the others are
scanned by their distance from that one, and the scan stops strictly beyond twice the vector's
distance from it, for by the triangle inequality no farther centroid can be nearer, or as near.
Squared distances are integers, so ties are exact.  The pass writes vectors, assignments and, at the end of
each task, the task's componentwise sums, so a round reads the vectors once and shuffles K rows a task.
The last round's table replaces the one before it in the shared folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import delete, new_path, read

K, DIM, ROUNDS, SCALE = 8, 64, 10, 1024
#: Integer components are held within this bound, so that a squared distance fits in a long.
MOST = 1 << 27
ROW = "id long, vec array<int>, cluster int, distance long, n long, sums array<long>"


def quantised(dim: int, scale: int):
    """Arrow batches (id, vector of doubles) -> (id, floor(scale * x)) of the vectors that count."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(1)
            # a vector counts if it has ``dim`` components, none null
            keep = [i for i, v in enumerate(vectors) if v.values is not None and len(v.values) == dim and not v.values.null_count]
            if not keep:
                continue
            at = pa.array(keep, pa.int32())
            x = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), dim)
            fine = np.isfinite(x).all(axis=1)
            q = np.clip(np.floor(np.clip(x[fine], -MOST, MOST) * scale), -MOST, MOST).astype(np.int32)
            ids = batch.column(0).take(at).filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(np.arange(0, q.size + 1, dim, dtype=np.int32), pa.array(q.ravel()))], names=["id", "vec"])

    return run


def squared(x, c):
    """Row-wise squared distances of integers from one point."""
    d = x - c
    return (d * d).sum(axis=1)


def assign(x, previous, centroids):
    """(n, dim) integers, each row's former centroid -> (nearest centroid, squared distance); ties go
    to the smaller number."""
    import numpy as np

    cluster, distance = previous.copy(), np.zeros(len(x), np.int64)
    between = np.stack([squared(centroids, c) for c in centroids])
    for a in np.unique(previous):
        rows = np.nonzero(previous == a)[0]
        own = squared(x[rows], centroids[a])
        best, at = own.copy(), np.full(len(rows), a)
        others = [j for j in np.argsort(between[a], kind="stable") if j != a]
        left = np.arange(len(rows))
        for j in others:
            left = left[between[a, j] <= 4 * own[left]]  # strictly beyond twice the distance the scan is over
            if not len(left):
                break
            d = squared(x[rows[left]], centroids[j])
            nearer = (d < best[left]) | ((d == best[left]) & (j < at[left]))
            best[left[nearer]], at[left[nearer]] = d[nearer], j
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def _round(centroids, sums: bool):
    """Arrow batches (id, vec, cluster) -> rows of ROW: the vectors assigned anew and, at the end,
    this task's counts and sums by cluster."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        k, dim = centroids.shape
        schema = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim).astype(np.int64)
            cluster, distance = assign(x, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), centroids)
            if sums:
                for j in np.unique(cluster):
                    total[j] += x[cluster == j].sum(axis=0)
                count += np.bincount(cluster, minlength=k)
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema.field("vec").type), pa.array(cluster.astype(np.int32)), pa.array(distance), none, pa.nulls(len(batch), pa.list_(pa.int64()))], schema=schema)
        some = np.nonzero(count)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), schema.field("vec").type), pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], schema=schema)

    return run


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: str = "3"):
    """-> (assignments (id, cluster, distance), centroids as lists of integers).

    Vectors of other widths, null ones and those with null or non-finite components are left out;
    components beyond the bound MOST after scaling are taken as MOST.  Each row is a vector of its own:
    equal rows and rows that share an id each count.  The first centroids are the ``k`` vectors whose
    text ``seed:id`` has the smallest SHA-256, of one id those with smaller components first; a null id
    counts as empty text.  Fewer vectors give as many centroids; none give no rows.  Other columns
    are ignored.  Ids are integers.
    """
    import numpy as np

    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    path = new_path(spark, "kmeans")
    map_arrow(src, quantised(dim, scale), "id long, vec array<int>").selectExpr("id", "vec", "0 as cluster").write.parquet(path)
    points = spark.read.schema("id long, vec array<int>, cluster int").parquet(path)
    first = points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "vec")
    centroids = np.array([r["vec"] for r in first.orderBy("h", "vec").limit(k).collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return points.selectExpr("id", "cluster", "cast(0 as long) as distance"), []
    for t in range(rounds + 1):
        last, path = path, new_path(spark, "kmeans")
        map_arrow(points.select("id", "vec", "cluster"), _round(centroids, t < rounds), ROW).write.parquet(path)
        delete(spark, last)
        table = spark.read.schema(ROW).parquet(path)
        points = table.where("n is null")
        if t < rounds:
            parts = table.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
            sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
            for r in sums:  # k * dim rows; an empty cluster has none and stays
                centroids[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return points.select("id", "cluster", "distance"), centroids.tolist()


def op13(spark, sf_dir: str) -> DataFrame:
    found, centroids = fit(read(spark, sf_dir, "embeddings"))
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    rows = [(j, sums.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sizes = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sizes), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
