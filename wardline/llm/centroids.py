"""Exact clustering around centroids with a distance matrix that is kept and updated.

Vectors are whole numbers, so every dot product with a centroid is exact. Each vector's row holds its dot products with
all centroids. When a centroid moves, only its nonzero component changes are multiplied in:
``dots[j] += sum(v[k] * change[j][k])``; the nearest centroid is the least ``|c_j|^2 - 2 dots[j]``. The rows are
written once a round, in the folder that all executors share; what reaches the driver is a sum a centroid and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.storage import drop_table, new_path

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
LARGEST = 1 << 27  # of a component: squared distances of 64 of them are below 2^62
_STATE = "vec_id long, v array<long>, dots array<long>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of just ``dims`` finite components as whole numbers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    fit = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.floor(c * scale).cast("double")) < LARGEST) & (F.abs(c) < LARGEST))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(fit, F.lit(False)))
    return own.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``clusters`` smallest sha256 of ``seed:vec_id``, in that order; equal ids by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in top], dtype=np.int64)


def _column(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column of lists of ``width`` numbers as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _assigned(rows: DataFrame, centroids: np.ndarray, change: np.ndarray, wide: bool) -> DataFrame:
    """The rows with their dots brought up to ``centroids``, which differ by ``change`` from those they were made with."""
    k, dims = centroids.shape
    moved = [(j, np.flatnonzero(change[j])) for j in range(k) if change[j].any()]
    squares = (centroids * centroids).sum(axis=1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _column(b, "v", dims)
            dots = _column(b, "dots", k).copy() if wide else np.zeros((len(v), k), dtype=np.int64)
            for j, at in moved:
                dots[:, j] += v[:, at] @ change[j, at]
            far = squares - 2 * dots
            near = far.argmin(axis=1)  # the first of equals
            distance = far[np.arange(len(v)), near] + (v * v).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), _lists(dots), pa.array(near, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "dots", "cluster", "distance"])

    return rows.mapInArrow(each, _STATE)


def _sums(rows: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of every cluster: at most a row a cluster and component, whatever the table's size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, own = _column(b, "v", dims), b.column("cluster").to_numpy()
            found = np.unique(own)
            sums = np.stack([v[own == j].sum(axis=0) for j in found]) if len(found) else np.zeros((0, dims), dtype=np.int64)
            count = np.array([(own == j).sum() for j in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(found)), pa.int32()), pa.array(np.repeat(count, dims), pa.int64()), pa.array(sums.ravel(), pa.int64())], ["cluster", "k", "n", "s"])

    parts = rows.select("cluster", "v").mapInArrow(each, "cluster int, k int, n long, s long")
    total = parts.groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(total.collect(), key=lambda r: (r["cluster"], r["k"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, dots, cluster, distance), final centroids) after ``rounds`` rounds and a last assignment.

    Vectors of another length, with a null or non-finite component, or with one beyond LARGEST / scale (its distances would not
    fit a long) take no part. A null vec_id counts as an empty one in the draw; repeated rows are rows of their own; fewer
    vectors than ``clusters`` give as many centroids; an empty table gives an empty table. Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], _STATE), np.zeros((0, dims), dtype=np.int64)
    change, path = centroids, None
    for r in range(rounds + 1):
        now = _assigned(rows, centroids, change, wide=r > 0)
        old, path = path, new_path(spark, "centroid-rows")
        now.write.parquet(path)
        rows = spark.read.schema(_STATE).parquet(path)
        if old:
            drop_table(spark, old)
        if r < rounds:
            after = centroids.copy()
            for j, (n, s) in _sums(rows, dims).items():
                after[j] = [x // n for x in s]
            centroids, change = after, after - centroids
    return rows, centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    names = [(j, ",".join(map(str, c.tolist()))) for j, c in enumerate(centroids)]
    own = spark.createDataFrame(names, "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    # a row a centroid: CLUSTERS at most, so they are broadcast and their total is a window over them
    per = per.crossJoin(per.agg(F.sum("s").alias("t"))).join(own, "cluster").select("cluster", F.expr("try_cast(s as long)").alias("cluster_inertia"), F.expr("try_cast(t as long)").alias("inertia"), "centroid_sha256")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    """Assignment to the centroids of round ``r``, and the centroids after it."""
    return f"""
, a{r} AS MATERIALIZED (
  SELECT v.vec_id, v.x, min({{'d': list_sum(list_transform(range(1, {DIMS} + 1), lambda k: (v.x[k] - c.x[k]) * (v.x[k] - c.x[k]))), 'j': c.j}}) AS m FROM v, c{r} AS c GROUP BY v.row, v.vec_id, v.x
), s{r} AS (SELECT m.j AS j, k, cast((sum(x[k]) - (sum(x[k]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM a{r}, range(1, {DIMS} + 1) AS t(k) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.x, c.x) AS x FROM c{r} AS c LEFT JOIN (SELECT j, list(f ORDER BY k) AS x FROM s{r} GROUP BY j) AS n USING (j))"""


def _oracle() -> str:
    head = f"""
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = {DIMS}
), v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda x: cast(floor(x * {SCALE}) AS BIGINT)) AS x
  FROM w WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS})
)"""
    body = "".join(_round_sql(r) for r in range(ROUNDS + 1))
    tail = f"""
SELECT vec_id, cast(m.j AS INTEGER) AS cluster, cast(m.d AS BIGINT) AS distance, cast(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia,
       cast(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} AS c ON c.j = m.j
"""
    return head + body + tail


ORACLE_OP13 = _oracle()
