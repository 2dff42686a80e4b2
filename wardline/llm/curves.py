"""Approximate nearest neighbours on shifted Hilbert curves.

For each curve, unit vectors are projected onto a few random orthonormal directions, shifted, put on a grid and
ordered by their place on a Hilbert curve. Each curve is cut into ``spans`` key ranges of about equal numbers of
vectors; a query searches its own range and the two beside it, and the best of all curves are merged and scored again.

The width of a range is a share of the data, since that share is what fixes the recall when vectors are spread in
all directions: with random vectors of 64 dimensions the fifth neighbour's cosine is about 0.4, and no ordering finds
nine tenths of such neighbours in narrow windows. Data of low dimension allow more spans and fewer curves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.vectors import matrix, scaled, unit, usable
from wardline.storage import materialise

CURVES, SPANS, DIMS, BITS, ROWS, ASKED, SALTS = 12, 16, 8, 7, 4096, 4096, 64


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid points (whole numbers below 2**bits), by Skilling's transform."""
    x = x.astype(np.uint64)
    d = x.shape[1]
    for k in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << k), np.uint64((1 << k) - 1)
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap if i else 0
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.uint64)
    for k in range(bits - 1, 0, -1):
        t ^= np.where(x[:, d - 1] & np.uint64(1 << k), np.uint64((1 << k) - 1), np.uint64(0))
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for k in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | x[:, i] >> np.uint64(k) & np.uint64(1)
    return key.view(np.int64)


def curve_keys(x: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors on one curve: own projection, own shift."""
    rng = np.random.default_rng([88, curve])
    dims = min(dims, x.shape[1])
    turn = np.linalg.qr(rng.normal(size=(x.shape[1], dims)))[0]
    y = (x @ turn * (x.shape[1] ** 0.5 / 8) + 1 + rng.uniform(0, 0.5, dims)) / 2.5
    return hilbert_keys(np.clip(y * (1 << bits), 0, (1 << bits) - 1), bits)


def _with_keys(rows: DataFrame, curves: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.groupby("dim"):
                x = matrix(b["embedding"])
                yield b.assign(keys=list(np.stack([curve_keys(x, c) for c in range(curves)], axis=1)))

    return rows.mapInPandas(each, T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def _best(x: np.ndarray, v: np.ndarray, ids: list, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of x, ids, scores) of the ``most`` nearest rows of ``v``; ``ids``: of each row of v, ascending. Ties go to smaller ids.

    Unit vectors only choose whom to score: parallel vectors may differ in their last digits, dot(a, b) / sqrt(dot(a, a) dot(b, b)) does not.
    """
    near_x, near_v, size = unit(x), unit(v), (v * v).sum(axis=1)
    for i in range(0, len(x), 512):
        near = near_x[i : i + 512] @ near_v.T
        some = min(most, near.shape[1])
        least = np.partition(near, near.shape[1] - some, axis=1)[:, near.shape[1] - some]
        for r in range(len(near)):
            # all ties of the last one taken, with room for the product's rounding; then the smallest ids of each score
            cols = np.flatnonzero(near[r] >= least[r] - 1e-9)
            exact = (v[cols] * x[i + r]).sum(axis=1) / np.sqrt(size[cols] * (x[i + r] * x[i + r]).sum())
            own = np.concatenate([np.asarray(ids[j], dtype=np.int64) for j in cols])
            score = np.repeat(exact, [len(ids[j]) for j in cols])
            order = np.lexsort((own, -score))[:most]
            yield i + r, own[order], score[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, curves: int = CURVES, spans: int = SPANS, rows: int = ROWS, asked_rows: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by cosine of each row of ``queries``, itself excepted.

    Both tables: (vec_id, embedding); further columns are ignored. Unusable vectors (null, zero, null or non-finite
    components) take no part, as queries too, and vectors of different dimensions don't meet. Equal vectors are searched once and
    stand for their k + 1 smallest ids; equal queries are asked once. Ties go to the smaller id. Rows with a null vec_id take no part.
    Empty tables give an empty table. A task's group holds about ``rows`` stored vectors and ``asked_rows`` queries.
    """
    good = usable(vectors).filter("vec_id is not null")
    # the k + 1 smallest ids of each salt of an equal vector, then of all salts: no list is longer than that
    salted = Window.partitionBy("h", "g", "salt").orderBy("vec_id")
    some = good.withColumn("salt", F.pmod("vec_id", F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    nodes = some.groupBy("h", "g").agg(F.first("embedding").alias("embedding"), F.first("dim").alias("dim"), ids.alias("ids")).drop("h", "g")
    base = materialise(_with_keys(nodes, curves), "curve-nodes")
    wanted = usable(queries).filter("vec_id is not null")
    once = wanted.groupBy("embedding").agg(*(F.first(c).alias(c) for c in ("dim", "h", "g"))).withColumn("q", F.monotonically_increasing_id())
    asked = materialise(_with_keys(once, curves), "curve-queries")

    cuts = base.agg(*[F.percentile_approx(F.col("keys")[c], [j / spans for j in range(1, spans)], 20_000).alias(f"c{c}") for c in range(curves)]).first()
    at = lambda c: F.size(F.filter(F.array(*[F.lit(int(v)) for v in (cuts[c] or [])]).cast("array<long>"), lambda v: v < F.col("keys")[c]))
    place = F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), at(c).alias("span")) for c in range(curves)]))
    where = ["dim", "curve", "span"]
    stored = base.withColumn("p", place).select("dim", "p.curve", "p.span", "ids", "embedding")
    sought = asked.withColumn("p", place).select("dim", "p.curve", F.explode(F.array(*[F.col("p.span") + F.lit(o) for o in (-1, 0, 1)])).alias("span"), "q", "embedding")
    # into how many parts a span's stored vectors and its queries go: each part meets each
    parts = lambda df, most, name: df.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    plan = materialise(parts(stored, rows, "n").join(parts(sought, asked_rows, "m"), where), "curve-parts")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = stored.join(plan, where).select(*where, F.pmod(F.xxhash64("embedding"), F.col("n")).cast("int").alias("part"), each("m").alias("turn"), F.lit(None).cast("long").alias("q"), "ids", "embedding")
    sought = sought.join(plan, where).select(*where, each("n").alias("part"), F.pmod(F.xxhash64("q"), F.col("m")).cast("int").alias("turn"), "q", F.lit(None).cast("array<long>").alias("ids"), "embedding")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        ask = g["q"].notna().to_numpy()
        q, ids = g["q"][ask].astype("int64").to_numpy(), g["ids"][~ask].tolist()
        found = [(np.full(len(own), q[r]), own, score) for r, own, score in _best(scaled(g["embedding"][ask]), scaled(g["embedding"][~ask]), ids, k + 1)] if len(q) and len(ids) else []
        out = [np.concatenate(x) for x in zip(*found)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("q", "vec_id", "score"), out))).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    found = stored.union(sought).groupBy(*where, "part", "turn").applyInPandas(search, "q long, vec_id long, score double")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "vec_id"]
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("r") <= k + 1)
    top = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("t"))
    top = materialise(asked.select("q", "h", "g").join(top, "q").select("h", "g", "t"), "curve-answers")
    each_query = wanted.select(F.col("vec_id").alias("query_id"), "h", "g").join(top, ["h", "g"]).dropDuplicates(["query_id", "h", "g"])
    own = F.slice(F.filter("t", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each_query.select("query_id", F.posexplode(own).alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
