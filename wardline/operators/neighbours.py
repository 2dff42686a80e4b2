"""Exact nearest neighbours through pivots and the triangle inequality.

Base vectors are put with the nearest of at most PIVOTS pivots; a part is the vectors of one pivot, and its shell the least and
greatest distance to it. By the triangle inequality a query at distance d from a pivot is no nearer to any vector of the part than
``max(0, d - greatest, least - d)``. A query first searches the nearest parts that hold k vectors; the k-th best found bounds
what can still matter, and a second round visits only parts that can beat it. Parts are searched in chunks of a bounded number of
vectors and of queries, in tasks that return k rows a query. What the driver and every task hold are the pivots and one row a part.

Cosine goes by unit vectors, whose squared distance is twice 1 - cosine. How many parts can be left out depends on the data: few
if vectors are spread evenly in many dimensions, most if they lie in groups; ``visits`` tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.storage import materialise

PIVOTS, CHUNK, ASKED, SLACK = 256, 1024, 1024, 1e-7  # slack: of distances, for the rounding of the bounds


def _usable(vectors: DataFrame, key: str, name: str, metric: str) -> DataFrame:
    """(name, e) of vectors without null or non-finite components, for cosine not zero."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e150)) & (F.size(e) > 0)
    good = good & F.exists(e, lambda c: F.abs(c) > 1e-150) if metric == "cosine" else good
    return vectors.select(F.col(key).alias(name), e.alias("e")).filter(F.coalesce(good, F.lit(False)))


def _matrix(column: pd.Series, metric: str) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if metric == "cosine" else x


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0.0))


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The measure itself, summed in the order of the components, so that equal vectors get equal distances in any task."""
    dot = lambda a, b: np.add.accumulate(a * b, axis=-1)[..., -1]
    if metric == "cosine":
        return 1 - dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))
    return dot(q, q) + dot(v, v) - 2 * dot(q, v)


class PivotIndex:
    """Base vectors of one dimension in parts around pivots; vectors of other dimensions than most take part in an index of their own."""

    def __init__(self, base: DataFrame, metric: str = "cosine", base_key: str = "base_id", pivots: int = PIVOTS, chunk: int = CHUNK):
        """``base``: (base_key, embedding)."""
        self.metric, self.chunk = metric, chunk
        rows = _usable(base, base_key, "b", metric).withColumn("dim", F.size("e"))
        sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row a dimension
        self.pivots: dict[int, np.ndarray] = {}
        for dim, n in sizes.items():
            most = max(1, min(pivots, round(n**0.5 / 2)))
            some = rows.filter(F.col("dim") == dim).select("e", F.xxhash64("e").alias("h")).orderBy("h").limit(most).collect()
            self.pivots[dim] = _matrix(pd.Series([r["e"] for r in some]), metric)
        held, metric_ = self.pivots, metric

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, g in batch.groupby("dim"):
                    far = _apart(_matrix(g["e"], metric_), held[dim])
                    part = far.argmin(axis=1)
                    yield g.assign(part=part.astype(np.int32), far=far[np.arange(len(g)), part])

        kind = dict(rows.dtypes)["b"]
        self.rows = materialise(rows.mapInPandas(place, f"b {kind}, e array<double>, dim int, part int, far double"), "pivot-parts")
        stats = self.rows.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
        self.shells = {dim: sorted((r["part"], r["n"], r["low"], r["high"]) for r in stats if r["dim"] == dim) for dim in held}  # a row a part
        self.kind = kind

    def _planned(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries with the parts of the first round, and of every other part the least distance it may hold: (q, e, dim, parts, others, bounds)."""
        pivots, shells, metric = self.pivots, self.shells, self.metric

        def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, g in batch.groupby("dim"):
                    if dim not in shells:
                        continue
                    own, n, low, high = (np.array(x) for x in zip(*shells[dim]))
                    far = _apart(_matrix(g["e"], metric), pivots[dim])[:, own]
                    bound = np.maximum(np.maximum(far - high, low - far), 0.0)
                    order = np.argsort(far, axis=1, kind="stable")
                    first = np.array([int(np.searchsorted(np.cumsum(n[o]), k)) + 1 for o in order])
                    parts = [own[o[:c]].tolist() for o, c in zip(order, first)]
                    others = [own[o[c:]].tolist() for o, c in zip(order, first)]
                    yield g.assign(parts=parts, others=others, bounds=[x[o[c:]].tolist() for x, o, c in zip(bound, order, first)])

        return queries.mapInPandas(plan, "q long, e array<double>, dim int, parts array<int>, others array<int>, bounds array<double>")

    def _searched(self, visits: DataFrame, k: int) -> DataFrame:
        """(q, b, distance): of every visit (q, e, dim, part) the k + 1 best of each chunk of the part."""
        where, metric, chunk = ["dim", "part"], self.metric, self.chunk
        sizes = self.rows.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n"))
        turns = visits.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("m"))
        plan = materialise(sizes.join(turns, where), "pivot-plan")  # a row a part
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        stored = self.rows.join(plan, where).select(*where, F.pmod(F.xxhash64("b", "e"), F.col("n")).cast("int").alias("piece"), each("m").alias("turn"), F.lit(None).cast("long").alias("q"), "b", "e")
        sought = visits.join(plan, where).select(*where, each("n").alias("piece"), F.pmod(F.xxhash64("q"), F.col("m")).cast("int").alias("turn"), "q", F.lit(None).cast(self.kind).alias("b"), "e")

        def search(g: pd.DataFrame) -> pd.DataFrame:
            ask = g["q"].notna().to_numpy()
            asked, v = g[ask], g[~ask].sort_values("b", kind="stable", na_position="first")
            out = []
            if len(asked) and len(v):
                x, y = np.stack([np.asarray(e) for e in asked["e"]]), np.stack([np.asarray(e) for e in v["e"]])
                near = _apart(_matrix(asked["e"], metric), _matrix(v["e"], metric))
                some = min(k + 1, len(v))
                last = np.partition(near, some - 1, axis=1)[:, some - 1]
                ids = v["b"].to_numpy()
                for r, q in enumerate(asked["q"].astype("int64")):
                    cols = np.flatnonzero(near[r] <= last[r] + SLACK)  # all ties of the last, and what rounding may have put behind it
                    exact = _exact(x[r], y[cols], metric)
                    best = np.argsort(exact, kind="stable")[: k + 1]  # ids ascend
                    out.append(pd.DataFrame({"q": q, "b": ids[cols[best]], "distance": exact[best]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], "b": [], "distance": []}).astype({"q": "int64", "distance": "float64"})

        return stored.union(sought).groupBy(*where, "piece", "turn").applyInPandas(search, f"q long, b {self.kind}, distance double")

    def rounds(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """((q, b, distance) found, (q, visited, parts)) for ``queries`` (q long, embedding): k + 1 rows of each query at least, if there are."""
        asked = materialise(self._planned(_usable(queries, "q", "q", self.metric).withColumn("dim", F.size("e")), k + 1), "pivot-queries")
        first = materialise(self._searched(asked.select("q", "e", "dim", F.explode("parts").alias("part")), k), "pivot-found")
        order = Window.partitionBy("q").orderBy("distance")
        last = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("q").agg(F.max("distance").alias("reach"))
        reach = F.sqrt(F.greatest(2 * F.col("reach") if self.metric == "cosine" else F.col("reach"), F.lit(0.0)))
        rest = asked.join(last, "q").select("q", "e", "dim", "parts", F.filter(F.arrays_zip("others", "bounds"), lambda x: x["bounds"] <= reach * (1 + SLACK) + SLACK).alias("open"))
        rest = materialise(rest, "pivot-open")
        second = self._searched(rest.select("q", "e", "dim", F.explode("open.others").alias("part")), k)
        visits = rest.select("q", (F.size("parts") + F.size("open")).alias("visited"), "dim")
        total = F.create_map(*[F.lit(x) for d, s in self.shells.items() for x in (d, len(s))]) if self.shells else F.lit(None).cast("map<int,int>")
        return first.union(second), visits.select("q", "visited", total[F.col("dim")].alias("parts"))
