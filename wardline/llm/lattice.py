"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected onto eight random orthonormal directions per table, scaled, and decoded to the nearest
point of the E8 lattice. A vector is stored in its own cell and also probes the neighbouring cells (of the 240 around
it) that it lies closest to. Pairs that meet in a cell are verified by cosine in double precision.

Equal vectors are one node with a count. Cells are walked one at a time and give a spanning forest of their links;
larger cells are cut into chunks whose pairs go to different tasks, so none is skipped.
Components follow; links are then counted exactly within each component, again in pairs of chunks. Vectors are only
compared with vectors of as many components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import CHUNK, chunk_count, chunk_pairs, groups
from wardline.llm.vectors import is_usable, matrix, usable
from wardline.operators.components import connected_components
from wardline.storage import materialise, unclustered

COSINE, TABLES, PROBES, SCALE = 0.95, 8, 6, 8.0


def _around() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


AROUND = _around()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    z = np.rint(y)
    odd = np.flatnonzero(z.sum(axis=1) % 2)
    off = y[odd] - z[odd]
    worst = np.abs(off).argmax(axis=1)
    z[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return z


def nearest_e8(y: np.ndarray) -> np.ndarray:
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Keys of each row's own cell (first column) and of the ``probes`` neighbouring cells nearest to it."""
    rng = np.random.default_rng([77, table])
    d = x.shape[1]
    turn = np.linalg.qr(rng.normal(size=(d, 8)))[0] if d >= 8 else np.eye(8)[:d] @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    y = x @ turn * scale * (d / 64 if d > 64 else 1) ** 0.5 + rng.uniform(-1, 1, 8)
    z = nearest_e8(y)
    near = np.argsort(-((y - z) @ AROUND.T), axis=1, kind="stable")[:, :probes]
    points = np.concatenate([z[:, None], z[:, None] + AROUND[near]], axis=1)
    codes = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = np.full(codes.shape[:2], table + 1, dtype=np.uint64)
    for k in range(8):
        key = (key ^ codes[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _cell_rows(nodes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby("dim"):
                x, node = matrix(b["embedding"]), b["node"].to_numpy()
                for t in range(tables):
                    key = cells(x, t, probes, scale)
                    own = np.zeros(key.shape, dtype=bool)
                    own[:, 0] = True
                    yield pd.DataFrame({"dim": np.int32(dim), "key": key.ravel(), "node": np.repeat(node, key.shape[1]), "own": own.ravel()})

    return nodes.select("node", "dim", "embedding").mapInPandas(each, "dim int, key long, node long, own boolean")


def _forest(x: np.ndarray, node: np.ndarray, own: np.ndarray, part: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """Spanning forest of the links between vectors of which one at least is in its own cell."""
    edges, left = [], np.arange(len(node))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = (x[left] @ x[i] >= cosine) & (own[left] | own[i])
            if near.any():
                edges += [(int(node[i]), int(node[j])) for j in left[near]]
                front += list(left[near])
                left = left[~near]
    return edges


def links(nodes: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, chunk: int = CHUNK) -> DataFrame:
    """Verified links (a, b) among distinct vectors (node, dim, embedding), a spanning forest of each cell's."""
    rows = materialise(_cell_rows(nodes, tables, probes, scale), "lattice-cells")
    met = rows.groupBy("key", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).filter("n > 1 and any")
    met = met.select(unclustered("key"), "dim", "n")
    rows = chunk_pairs(rows.join(met, ["key", "dim"]), chunk_count(F.col("n"), chunk=chunk))
    keys = ["dim", "key", "a", "b"]
    rows = rows.select(*keys, "node", "own", "part").join(nodes.select("node", "embedding"), "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for g in groups(batches, keys):
            if len(g) > 1:
                out += _forest(matrix(g["embedding"]), g["node"].to_numpy(), g["own"].to_numpy(), g["part"].to_numpy(), cosine)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(walk, "a long, b long")


def _degrees(members: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """(node, links): how many vectors of its component each node is linked to, counting copies of the others."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select(unclustered("component"), "n")
    rows = chunk_pairs(members.join(sizes, "component"), chunk_count(F.col("n"), chunk=chunk))
    keys = ["component", "a", "b"]
    rows = rows.select(*keys, "node", "copies", "part", "embedding").repartition(*keys).sortWithinPartitions(*keys, "node")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, keys):
            x, n, part, node = matrix(g["embedding"]), g["copies"].to_numpy(), g["part"].to_numpy(), g["node"].to_numpy()
            if part[0] == 2:
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                yield pd.DataFrame({"node": node, "links": near @ n})
            else:
                p, q = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
                near = x[p] @ x[q].T >= cosine
                yield pd.DataFrame({"node": node[np.r_[p, q]], "links": np.r_[near @ n[q], near.T @ n[p]]})

    return rows.mapInPandas(walk, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding); further columns are ignored.

    A row is a vector of its own, whatever its vec_id: rows that share an id or have none are linked like others.
    ``component_id`` is the least known id of the rows reachable (null if none has one). Null, zero and non-finite
    vectors have no links and are their own component; vectors of different dimensions aren't linked. Copies are linked to each other
    whatever their number. A row without an id is not kept. An empty table gives an empty table.
    """
    good = usable(vectors)
    nodes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("dim", "h", "g")))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    comp = materialise(connected_components(materialise(links(nodes, cosine, tables, probes, scale, chunk), "lattice-links")), "lattice-components")
    members = materialise(nodes.join(comp, "node"), "lattice-members")
    degree = _degrees(members, cosine, chunk)
    roots = members.groupBy("component").agg(F.min("least").alias("component_id")).select(unclustered("component"), "component_id")
    linked = members.select("node", "component").join(roots, "component").join(degree, "node").select("node", "component_id", "links")
    named = nodes.select("node", "least", "copies", "h", "g").join(materialise(linked, "lattice-degrees"), "node", "left")
    # a component of one vector and its copies is named by them, a larger one by all its members
    name = F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("component_id"))
    named = materialise(named.select("h", "g", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), name.alias("component_id")), "lattice-named")
    out = good.join(named, ["h", "g"]).select("vec_id", "n_links", "component_id")
    own = F.col("vec_id").cast("long")
    rest = vectors.filter(~is_usable(F.col("embedding"))).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    out = out.union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), c AS (
  SELECT vec_id, vec_id AS comp FROM embeddings UNION SELECT l.b, c.comp FROM c JOIN l ON l.a = c.vec_id
), m AS (SELECT vec_id, min(comp) AS component_id FROM c GROUP BY 1)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, m.vec_id = component_id AS kept FROM m
"""


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
