"""Property graph as two tables: nodes (id, type, label, props) and edges (src, dst, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.storage import materialise


def build_nodes(parts: list[DataFrame]) -> DataFrame:
    """One row a node id; where sources disagree, the least (type, label) stands."""
    x = reduce(lambda a, b: a.unionByName(b), parts)
    return x.groupBy("id").agg(F.min(F.struct("type", "label")).alias("x")).select("id", "x.type", "x.label")


def build_edges(parts: list[DataFrame], nodes: DataFrame, dangling: str = "drop") -> DataFrame:
    """Distinct edges; those with an unknown end are dropped, or kept if ``dangling`` is ``keep``."""
    e = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    if dangling == "keep":
        return e
    ids = nodes.select("id")
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def unknown_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of type ``unknown`` for edge ends that no source describes."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.join(nodes, "id", "left_anti").select("id", F.lit("unknown").alias("type"), F.col("id").alias("label"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(id, hop): nodes within ``hops`` of the start ids, ignoring direction; one join and one anti-join a hop."""
    both = _both_ways(edges)
    seen = start.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        front = materialise(nxt.join(seen, "id", "left_anti").withColumn("hop", F.lit(h)), "hop")
        seen = seen.union(front)
    return seen


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    one = ids.select("id")
    return edges.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi")


def fuzzy_find(nodes: DataFrame, fragment: str) -> DataFrame:
    """First node (by id) whose id or label contains the fragment."""
    return nodes.filter(F.contains("id", F.lit(fragment)) | F.contains("label", F.lit(fragment))).orderBy("id").limit(1)


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(length, path): one shortest path of any length, ignoring direction; of equals the first in the order of its nodes. Empty if none.

    A search from both ends, each hop of the smaller front; what is kept of a hop is a table of its nodes and their distance. When the
    fronts meet, the nodes on shortest paths are those whose distances from both ends add up to the length, found backwards
    from the meeting, a join a hop; the path is then walked from the source, one row of the next hop at a time.
    """
    spark = edges.sparkSession
    both = materialise(_both_ways(edges), "path-edges")
    empty = spark.createDataFrame([], "length int, path string")
    ends = spark.createDataFrame([(source,), (target,)], "id string").distinct()
    known = ends.join(both, ends["id"] == both["src"], "left_semi").count()
    if source == target:
        return spark.range(known).select(F.lit(0).alias("length"), F.lit(source).alias("path"))
    if known < 2:
        return empty
    sides = [[spark.createDataFrame([(x,)], "id string")] for x in (source, target)]  # the nodes at 0, 1, ... hops from each end
    seen, sizes = [side[0] for side in sides], [1, 1]
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1
        front = sides[k][-1]
        step = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        front = materialise(step.join(seen[k], "id", "left_anti"), "path-front")
        sizes[k], met = front.join(sides[1 - k][-1].withColumn("_met", F.lit(1)), "id", "left").agg(F.count(F.lit(1)), F.count("_met")).first()
        if not sizes[k]:
            return empty
        sides[k].append(front)
        seen[k] = seen[k].union(front)
        if len(sides[k]) % 16 == 0:
            seen[k] = materialise(seen[k], "path-seen")
        if met:
            break
    # layers from the source: those of its side, and beyond the meeting those of the other side, nearest first
    a, b = sides
    onto = materialise(a[-1].join(b[-1], "id", "left_semi"), "path-layer")
    layers = [onto]
    for own in reversed(a[:-1]):
        before = layers[0].join(both, layers[0]["id"] == both["dst"]).select(F.col("src").alias("id")).distinct()
        layers.insert(0, materialise(before.join(own, "id", "left_semi"), "path-layer"))
    for own in reversed(b[:-1]):
        after = layers[-1].join(both, layers[-1]["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        layers.append(materialise(after.join(own, "id", "left_semi"), "path-layer"))
    path = [source]
    for own in layers[1:]:
        # every node of a layer lies on a shortest path to the source; the least next one need not lead on to the target if it was
        # reached from the source's side only, but layers before the meeting were found backwards from it
        path.append(both.filter(F.col("src") == path[-1]).select(F.col("dst").alias("id")).join(own, "id", "left_semi").agg(F.min("id")).first()[0])
    return spark.createDataFrame([(len(path) - 1, ">".join(path))], "length int, path string")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def most_connected(nodes: DataFrame, edges: DataFrame, kind: str, n: int = 5) -> DataFrame:
    return degrees(edges).join(nodes.filter(F.col("type") == kind), "id").orderBy(F.desc("degree"), "id").limit(n).select("id", "degree")


def impact(nodes: DataFrame, edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """Number of nodes of each type around the start."""
    return neighbourhood(edges, start, hops).filter("hop > 0").join(nodes, "id").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges by type, and the density m / (n (n - 1))."""
    n = nodes.groupBy("type").count().select(F.lit("node").alias("kind"), "type", F.col("count").cast("double").alias("value"))
    e = edges.groupBy("type").count().select(F.lit("edge"), "type", F.col("count").cast("double"))
    size = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))
    d = size.select(F.lit("density"), F.lit("all"), F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))
    return n.union(e).union(d)
