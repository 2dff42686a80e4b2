"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations (map-side combined) and two equi-joins whose sides both end in a shuffle,
so adaptive execution can split a hub's partition. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.storage import drop_table, new_path, unclustered


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, m): least neighbour of each u, ready for a join that may be split."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(unclustered("u"), "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    ``edges``: two long columns (src, dst), any direction, repeats allowed. Rows with a null end and
    self-loops are ignored. No edges give an empty table.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    before, path = None, None
    for k in range(max_rounds):
        if k:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
            e = both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _min_neighbour(e)
        small = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, new_path(spark, "components")
        out.write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        if old:
            drop_table(spark, old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = now
    raise RuntimeError("components did not settle")
