"""Evaluation of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.patterns import ATTACK_TYPES
from wardline.functions.scalars import ratio
from wardline.storage import materialise


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("double")


def confusion(df: DataFrame, truth: str = "y", predicted: str = "p", by: list[str] | None = None, percent: bool = False) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 and false-positive rate, by group; 0 where undefined."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    g = df.groupBy(*(by or [])).agg(_n(t & p).alias("tp"), _n(~t & p).alias("fp"), _n(t & ~p).alias("fn"), _n(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    k = 100.0 if percent else 1.0
    return g.select(
        *(by or []), *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")), (ratio(tp + tn, tp + fp + fn + tn) * k).alias("accuracy"),
        (ratio(tp, tp + fp) * k).alias("precision"), (ratio(tp, tp + fn) * k).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"),
    )


def roc_auc(df: DataFrame, truth: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve by ranks over distinct scores; 0 with a single class.

    A prefix sum in two levels: the counts per distinct score are cut into ranges of scores, each range is summed, the
    ranges' sums are scanned (a row a range), and every range is scanned from what lies below it. So scores that are
    all different, without groups, are no one task's.
    """
    keys = by or []
    counts = df.groupBy(*keys, score).agg(_n(F.col(truth) == 1).alias("pos"), _n(F.col(truth) != 1).alias("neg"))
    counts = materialise(counts.repartitionByRange(score).withColumn("_range", F.spark_partition_id()), "auc-ranges")
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("neg").alias("neg")).select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("neg").over(over), F.lit(0.0)).alias("_base"))
    here = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("neg").over(here), F.lit(0.0)))
    same = F.col("_range") == F.col("_r")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ranked = ranked.join(ranges, same)
    g = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("_base") + F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.select(*keys, ratio(F.col("u"), F.col("np") * F.col("nn")).alias("auc"))


def per_class_recall(df: DataFrame, category: str = "category", predicted: str = "p") -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(predicted) == 1).alias("detected")).withColumn("recall", F.col("detected") / F.col("n"))


def recall_by_type(df: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """Recall per expected type, and how many were confirmed as any type or rejected."""
    known = df.filter(F.col(expected).isNotNull())
    return known.groupBy(expected).agg(
        F.count(F.lit(1)).alias("n"), _n(F.col(found) == F.col(expected)).cast("long").alias("hits"), _n(F.col(found) != "unknown").cast("long").alias("confirmed"),
        _n(F.col(found) == "unknown").cast("long").alias("rejected"),
    ).withColumn("recall", F.col("hits") / F.col("n"))


def type_outcomes(df: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """tp, fp, fn per type: a confusion of two types is a miss of one and a false alarm of the other."""
    e, f = F.col(expected), F.col(found)
    one = F.array_compact(F.array(
        F.when(e.eqNullSafe(f) & e.isNotNull(), F.struct(e.alias("type"), F.lit("tp").alias("o"))),
        F.when(e.isNotNull() & ~e.eqNullSafe(f), F.struct(e.alias("type"), F.lit("fn").alias("o"))),
        F.when(f.isNotNull() & (f != "unknown") & ~e.eqNullSafe(f), F.struct(f.alias("type"), F.lit("fp").alias("o"))),
    ))
    x = df.select(F.explode(one).alias("x")).select("x.type", "x.o")
    return x.groupBy("type").agg(*(F.count_if(F.col("o") == o).alias(o) for o in ("tp", "fp", "fn")))


def one_vs_rest(df: DataFrame, classes: dict[str, list[str]], truth: str = "category", found: str = "determination") -> DataFrame:
    """Confusion counts of each named detector: truth and finding fall in its classes or not."""
    rows = [F.struct(F.lit(k).alias("detector"), F.when(F.col(truth).isin(v), 1).otherwise(0).alias("y"), F.when(F.col(found).isin(v), 1).otherwise(0).alias("p")) for k, v in classes.items()]
    return confusion(df.select(F.explode(F.array(*rows)).alias("x")).select("x.*"), by=["detector"])


def calls_per_log(df: DataFrame, verdict: str = "verdict", kind: str = "anomaly_type") -> DataFrame:
    """Add ``calls``: the type's place in the serial order, 7 for normal rows, 1 for other types."""
    place = F.array_position(F.array(*(F.lit(t) for t in ATTACK_TYPES)), F.col(kind))
    return df.withColumn("calls", F.when(F.col(verdict) == "normal", 7).when(place > 0, place).otherwise(1).cast("long"))


def call_cost(df: DataFrame, reached: str = "suspicious", calls: str = "calls") -> DataFrame:
    """Calls that a full run would take, that were taken and saved, and their rates in percent."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(reached)).alias("cleared"), F.sum(F.when(F.col(reached), F.col(calls)).otherwise(0)).alias("actual"))
    rate = F.coalesce(ratio(F.col("actual").cast("double"), (F.col("actual") + 7 * F.col("cleared")).cast("double")), F.lit(0.0)) * 100
    return g.select("n", (F.col("n") * 7).alias("potential"), "actual", (F.col("n") * 7 - F.col("actual")).alias("saved"), rate.alias("call_rate"), (100 - rate).alias("saved_rate"), ratio(F.col("actual").cast("double"), F.col("n").cast("double")).alias("avg_calls"))


def stage_counters(df: DataFrame) -> DataFrame:
    """How often each stage was right: ``y`` truth, ``p1`` first stage, ``p2`` final."""
    y, a, b = F.col("y"), F.col("p1"), F.col("p2")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a == y).alias("stage1_right"), F.count_if(a == 0).alias("stage1_normal"), F.count_if(a == 1).alias("stage1_suspicious"),
        F.count_if((a == 1) & (b == y)).alias("stage2_right"), F.count_if((a == 1) & (b == 0) & (y == 0)).alias("stage2_cleared"), F.count_if(b == y).alias("final_right"),
    )


def severity_summary(graded: DataFrame) -> DataFrame:
    """Counts per severity and the threat level of (10 critical + 5 high) / n."""
    names = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    g = graded.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in names))
    score = (F.col("critical") * 10 + F.col("high") * 5) / F.greatest("n", F.lit(1))
    level = F.when(score >= 2, "CRITICAL").when(score >= 1, "HIGH").when(score >= 0.5, "MEDIUM").when(score > 0, "LOW").otherwise("NORMAL")
    return g.withColumn("threat_level", level)


def bad_cases(df: DataFrame) -> DataFrame:
    """False positives and negatives by error kind, type and endpoint: counts and mean probability.

    ``df``: y, p, probability, anomaly_type, endpoint.
    """
    kind = F.when((F.col("y") == 0) & (F.col("p") == 1), "FP").when((F.col("y") == 1) & (F.col("p") == 0), "FN")
    return df.withColumn("error", kind).filter("error is not null").groupBy("error", "anomaly_type", "endpoint").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("avg_probability"))


def training_profile(df: DataFrame) -> DataFrame:
    """Per label: rows, method and status histograms, response-time mean, median, extremes."""
    hist = lambda c: df.groupBy("label", c).count().groupBy("label").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col(c).cast("string"), F.col("count").cast("string")))), ",").alias(f"{c}_histogram"))
    g = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("response_time").alias("mean_ms"), F.median("response_time").alias("median_ms"), F.max("response_time").alias("max_ms"), F.min("response_time").alias("min_ms"))
    return g.join(hist("method"), "label").join(hist("status"), "label")


def top_per_group(df: DataFrame, group: str, item: str, n: int = 5) -> DataFrame:
    """Most frequent items of each group, ties by name."""
    counts = df.groupBy(group, item).count()
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), item))).filter(F.col("rank") <= n)


def paired_lengths(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Answer lengths and emptiness of two models by category, and their paired difference."""
    both = a.select(key, "category", F.length("answer").alias("la")).join(b.select(key, F.length("answer").alias("lb")), key)
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("la").alias("avg_a"), F.avg("lb").alias("avg_b"), F.avg(F.col("lb") - F.col("la")).alias("avg_diff"), F.count_if(F.col("la") == 0).alias("empty_a"), F.count_if(F.col("lb") == 0).alias("empty_b"))


def samples_per_group(df: DataFrame, group: str, order: str, n: int = 2) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= n).drop("_r")
