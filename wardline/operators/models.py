"""Learned detectors: forests, isolation forest, votes, and their comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.metrics import confusion, roc_auc
from wardline.storage import materialise


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.7, buckets: int = 64) -> DataFrame:
    """Add ``is_train``: by label the first ``share`` of rows in the order of a hash of the key.

    Ranks are made in two levels (hash bucket, then row), so a label's rows are not gathered in one task.
    """
    h = F.md5(F.col(key).cast("string"))
    x = df.withColumns({"_h": h, "_b": F.floor(F.conv(F.substring(h, 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int")})
    counts = x.groupBy(label, "_b").count()
    w = Window.partitionBy(label)
    before = counts.withColumns({"_before": F.sum("count").over(w.orderBy("_b")) - F.col("count"), "_n": F.sum("count").over(w)}).drop("count")
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    return x.withColumn("_r", rank).join(before, [label, "_b"]).withColumn("is_train", F.col("_before") + F.col("_r") <= F.floor(F.col("_n") * share)).drop("_h", "_b", "_r", "_before", "_n")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * n of the class). The table of weights has a row a class; broadcasting it is left to Spark's check of its size."""
    counts = df.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("count"))).alias("weight"))
    return df.join(w, label)


TASK_ROWS = 50_000  # training rows that one task holds


def fit_forest(train: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 15, least: int = 2, seed: int = 42, key: str | None = None) -> PipelineModel:
    """Scaler and balanced random forest over numeric columns.

    Rows are dealt out to tasks of about TASK_ROWS: a table of many rows in few bytes is otherwise read by few tasks, or by one. By a ``key``
    that tells rows apart they are dealt and sorted the same way at any number of cores, and so is the forest.
    """
    weighted = class_weights(train.select(label, *features, *([key] if key else [])), label)
    parts = max(1, -(-train.count() // TASK_ROWS))
    dealt = weighted.repartition(parts, key).sortWithinPartitions(key) if key else weighted.repartition(parts)
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="scaled", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed),
    ]
    return Pipeline(stages=stages).fit(dealt)


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``p_attack`` and ``pred``: the label at the threshold."""
    p = vector_to_array("probability")[1]
    out = model.transform(df).withColumn("p_attack", p)
    return out.withColumn("pred", F.when(F.col("p_attack") >= threshold, 1).otherwise(0)).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, features: list[str], spark, n: int = 10) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


# ---- isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> list:
    """Nested lists [feature, cut, left, right] or [size]."""
    lo, hi = x.min(axis=0), x.max(axis=0)
    open_ = np.flatnonzero(hi > lo)
    if depth >= most or len(x) <= 1 or not len(open_):
        return [len(x)]
    f = int(rng.choice(open_))
    cut = float(rng.uniform(lo[f], hi[f]))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, most), _grow(x[~left], rng, depth + 1, most)]


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(node: list, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), depth + average_path(node[0]))
    out, left = np.empty(len(x)), x[:, node[0]] < node[1]
    out[left], out[~left] = _depths(node[2], x[left], depth + 1), _depths(node[3], x[~left], depth + 1)
    return out


def isolation_scores(df: DataFrame, features: list[str], key: str, trees: int = 200, rows: int = 256, contamination: float = 0.25, seed: int = 42) -> DataFrame:
    """(key, anomaly_score, pred, confidence): 1 for the ``contamination`` most isolated rows.

    Every tree grows in its own task on about ``rows`` rows picked by a hash; the trees (bounded by ``trees * rows``
    nodes) are shared with the scoring tasks. The confidence is the min-max scaled score, or its complement if normal.
    """
    import json

    df = materialise(df.select(key, *features), "isolation-rows")  # counted, picked from and scored
    n = df.count()
    # one hash picks the rows of all trees, about ``trees * rows``; only those are tested tree by tree
    part = lambda *of: F.pmod(F.xxhash64(F.col(key), *of), F.lit(1 << 30)) / float(1 << 30)
    some = min(1.0, trees * rows / max(n, 1))
    picked = df.select(key, *features).filter(part(F.lit(-1), F.lit(seed)) < some).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    picked = picked.filter(part("tree", F.lit(seed)) < min(1.0, rows / max(n, 1)) / some)

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        t = int(g["tree"].iloc[0])
        x = g.sort_values(key)[features].to_numpy(dtype=float)
        return pd.DataFrame({"tree": [t], "size": [len(x)], "node": [json.dumps(_grow(x, np.random.default_rng([seed, t]), 0, int(np.ceil(np.log2(max(rows, 2))))))]})

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, size int, node string").collect()  # ``trees`` rows
    forest = [json.loads(r["node"]) for r in sorted(grown, key=lambda r: r["tree"])]
    norm = average_path(float(np.mean([r["size"] for r in grown]))) if grown else 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].to_numpy(dtype=float)
            depth = np.mean([_depths(t, x) for t in forest], axis=0) if forest and len(x) else np.zeros(len(x))
            yield pd.DataFrame({key: b[key], "anomaly_score": 2.0 ** (-depth / max(norm, 1e-9))})

    kind = dict(df.dtypes)[key]
    scored = materialise(df.select(key, *features).mapInPandas(score, f"{key} {kind}, anomaly_score double"), "anomaly-scores")  # read for the cut, and again
    cut = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 100_000).alias("_cut"), F.min("anomaly_score").alias("_lo"), F.max("anomaly_score").alias("_hi"))
    x = scored.crossJoin(F.broadcast(cut))
    scaled = min_max("anomaly_score", "_lo", "_hi")
    pred = F.when(F.col("anomaly_score") > F.col("_cut"), 1).otherwise(0)
    return x.select(key, "anomaly_score", pred.alias("pred"), F.when(pred == 1, scaled).otherwise(1 - scaled).alias("confidence"))


def min_max(value: str, low: str, high: str) -> Column:
    return (F.col(value) - F.col(low)) / (F.col(high) - F.col(low) + 1e-10)


def ensemble(rf: DataFrame, iso: DataFrame, rule: DataFrame, key: str = "session_id") -> DataFrame:
    """Weighted vote .45 forest, .35 rules, .20 isolation; a missing vote is 0, a missing confidence .5.

    ``rf``: key, pred, p_attack; ``iso``: key, pred, confidence; ``rule``: key, verdict, confidence.
    """
    x = rf.select(key, F.col("pred").alias("rf_vote"), F.col("p_attack").alias("rf_conf"))
    x = x.join(iso.select(key, F.col("pred").alias("if_vote"), F.col("confidence").alias("if_conf")), key, "left")
    x = x.join(rule.select(key, F.when(F.col("verdict") == "malicious_crawler", 1).otherwise(0).alias("rule_vote"), F.col("confidence").alias("rule_conf")), key, "left")
    x = x.fillna({c: 0 for c in ("if_vote", "rule_vote")} | {c: 0.5 for c in ("if_conf", "rule_conf")})
    vote = F.col("rf_vote") * 0.45 + F.col("rule_vote") * 0.35 + F.col("if_vote") * 0.2
    conf = F.col("rf_conf") * 0.45 + F.col("rule_conf") * 0.35 + F.col("if_conf") * 0.2
    return x.withColumns({"pred": F.when(vote >= 0.5, 1).otherwise(0), "confidence": F.round(conf, 4)})


def compare(methods: dict[str, DataFrame]) -> DataFrame:
    """Metrics and AUC of each method; every table has y, p, score."""
    from functools import reduce

    rows = reduce(lambda a, b: a.union(b), (df.select(F.lit(m).alias("method"), "y", "p", F.col("score").cast("double").alias("score")) for m, df in methods.items()))
    rows = materialise(rows, "compared-methods")
    return confusion(rows, by=["method"]).join(roc_auc(rows, by=["method"]), "method")


def cascade(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """(log_id, final): normal unless the first stage suspects; then the second stage's verdict, or anomaly if it has none.

    ``stage1``: log_id, suspicious; ``stage2``: log_id, verdict.
    """
    x = stage1.join(stage2, "log_id", "left")
    return x.select("log_id", F.when(~F.col("suspicious"), "normal").otherwise(F.coalesce("verdict", F.lit("anomaly"))).alias("final"))
