"""Queries over sources and sinks: tables written by a sink and read back by the source of its kind."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import incidents as I
from wardline.operators import metrics as M
from wardline.operators import models as Mo
from wardline.operators import sessions as Se
from wardline.plans import log_queries as Q
from wardline.plans import views as V
from wardline.sources import logs as L
from wardline.storage import materialise, new_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_API = "SELECT method, request_body || chr(10) || '\"q\", x' AS request_body, path AS request_url, response_body, status::VARCHAR AS status, response_time::VARCHAR AS response_time, user_identity, category AS label FROM req"


def _api_log(spark, d):
    """The request view as the raw API log: all text, with line feeds and quotes."""
    r = V.requests(spark, d)
    return r.select(
        "method", F.concat("request_body", F.lit('\n"q", x')).alias("request_body"), F.col("path").alias("request_url"), "response_body", F.col("status").cast("string").alias("status"),
        F.col("response_time").cast("string").alias("response_time"), "user_identity", F.col("category").alias("label"),
    )


def _as_csv(spark, df):
    path = new_path(spark, "api-log") + ".csv"
    df.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("s01_csv_log_scan", V.with_(V.REQ) + _API)
def csv_scan(spark, d):
    return L.read_csv(spark, _as_csv(spark, _api_log(spark, d))).drop("_corrupt_record")


_ROW = T.StructType([T.StructField("log_id", T.LongType()), T.StructField("path", T.StringType())])


def _blocks(df):
    """With ``block``, a number that 10,000 rows share at most, and nearly all share with as many: arrays stay bounded, and their number is that of the rows by 10,000."""
    return df.withColumn("block", F.expr("monotonically_increasing_id() div 10000"))


@query("s02_json_array_scan", V.with_(V.REQ) + "SELECT log_id, path FROM req")
def json_arrays(spark, d):
    """JSON arrays, one a file, and a table that isn't there, which is empty."""
    path = new_path(spark, "json-arrays")
    r = _blocks(V.requests(spark, d)).groupBy("block").agg(F.to_json(F.collect_list(F.struct("log_id", "path"))).alias("value"))
    r.select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return L.read_json_table(spark, path, _ROW).union(L.read_json_table(spark, new_path(spark, "absent"), _ROW))


@query("s03_labelled_by_extension", V.with_(V.REQ) + f"SELECT 'csv' AS kind, * FROM ({_API}) UNION ALL SELECT 'json', * FROM ({_API})")
def labelled(spark, d):
    log = _api_log(spark, d)
    path = new_path(spark, "labelled") + ".json"
    _blocks(log).groupBy("block").agg(F.to_json(F.collect_list(F.struct(*log.columns))).alias("value")).select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    kinds = {"csv": _as_csv(spark, log), "json": path}
    a, b = (L.read_labelled(spark, p, L.API_LOG).select(F.lit(k).alias("kind"), *log.columns) for k, p in kinds.items())
    return a.union(b)


@query("s04_chat_lines_scan", "SELECT conv_id, turn, role, text FROM conversations")
def chat_lines(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = new_path(spark, "chat")
    L.write_table(c, path, "json")
    return L.read_json_table(spark, path, c.schema, lines=True)


@query("s10_tolerant_sources", V.with_(V.REQ, Q._UNI) + "SELECT ts, path, source_type, '' AS failed FROM uni WHERE source_type <> 'ids' UNION ALL SELECT NULL, NULL, NULL, unnest(['camera', 'ids'])")
def tolerant(spark, d):
    """Four sources, of which one can't be read and one has no adapter: the others' rows, and the failures' names."""
    raw = Q._raw(spark, d)
    readers = {k: (lambda df=df: df) for k, df in raw.items()}
    readers["ids"] = lambda: spark.read.parquet(new_path(spark, "no-such-source"))
    readers["camera"] = lambda: raw["waf"]
    rows, failures = L.collect_tolerant(readers)
    names = spark.createDataFrame([(k,) for k in failures], "failed string")
    return rows.select("ts", "path", "source_type", F.lit("").alias("failed")).unionByName(names, allowMissingColumns=True)


_RESULT = "SELECT log_id, category AS type, severity FROM req"


def _results(spark, d):
    return V.requests(spark, d).selectExpr("log_id", "category AS type", "severity")


@query("s12_result_csv", V.with_(V.REQ) + _RESULT)
def result_csv(spark, d):
    x = _results(spark, d)
    path = new_path(spark, "results")
    L.write_table(x, path, "csv")
    return L.read_csv(spark, path, x.schema).drop("_corrupt_record")


@query("s13_metrics_json", V.with_(V.REQ) + "SELECT category, count(*) AS n, count(*) FILTER (status >= 500) AS detected, count(*) FILTER (status >= 500) / count(*) AS recall FROM req GROUP BY 1")
def metrics_json(spark, d):
    x = M.per_class_recall(V.requests(spark, d).withColumn("p", F.when(F.col("status") >= 500, 1).otherwise(0)))
    path = new_path(spark, "metrics")
    L.write_table(x, path, "json")
    return spark.read.schema(x.schema).json(path)


@query("s15_health_rows_append", V.with_(V.REQ, V.HEALTH) + "SELECT api_endpoint, ts, status, round(health_score, 6) AS health_score FROM hea")
def health_append(spark, d):
    """Health rows appended in two goes, critical ones last."""
    h = V.health(spark, d).select("api_endpoint", "ts", "status", F.round("health_score", 6).alias("health_score"))
    path = new_path(spark, "health-rows")
    L.write_table(h.filter("status <> 'critical'"), path, "parquet", "append")
    L.write_table(h.filter("status = 'critical'"), path, "parquet", "append")
    return spark.read.parquet(path)


@query("s16_stage2_results", V.with_(V.REQ) + _RESULT)
def stage2_results(spark, d):
    x = _results(spark, d)
    path = new_path(spark, "stage2")
    L.write_table(x, path, "json")
    return spark.read.schema(x.schema).json(path)


@query("s24_saved_model", V.with_(V.REQ, V.SES, V.FEAT) + ", r AS (SELECT row_number() OVER (PARTITION BY (true_category = 'malicious_crawler') ORDER BY md5(session_id), session_id) AS i, count(*) OVER (PARTITION BY (true_category = 'malicious_crawler')) AS n FROM feat) SELECT count(*) AS scored, 0::BIGINT AS differing FROM r WHERE i > floor(n * 0.7e0)")
def saved_model(spark, d):
    """A forest with its scaler and feature names, saved and loaded: how many sessions it scores, and how many of them differently."""
    from pyspark.ml import PipelineModel

    f = materialise(Se.session_features_wide(V.session_features(spark, d)), "session-features")
    f = materialise(Mo.stratified_split(f, "session_id", "label"), "model-features")
    model = Mo.fit_forest(f.filter("is_train"), Se.FEATURES, trees=20, depth=6, key="session_id")
    path = new_path(spark, "model")
    Mo.save_model(model, path)
    test = f.filter("not is_train")
    both = [Mo.predict(m, test).select("session_id", F.col("p_attack").alias(n)) for n, m in (("a", model), ("b", PipelineModel.load(path)))]
    return both[0].join(both[1], "session_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("a") != F.col("b")).alias("differing"))
