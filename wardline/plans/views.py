"""Views of the given tables as logs, incidents and health records: one SQL expression list serves Spark and DuckDB.

In the SQL text ``{k}`` is the number in ``props``, which the engines read with different functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAP = 28_800
_PATH = """CASE event_type WHEN 'view' THEN '/api/items/' || {k} WHEN 'click' THEN '/api/comments?page=' || {k} WHEN 'signup' THEN '/api/login'
 WHEN 'purchase' THEN '/api/payments/' || {k} ELSE CASE {k} % 7 WHEN 0 THEN '/admin/users' WHEN 1 THEN '/api/files?name=../../etc/passwd'
 WHEN 2 THEN '/api/search?q=<script>alert(' || {k} || ')</script>' WHEN 3 THEN '/api/items/1'' OR 1=1--' WHEN 4 THEN '/debug/env'
 WHEN 5 THEN '/api/orders?limit=100000&id=-' || {k} ELSE '/addresses?page=' || {k} END END"""
_CATEGORY = """CASE WHEN event_type = 'error' THEN CASE {k} % 7 WHEN 0 THEN 'unauthorized_access' WHEN 1 THEN 'directory_traversal' WHEN 2 THEN 'xss'
 WHEN 3 THEN 'sql_injection' WHEN 4 THEN 'sensitive_data_leakage' WHEN 5 THEN 'performance_issue' ELSE 'invalid_item_value' END
 WHEN user_id % 8 = 0 THEN 'malicious_crawler' WHEN user_id % 8 = 1 THEN 'legit_crawler' ELSE 'normal' END"""
REQUEST = {
    "log_id": "event_id", "ts": "cast(ts AS timestamp)", "source_ip": "'10.0.' || (user_id % 5) || '.' || user_id",
    "method": "CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'DELETE' ELSE 'GET' END",
    "path": _PATH, "status": "CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 500 ELSE 403 END WHEN event_type = 'click' AND {k} % 10 = 0 THEN 404 ELSE 200 END",
    "user_agent": "CASE user_id % 8 WHEN 0 THEN 'python-requests/2.31.0' WHEN 1 THEN 'Googlebot/2.1' WHEN 2 THEN 'curl/8.0' ELSE 'Mozilla/5.0' END",
    "response_time": "cast(round(value * 100) AS bigint)", "request_body": "CASE event_type WHEN 'signup' THEN '{{\"password\": \"secret' || {k} || '\"}}' WHEN 'purchase' THEN 'amount=-' || {k} ELSE '' END",
    "response_body": "CASE WHEN {k} % 20 = 0 THEN 'card 4111-1111-1111-' || (1000 + {k}) WHEN {k} % 20 = 1 THEN 'mail user' || {k} || '@example.org' ELSE 'ok' END",
    "user_identity": "CASE user_id % 8 WHEN 3 THEN 'admin' WHEN 4 THEN 'guest' ELSE 'user' END", "category": _CATEGORY,
    "severity": "CASE WHEN {k} % 10 < 2 THEN 'CRITICAL' WHEN {k} % 10 < 5 THEN 'HIGH' WHEN {k} % 10 < 8 THEN 'MEDIUM' WHEN {k} % 10 = 8 THEN 'LOW' ELSE 'INFO' END",
    "rule_id": "CASE WHEN event_type = 'error' THEN '94' || {k} ELSE '' END", "alert_type": "CASE {k} % 9 WHEN 0 THEN 'injection' WHEN 1 THEN 'xss' ELSE '' END",
    "latency_ms": "cast(round(value) AS int)", "source_type": "CASE user_id % 3 WHEN 0 THEN 'waf' WHEN 1 THEN 'ids' ELSE 'api_gateway' END",
    "endpoint": "'/api/' || event_type || '/' || ({k} % 5)", "k": "{k}", "user_id": "user_id",
}
INCIDENT = {
    "id": "event_id", "log_id": "event_id", "api_endpoint": "'/api/' || event_type || '/' || ({k} % 5)", "severity": REQUEST["severity"], "confidence": "(50 + {k} % 50) / 100.0e0",
    "anomaly_type": "CASE user_id % 4 WHEN 0 THEN 'injection attack' WHEN 1 THEN 'cross-site scripting attack' WHEN 2 THEN 'directory traversal attack' ELSE 'performance issue' END",
    "reason": _PATH, "detected_at": "cast(ts AS timestamp)", "result": "CASE WHEN {k} % 3 = 0 THEN 'failed' ELSE 'completed' END", "health_delta": "({k} - 50) / 250.0e0",
}
_SPARK_K, _DUCK_K = "cast(get_json_object(props, '$.k') AS int)", "cast(json_extract_string(props, '$.k') AS int)"
DISPOSITION = "CASE WHEN severity = 'CRITICAL' AND confidence >= 0.9 THEN 'auto_block' WHEN severity = 'CRITICAL' AND confidence >= 0.7 THEN 'notify_email' WHEN severity IN ('HIGH', 'MEDIUM') THEN 'notify_email' WHEN severity = 'INFO' THEN 'none' ELSE 'auto_log' END"


def _columns(view: dict[str, str], k: str) -> list[str]:
    return [f"{v.replace('{k}', k).replace('{{', '{').replace('}}', '}')} AS {c}" for c, v in view.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(REQUEST, _SPARK_K))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents: events with a high number, typed and graded."""
    from wardline.operators.incidents import disposition

    x = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')").selectExpr(*_columns(INCIDENT, _SPARK_K))
    return x.withColumn("disposition", disposition())


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily health rows of every endpoint; ``health_score`` and ``status`` as first stored, without history."""
    r = requests(spark, sf_dir)
    g = r.selectExpr("endpoint", "date_trunc('day', ts) AS day", "user_id", "category", "status", "response_time").groupBy("endpoint", "day")
    from pyspark.sql import functions as F

    x = g.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("category") == "malicious_crawler").alias("anomaly_count"), F.count_if(F.col("status") >= 400).alias("errors"),
        F.avg("response_time").alias("avg_rt"),
    )
    x = x.selectExpr("unix_date(cast(day AS date)) * 100L + crc32(endpoint) % 100 AS id", "endpoint AS api_endpoint", "day AS ts", "total_requests", "anomaly_count", "errors", "avg_rt")
    score = "greatest(0e0, least(1e0, 1e0 - 0.7e0 * anomaly_count / total_requests - 0.4e0 * errors / total_requests))"
    x = x.selectExpr("*", f"{score} AS health_score")
    return x.selectExpr("*", "CASE WHEN health_score >= 0.8 THEN 'normal' WHEN health_score >= 0.5 THEN 'degraded' ELSE 'critical' END AS status")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.operators.sessions import stitch, with_session_id

    return with_session_id(stitch(requests(spark, sf_dir), GAP))


def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the sessions, which lie together by address as they were stitched."""
    from wardline.operators.sessions import session_features as features

    return features(sessions(spark, sf_dir), within=("source_ip",))


# ---- the same views for DuckDB

REQ = f"req AS (SELECT {', '.join(_columns(REQUEST, _DUCK_K))} FROM events)"
INC = f"inc AS (SELECT *, {DISPOSITION} AS disposition FROM (SELECT {', '.join(_columns(INCIDENT, _DUCK_K))} FROM events WHERE event_type IN ('error', 'purchase')))"
HEALTH = """hea AS (SELECT *, CASE WHEN health_score >= 0.8 THEN 'normal' WHEN health_score >= 0.5 THEN 'degraded' ELSE 'critical' END AS status FROM (
  SELECT *, greatest(0e0, least(1e0, 1e0 - 0.7e0 * anomaly_count / total_requests - 0.4e0 * errors / total_requests)) AS health_score FROM (
  SELECT endpoint AS api_endpoint, date_trunc('day', ts) AS ts, count(*) AS total_requests, count(*) FILTER (category = 'malicious_crawler') AS anomaly_count,
         count(*) FILTER (status >= 400) AS errors, avg(response_time) AS avg_rt FROM req GROUP BY ALL)))"""
SES = f"""cut AS (SELECT *, sum(n) OVER (PARTITION BY source_ip ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_ip ORDER BY ts, log_id)) > {GAP} * 1000000::BIGINT THEN 1 ELSE 0 END AS n FROM req)),
ses AS (SELECT * EXCLUDE (n, session_no), cast(session_no AS BIGINT) AS session_no, md5(source_ip || '_' || epoch_us(min(ts) OVER (PARTITION BY source_ip, session_no))) AS session_id FROM cut)"""
_ODD = "regexp_matches(lower(user_agent), 'python-requests|curl/|scrapy|go-http|okhttp|apache-httpclient|mj12bot|customscraper')"
_KNOWN = "regexp_matches(lower(user_agent), 'googlebot|bingbot|baiduspider|duckduckbot')"
FEAT = f"""win AS (SELECT *, epoch_us(ts) AS us,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, log_id))) / 1e6 AS gap,
    count(*) OVER (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS p1,
    count(*) OVER (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW) AS p5,
    row_number() OVER (PARTITION BY session_id ORDER BY ts, log_id) - row_number() OVER (PARTITION BY session_id, path ORDER BY ts, log_id) AS run FROM ses),
runs AS (SELECT session_id, max(c) - 1 AS run FROM (SELECT session_id, path, run, count(*) AS c FROM win GROUP BY ALL) GROUP BY 1),
tops AS (SELECT session_id, max(c) AS top, count(*) AS u FROM (SELECT session_id, path, count(*) AS c FROM win GROUP BY ALL) GROUP BY 1),
agg AS (SELECT session_id, count(*) AS n, (max(us) - min(us)) / 1e6 AS duration, min(gap) AS gap, max(p1) AS p1, max(p5) AS p5,
    count(*) FILTER (regexp_matches(lower(path), 'admin|payment|export|backup|config')) AS sensitive, count(*) FILTER (contains(lower(path), '/login')) AS logins,
    count(*) FILTER (status BETWEEN 400 AND 599) AS errors, count(*) FILTER (status IN (401, 403)) AS auth, count(*) FILTER (method = 'POST') AS posts,
    count(*) FILTER ({_KNOWN}) AS known, count(*) FILTER (NOT {_KNOWN} AND {_ODD}) AS odd, bool_or({_ODD}) AS any_odd, min(category) AS c0, max(category) AS c1 FROM win GROUP BY 1 HAVING count(*) >= 2),
feat AS (SELECT session_id, n AS request_count, round(duration, 2) AS duration_sec, round(duration / (n - 1), 3) AS avg_interval_sec, round(gap * 1000, 1) AS min_interval_ms,
    round(CASE WHEN duration > 0 THEN n / duration ELSE n END, 3) AS requests_per_second, u AS unique_paths, round(u / n, 4) AS path_diversity_ratio, round(1 - u / n, 4) AS path_repetition_rate,
    round(top / n, 4) AS path_concentration, round(sensitive / n, 4) AS sensitive_path_ratio, round(errors / n, 4) AS error_rate, auth AS auth_fail_count, round(posts / n, 4) AS post_ratio,
    p1::DOUBLE AS peak_rps_1s, round(p5 / 5, 3) AS peak_rps_5s, run AS max_consecutive_same_path, round(known / n, 4) AS known_crawler_ua_ratio, round(odd / n, 4) AS suspicious_ua_ratio,
    CASE WHEN c0 = c1 THEN c0 ELSE 'mixed' END AS true_category, sensitive, logins, known, any_odd FROM agg JOIN runs USING (session_id) JOIN tops USING (session_id))"""
VERDICT = """rul AS (SELECT *, known > 0 AND NOT any_odd AS polite, logins > 10 AND auth_fail_count > logins * 0.5 AS stuffing,
    (CASE WHEN known > 0 AND NOT any_odd THEN -1.0e0 ELSE 0e0 END) + (CASE WHEN any_odd THEN 2e0 ELSE 0e0 END) + (CASE WHEN requests_per_second > 10 THEN 2.5e0 WHEN requests_per_second > 3 THEN 1e0 ELSE 0e0 END)
    + (CASE WHEN path_concentration > 0.8 THEN 2e0 WHEN path_concentration > 0.5 THEN 0.5e0 ELSE 0e0 END) + (CASE WHEN max_consecutive_same_path >= 5 THEN 1.5e0 ELSE 0e0 END) + sensitive * 0.3e0
    + (CASE WHEN logins > 10 AND auth_fail_count > logins * 0.5 THEN 2e0 ELSE 0e0 END) AS s FROM feat),
ver AS (SELECT session_id, round(s, 2) AS rule_score, CASE WHEN polite AND s <= 1 THEN 'legit_crawler' WHEN s >= 1.5 THEN 'malicious_crawler' ELSE 'normal' END AS verdict, true_category,
    1 / (1 + exp(-(s - 1))) AS sure FROM rul)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
