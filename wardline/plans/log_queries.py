"""Queries over the request log: sources, predicates, features, sessions, windows, crawlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import requests as R
from wardline.functions import scalars as S
from wardline.functions.patterns import CATEGORY_TYPES, FAMILIES, SIGNATURES
from wardline.operators import crawler as C
from wardline.operators import latency as T
from wardline.operators import metrics as M
from wardline.operators import ordering as O
from wardline.operators import sessions as Se
from wardline.operators.incidents import severity_flags, severity_rank
from wardline.plans import views as V
from wardline.sources import logs as L
from wardline.storage import materialise

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _raw(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The three raw sources, cut out of the request view."""
    r = V.requests(spark, d).withColumn("time", F.col("ts").cast("string"))
    return {
        "waf": r.filter("source_type = 'waf'").selectExpr("time AS timestamp", "source_ip AS client_ip", "method", "path AS uri", "status", "severity AS action", "rule_id", "severity", "user_agent", "request_body"),
        "ids": r.filter("source_type = 'ids'").selectExpr("time AS timestamp", "source_ip AS src_ip", "rule_id AS signature", "alert_type", "severity", "path AS uri", "method AS http_method", "user_agent AS http_user_agent"),
        "api_gateway": r.filter("source_type = 'api_gateway'").selectExpr("time AS request_time", "source_ip AS client_ip", "method AS request_method", "path AS request_uri", "status AS status_code", "latency_ms AS response_time_ms", "user_agent", "request_body", "response_body"),
    }


_UNI = """uni AS (
 SELECT ts, source_ip, method, path, status, user_agent, request_body, '' AS response_body, 0 AS latency_ms, severity, rule_id, severity AS alert_type, 'waf_' || substr(md5(source_ip), 1, 8) AS session_id, 'waf' AS source_type FROM req WHERE source_type = 'waf'
 UNION ALL SELECT ts, source_ip, method, path, CASE WHEN severity = 'HIGH' THEN 403 ELSE 200 END, user_agent, '', '', 0, severity, rule_id, alert_type, 'ids_' || substr(md5(source_ip), 1, 8), 'ids' FROM req WHERE source_type = 'ids'
 UNION ALL SELECT ts, source_ip, method, path, status, user_agent, request_body, response_body, latency_ms, '', '', '', 'gw_' || substr(md5(source_ip), 1, 8), 'api_gateway' FROM req WHERE source_type = 'api_gateway')"""


@query("s05_s08_collect_sources", V.with_(V.REQ, _UNI) + "SELECT * FROM uni")
def collect_sources(spark, d):
    return L.collect_sources(_raw(spark, d)).drop("raw")


@query("s09_since_and_limit", V.with_(V.REQ, _UNI) + "SELECT source_type, source_ip, path, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY ts, source_ip, path) AS r FROM uni WHERE ts >= TIMESTAMP '2024-01-10') WHERE r <= 500")
def since_and_limit(spark, d):
    return L.collect_sources(_raw(spark, d), since="2024-01-10", limit=500).select("source_type", "source_ip", "path", "ts")


@query("a01_count_by_source", V.with_(V.REQ, _UNI) + "SELECT source_type, count(*) AS count FROM uni GROUP BY 1")
def count_by_source(spark, d):
    return L.count_by_source(L.collect_sources(_raw(spark, d)))


@query("p02_source_category", V.with_(V.REQ, _UNI) + """SELECT source_type, category, count(*) AS n FROM (SELECT source_type, CASE WHEN (rule_id <> '' AND severity IN ('CRITICAL', 'HIGH'))
 OR alert_type IN ('injection', 'xss', 'directory_traversal', 'sensitive_data') OR latency_ms > 100 OR (status IN (403, 500) AND severity IN ('HIGH', 'MEDIUM')) THEN 'malicious_crawler' ELSE 'normal' END AS category FROM uni) GROUP BY ALL""")
def source_category(spark, d):
    return L.collect_sources(_raw(spark, d)).withColumn("category", R.source_category()).groupBy("source_type", "category").agg(F.count(F.lit(1)).alias("n"))


@query("s11_batch_tally", V.with_(V.REQ) + "SELECT log_id // 50 AS batch_id, category AS type, count(*) AS count FROM req GROUP BY ALL")
def batch_tally(spark, d):
    return L.batch_tally(V.requests(spark, d).withColumnRenamed("category", "type"))


@query("p06_p07_p12_predicates", V.with_(V.REQ) + """SELECT log_id, CASE WHEN response_time > 2000 OR contains(path, '../') THEN 1 ELSE CASE WHEN status >= 500 THEN 1 ELSE 0 END END AS overridden,
 (status >= 500 OR response_time > 2000 OR (status = 403 AND contains(lower(path), '/admin')) OR (method IN ('OPTIONS', 'TRACE') AND contains(lower(path), '/api')) OR contains(path, '../') OR contains(path, '''') OR contains(lower(path), '<script')) AS heuristic,
 CASE WHEN lower(trim(category)) = 'normal' THEN 0 ELSE 1 END AS y FROM req""")
def predicates(spark, d):
    return V.requests(spark, d).select(
        "log_id", R.hard_override(S.flag(F.col("status") >= 500)).alias("overridden"), R.heuristic_anomaly().alias("heuristic"), F.when(F.lower(F.trim("category")) == "normal", 0).otherwise(1).alias("y")
    )


_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_TYPES.items())


@query("p13_p14_category_fold", V.with_(V.REQ) + f"SELECT category, CASE category {_TYPES} END AS attack_type, CASE WHEN contains(category, 'crawler') AND category <> 'legit_crawler' THEN 'malicious_crawler' ELSE category END AS folded, count(*) AS n FROM req GROUP BY ALL")
def category_fold(spark, d):
    fold = F.when(F.col("category").isin("malicious_crawler", "distributed_crawler", "crowdsourced_crawler"), "malicious_crawler").otherwise(F.col("category"))
    return V.requests(spark, d).select("category", R.category_type().alias("attack_type"), fold.alias("folded")).groupBy("category", "attack_type", "folded").agg(F.count(F.lit(1)).alias("n"))


def _q(p: str) -> str:
    return "'(?i)" + p.replace("'", "''") + "'"


def _count(x: str, family: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, {_q(p)}))" for p in FAMILIES[family]) + ")"


_ALL, _UB = "(request_body || ' ' || path || ' ' || response_body)", "(path || ' ' || request_body)"
_SCORES = {
    "dir_traversal_score": _count(_ALL, "dir_traversal"), "xss_score": _count(_ALL, "xss"), "injection_score": _count(_ALL, "injection"), "sensitive_data_leakage": _count("response_body", "sensitive_data"),
    "sensitive_in_request": _count("request_body", "sensitive_data"), "invalid_value_score": _count(_UB, "invalid_value"),
    "unauthorized_access_score": "(CASE WHEN user_identity IN ('user', 'guest') THEN 2 * (regexp_matches(lower(path), '/admin|/delete|/drop|/truncate'))::INT + (method IN ('DELETE', 'PUT', 'PATCH'))::INT ELSE 0 END + " + _count("path", "unauthorized") + ")",
    "performance_issue_score": _count(_ALL, "performance"), "json_anomaly_score": _count("(request_body || response_body)", "json_anomaly"),
}
_FEATURES = (
    "SELECT log_id, " + ", ".join(f"(method = '{m}')::INT AS method_{m.lower()}" for m in ("GET", "POST", "PUT", "DELETE", "PATCH")) + ", " + ", ".join(f"(status // 100 = {s})::INT AS status_{s}xx" for s in (2, 4, 5))
    + ", (status IN (400, 401, 403, 404))::INT AS status_client_error, response_time::DOUBLE AS response_time_ms, (response_time > 1000)::INT AS slow_response, (response_time > 3000)::INT AS very_slow_response,"
    " length(request_body)::INT AS request_body_length, length(path)::INT AS request_url_length, length(response_body)::INT AS response_body_length, (length(request_body) + length(path) + length(response_body))::INT AS total_payload_length, "
    + ", ".join(f"{v}::INT AS {k}" for k, v in _SCORES.items())
    + ", (length(path) - length(replace(path, '/', '')))::INT AS url_depth, contains(path, '?')::INT AS has_query_params, (length(path) - length(replace(path, '&', '')) + contains(path, '?')::INT)::INT AS query_param_count,"
    " regexp_matches(path, '/admin|/users|/clients|/sales|/beSharedItems')::INT AS is_sensitive_endpoint, contains(user_identity, 'admin')::INT AS is_admin, contains(user_identity, 'root')::INT AS is_root FROM req"
)


@query("m01_request_features", V.with_(V.REQ, f"f AS ({_FEATURES})") + "SELECT *, greatest(is_admin, is_root) AS is_privileged_user, (greatest(is_admin, is_root) = 0 AND is_sensitive_endpoint = 1 AND slow_response = 1)::INT AS high_risk_combo, (injection_score > 0 AND status_2xx = 1)::INT AS injection_with_success, "
       + ", ".join(f"({k} > 0)::INT AS has_{k.replace('_score', '')}" for k in _SCORES if k != "sensitive_in_request") + " FROM f")
def request_features(spark, d):
    return R.request_features(V.requests(spark, d).withColumn("request_url", F.col("path")))


def _signature_sql(x: str) -> str:
    """Best (confidence, first type) over the signature table, as a list maximum."""
    per = [f"greatest({', '.join(f'CASE WHEN regexp_matches({x}, {_q(p)}) THEN {c}e0 ELSE 0e0 END' for p, c in ps)})" for ps in SIGNATURES.values()]
    return "[" + ", ".join(per) + "]"


@query("f02_regex_class", V.with_(V.REQ, f"g AS (SELECT log_id, {_signature_sql(chr(40) + 'method || chr(32) || path' + chr(41))} AS c FROM req)")
       + "SELECT log_id, CASE WHEN list_max(c) > 0 THEN [" + ", ".join(f"'{t}'" for t in SIGNATURES) + "][list_position(c, list_max(c))] ELSE 'unknown' END AS attack_type, list_max(c) AS confidence FROM g")
def regex_class(spark, d):
    c = R.regex_class(F.concat_ws(" ", "method", "path"))
    return V.requests(spark, d).select("log_id", c.alias("c")).select("log_id", F.col("c.type").alias("attack_type"), F.col("c.confidence").alias("confidence"))


@query("f10_f25_scalars", V.with_(V.REQ) + """SELECT log_id, regexp_matches(lower(path), 'admin|payment|export|backup|config') AS sensitive, substr(path, 1, 12) AS cut,
 CASE WHEN length(path) > 20 THEN substr(path, 1, 8) || '...' || right(path, 6) ELSE path END AS head_tail, length(path) // 4 AS tokens, 'HTTP Method: ' || method || ' | Endpoint: ' || path || ' | User Agent: ' || user_agent AS query_text,
 'method: ' || method || '. path: ' || path || CASE WHEN trim(request_body) <> '' THEN '. request_body: ' || request_body ELSE '' END AS features_text, replace(replace('{method} on {path} {other}', '{method}', method), '{path}', path) AS filled,
 CASE WHEN regexp_matches(lower(path), 'etc/passwd|/passwd|passwd') THEN 'etc_passwd' WHEN contains(lower(path), 'or 1=1') THEN 'tautology' ELSE 'default' END AS variant, date_trunc('minute', ts) AS minute, round(1 / (1 + exp(-(k / 50.0e0))), 6) AS sigmoid,
 CASE WHEN trim(request_body) <> '' THEN request_body ELSE path END AS first_filled FROM req""")
def scalars(spark, d):
    return V.requests(spark, d).select(
        "log_id", S.contains_any(F.lower("path"), ["admin", "payment", "export", "backup", "config"]).alias("sensitive"), S.text_cut("path", 12).alias("cut"), S.head_tail("path", 20, 8, 6).alias("head_tail"),
        S.token_estimate("path").alias("tokens"), S.query_text().alias("query_text"), S.features_text(["method", "path", "request_body"]).alias("features_text"),
        S.fill_template(F.lit("{method} on {path} {other}"), {"method": F.col("method"), "path": F.col("path")}).alias("filled"), R.payload_variant(F.col("path")).alias("variant"),
        F.date_trunc("minute", "ts").alias("minute"), F.round(S.sigmoid(F.col("k") / 50.0), 6).alias("sigmoid"), S.first_filled("request_body", "path").alias("first_filled"),
    )


@query("q01_slow_endpoints", V.with_(V.REQ) + """SELECT log_id, response_time > CASE WHEN contains(lower(path), '/admin') THEN 3000 WHEN regexp_matches(lower(path), 'report|export|sync|bulk') THEN 4000
 WHEN method = 'GET' AND (contains(path, '?') OR regexp_matches(lower(path), 'search|batch')) THEN 3000 ELSE 2000 END OR response_time > 5000 AS slow,
 coalesce(response_time > 2 * lag(response_time) OVER (PARTITION BY endpoint ORDER BY ts, log_id), false) AS rising FROM req""")
def slow_endpoints(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("endpoint").orderBy("ts", "log_id")
    return V.requests(spark, d).select("log_id", R.slow_for_class().alias("slow"), F.coalesce(F.col("response_time") > 2 * F.lag("response_time").over(w), F.lit(False)).alias("rising"))


@query("q02_access_decision", V.with_(V.REQ) + """SELECT log_id, CASE WHEN user_identity = 'admin' THEN false WHEN contains(path, '..') THEN false WHEN regexp_matches(regexp_extract(path, '^[^?]*'), '/(sysManager|server)/|/adminInfo|/adminDashboard') THEN true
 WHEN regexp_matches(regexp_extract(path, '^[^?]*'), '/admins/') AND NOT regexp_matches(regexp_extract(path, '^[^?]*'), '/admins/self$') THEN true
 WHEN regexp_matches(path, '^(/api)?/(addresses|afterSaleServices)') AND regexp_matches(path, '[?&](userId|customerId|user_id)=') THEN false
 WHEN regexp_matches(path, '^(/api)?/(addresses|afterSaleServices)') AND regexp_matches(path, '[?&](page|limit|all|scope|admin_view)=') THEN true ELSE false END AS flagged FROM req""")
def access_decision(spark, d):
    return V.requests(spark, d).select("log_id", R.access_decision().alias("flagged"))


@query("q03_traversal_decision", "SELECT page_id, len(regexp_extract_all(url_decode(url_decode(u)), '\\.\\./')) >= 2 OR regexp_matches(u, '(?i)(\\.|%2e|%252e){2}(%2f|%5c|%252f)|%2e%2e/') OR regexp_matches(url_decode(url_decode(u)), '/etc/(passwd|shadow|hosts)|/proc/|boot\\.ini') AS flagged"
       " FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/..%2f..%2fetc' WHEN 1 THEN url || '/../../x' WHEN 2 THEN url || '/%2e%2e/' ELSE url END AS u FROM pages)")  # fmt: skip
def traversal_decision(spark, d):
    p = V.table(spark, d, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN url || '/..%2f..%2fetc' WHEN 1 THEN url || '/../../x' WHEN 2 THEN url || '/%2e%2e/' ELSE url END AS path")
    return p.select("page_id", R.traversal_decision().alias("flagged"))


_AUTH = "regexp_matches(regexp_extract(lower(path), '^[^?]*'), '/(login|logout|register|signup|auth|oauth|token|password)(/|$)')"


@query("q04_leaks_in_context", V.with_(V.REQ) + f"""SELECT log_id, CASE WHEN {_AUTH} AND method = 'POST' THEN 0e0 WHEN user_identity = 'admin' AND regexp_matches(regexp_extract(lower(path), '^[^?]*'), '^(/api)?/(admin|metadata)(/|$)') AND c < 0.95 THEN 0e0 ELSE c END AS leak
 FROM (SELECT *, CASE WHEN regexp_matches(t, '(?i)(password|secret|api[_-]?key|private[_-]?key|token)\\W{{0,3}}[:=]\\s*[''"]?[^\\s''"*]{{6,}}') THEN 0.95e0 WHEN regexp_matches(t, '\\b[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}\\b') THEN 0.85e0
   WHEN regexp_matches(t, '[A-Za-z0-9._]+@[A-Za-z0-9-]+\\.[A-Za-z]{{2,}}') THEN 0.70e0 ELSE 0e0 END AS c FROM (SELECT *, request_body || ' ' || response_body AS t FROM req))""")
def leaks_in_context(spark, d):
    x = V.requests(spark, d).withColumn("t", F.concat_ws(" ", "request_body", "response_body"))
    return x.select("log_id", R.leak_in_context("t").alias("leak"))


_TRIED = ["union select products", "admin' --", "' or 1=1", "O'Brien; fine"]
_HOSTILE = "(?i)union\\s+(all\\s+)?select|''\\s*(or|and)\\s+(''?\\w+''?)\\s*=\\s*''?\\w+"
_QUOTED = ", ".join("'" + x.replace("'", "''") + "'" for x in _TRIED)


@query("q05_injections_by_endpoint", V.with_(V.REQ) + f"""SELECT log_id, CASE WHEN {_AUTH} THEN regexp_matches(t, '{_HOSTILE}') OR regexp_matches(t, \'\'\'\\s*(--|#|/\\*)\') WHEN regexp_matches(regexp_extract(lower(path), '^[^?]*'), '/(search|find|comments?|reviews?|feedback)(/|$)')
 THEN regexp_matches(t, '{_HOSTILE}') AND regexp_matches(t, '[\'\'");]|--') ELSE regexp_matches(t, '{_HOSTILE}') END AS injection FROM (SELECT *, [{_QUOTED}][k % 4 + 1] AS t FROM req)""")
def injections_by_endpoint(spark, d):
    tried = F.array(*map(F.lit, _TRIED))
    return V.requests(spark, d).withColumn("t", F.get(tried, F.expr("cast(k % 4 AS int)"))).select("log_id", R.injection_in_context("t").alias("injection"))


_RUNS = """seq AS (SELECT *, coalesce(response_time <= lag(response_time) OVER w, false)::INT AS cut FROM req WHERE response_time > 0 WINDOW w AS (PARTITION BY endpoint ORDER BY ts, log_id)),
 num AS (SELECT *, sum(cut) OVER (PARTITION BY endpoint ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS run FROM seq)"""


@query("q01_rising_latency", V.with_(V.REQ, _RUNS) + """SELECT endpoint, cast(run AS BIGINT) AS run, arg_min(log_id, (ts, log_id)) AS first_id, arg_max(log_id, (ts, log_id)) AS last_id, count(*) AS steps, min(response_time) AS first_ms, max(response_time) AS last_ms
 FROM num GROUP BY ALL HAVING max(response_time) > 2 * min(response_time)""")
def rising(spark, d):
    return T.rising_latency(V.requests(spark, d))


_SLOW_RUNS = """slo AS (SELECT *, coalesce(response_time > CASE WHEN contains(lower(path), '/admin') THEN 3000 WHEN regexp_matches(lower(path), 'report|export|sync|bulk') THEN 4000 WHEN method = 'GET' AND (contains(path, '?') OR regexp_matches(lower(path), 'search|batch')) THEN 3000 ELSE 2000 END OR response_time > 5000, false) AS slow FROM req),
 seq AS (SELECT *, coalesce(slow <> lag(slow) OVER w, false)::INT AS cut FROM slo WINDOW w AS (PARTITION BY endpoint ORDER BY ts, log_id)),
 num AS (SELECT *, sum(cut) OVER (PARTITION BY endpoint ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS run FROM seq)"""


@query("q01_repeated_latency", V.with_(V.REQ, _SLOW_RUNS) + "SELECT endpoint, cast(run AS BIGINT) AS run, arg_min(log_id, (ts, log_id)) AS first_id, arg_max(log_id, (ts, log_id)) AS last_id, count(*) AS steps FROM num WHERE slow GROUP BY ALL HAVING count(*) >= 3")
def repeated(spark, d):
    return T.repeated_latency(V.requests(spark, d))


@query("q04_q05_q06_text_decisions", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(password|secret|api[_-]?key|token)\\s*[:=]\\s*.?[*xX]{4,}') THEN 0e0
 WHEN regexp_matches(text, '(?i)(password|secret|api[_-]?key|private[_-]?key|token)\\W{0,3}[:=]\\s*[''"]?[^\\s''"*]{6,}') THEN 0.95e0
 WHEN regexp_matches(text, '\\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\\b|\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b') THEN 0.85e0 WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}') THEN 0.7e0 ELSE 0e0 END AS leak,
 regexp_matches(text, '(?i)union\\s+(all\\s+)?select|drop\\s+table|insert\\s+into\\s+\\w+|delete\\s+from\\s+\\w+|;\\s*(cat|curl|wget|rm)\\s|''\\s*(or|and)\\s+(''?\\w+''?)\\s*=\\s*''?\\w+|sleep\\(\\s*[0-9]+\\s*\\)') AS injected,
 regexp_matches(text, '(?i)<script|<iframe|<svg[^>]*on\\w+\\s*=|\\son(error|load|click|mouseover)\\s*=|javascript:') AS scripted FROM documents""")
def text_decisions(spark, d):
    return V.table(spark, d, "documents").select("doc_id", R.leak_confidence("text").alias("leak"), R.injection_decision("text").alias("injected"), R.script_decision("text").alias("scripted"))


@query("q07_invalid_values", "SELECT id, CASE WHEN name IN ('comment', 'email') THEN false WHEN name = 'price' AND try_cast(value AS DOUBLE) IS NULL THEN true WHEN name = 'price' AND try_cast(value AS DOUBLE) < 0 THEN true WHEN name = 'birth_date' AND try_cast(substr(value, 1, 4) AS INT) > 2100 THEN true ELSE false END AS flagged"
       " FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'birth_date' WHEN 2 THEN 'comment' ELSE 'price' END AS name, CASE p_partkey % 4 WHEN 0 THEN '-' || p_size WHEN 1 THEN (2080 + p_size) || '-01-01' WHEN 2 THEN p_name ELSE p_type END AS value FROM part)")  # fmt: skip
def invalid_values(spark, d):
    p = V.table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'birth_date' WHEN 2 THEN 'comment' ELSE 'price' END AS name", "CASE p_partkey % 4 WHEN 0 THEN '-' || p_size WHEN 1 THEN (2080 + p_size) || '-01-01' WHEN 2 THEN p_name ELSE p_type END AS value")
    return p.select("id", R.invalid_value_decision("name", "value").alias("flagged"))


@query("w04_sessions", V.with_(V.REQ, V.SES) + "SELECT session_id, source_ip, session_no, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM ses GROUP BY ALL")
def sessions(spark, d):
    return V.sessions(spark, d).groupBy("session_id", "source_ip", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("w05_session_labels", V.with_(V.REQ, V.SES) + """SELECT source_ip, session_no, 'stitched_' || string_agg(DISTINCT source_type, '+' ORDER BY source_type) || '_' || count(*) || 'req_' ||
 substr(regexp_replace(replace(arg_min(path, struct_pack(a := ts, b := log_id)), '/', '_'), '^_+|_+$', '', 'g'), 1, 12) || '_' || substr(md5(source_ip || '_' || epoch_us(min(ts))), 1, 6) AS session_label FROM ses GROUP BY source_ip, session_no""")
def session_labels(spark, d):
    return Se.session_labels(Se.stitch(V.requests(spark, d), V.GAP))


@query("m02_session_features", V.with_(V.REQ, V.SES, V.FEAT) + "SELECT * EXCLUDE (sensitive, logins, known, any_odd) FROM feat")
def session_features(spark, d):
    return V.session_features(spark, d).select("session_id", *Se.FEATURES, "true_category")


@query("m09_rule_verdicts", V.with_(V.REQ, V.SES, V.FEAT, V.VERDICT) + "SELECT session_id, rule_score, verdict, round(CASE WHEN verdict = 'normal' THEN 1 - sure ELSE sure END, 6) AS confidence FROM ver")
def rule_verdicts(spark, d):
    return Se.rule_verdicts(V.session_features(spark, d)).select("session_id", "rule_score", "verdict", F.round("confidence", 6).alias("confidence"))


@query("k02_top_sessions", V.with_(V.REQ, V.SES, V.FEAT, V.VERDICT) + "SELECT session_id, rule_score, verdict FROM ver ORDER BY rule_score DESC, session_id LIMIT 15")
def top_sessions(spark, d):
    return Se.top_sessions(Se.rule_verdicts(V.session_features(spark, d))).select("session_id", "rule_score", "verdict")


@query("w03_longest_runs", V.with_(V.REQ, V.SES, V.FEAT) + "SELECT session_id, run AS max_consecutive_same_path FROM runs")
def longest_runs(spark, d):
    return Se.longest_path_runs(V.sessions(spark, d))


@query("w12_repeated_paths", V.with_(V.REQ, V.SES) + "SELECT log_id, row_number() OVER (PARTITION BY session_id, path ORDER BY ts, log_id) - 1 AS repetitive_path_count FROM ses")
def repeated_paths(spark, d):
    return Se.repeated_path_count(V.sessions(spark, d)).select("log_id", F.col("repetitive_path_count").cast("long").alias("repetitive_path_count"))


_WIN = 600


_ANCHOR = f"""ANC AS (SELECT min(epoch_us(ts)) AS win FROM req UNION ALL SELECT (SELECT min(epoch_us(ts)) FROM req WHERE epoch_us(ts) > ANC.win + {_WIN}000000) FROM ANC WHERE win IS NOT NULL)"""


@query("w11_anchored_windows", V.with_(V.REQ, _ANCHOR).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT log_id, win FROM (SELECT log_id, epoch_us(ts) AS us FROM req) ASOF JOIN ANC ON us >= win")
def anchored_windows(spark, d):
    return C.anchored_windows(V.requests(spark, d), _WIN).select("log_id", "win")


def _windowed(spark, d):
    return C.grid_windows(V.sessions(spark, d), 3600)


_GRID = "grid AS (SELECT *, floor(epoch_us(ts) / 3600000000)::BIGINT AS win FROM ses)"
_EDGE = "edge AS (SELECT x.session_id AS a, y.session_id AS b, count(*) AS weight FROM (SELECT DISTINCT win, session_id FROM grid) x JOIN (SELECT DISTINCT win, session_id FROM grid) y ON x.win = y.win AND x.session_id < y.session_id GROUP BY ALL)"


@query("j07_co_access", V.with_(V.REQ, V.SES, _GRID, _EDGE) + "SELECT * FROM edge")
def co_access(spark, d):
    return C.co_access(_windowed(spark, d))


_MET = """grid AS (SELECT *, floor(epoch_us(ts) / 120000000)::BIGINT AS win FROM nam), """ + _EDGE
_NAM = "nam AS (SELECT * FROM ses)"
_CLU = """lnk AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), rea AS (SELECT a AS session_id, a AS other FROM lnk UNION SELECT lnk.b, rea.other FROM rea JOIN lnk ON lnk.a = rea.session_id),
 cmp AS (SELECT session_id, min(other) AS cluster_id FROM rea GROUP BY 1), clu AS (SELECT session_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM cmp QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 3)"""
_recursive = lambda *parts: V.with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query("g01_clusters", _recursive(V.REQ, V.SES, _NAM, _MET, _CLU) + "SELECT * FROM clu")
def clusters(spark, d):
    return C.window_clusters(materialise(C.window_members(C.grid_windows(V.sessions(spark, d), 120)), "windows"))


_CO = """pth AS (SELECT session_id, list(DISTINCT path) AS paths FROM nam GROUP BY 1), rto AS (SELECT x.session_id, count(*) / (any_value(x.cluster_size) - 1) AS peer_ratio FROM lnk JOIN clu x ON lnk.a = x.session_id GROUP BY 1),
 pee AS (SELECT x.session_id, y.session_id AS peer, row_number() OVER (PARTITION BY x.session_id ORDER BY y.session_id) AS k FROM clu x JOIN clu y ON x.cluster_id = y.cluster_id AND x.session_id <> y.session_id),
 sim AS (SELECT pee.session_id, avg(len(list_intersect(p.paths, q.paths)) / len(list_distinct(list_concat(p.paths, q.paths)))) AS overlap FROM pee JOIN pth p ON p.session_id = pee.session_id JOIN pth q ON q.session_id = peer WHERE k <= 10 GROUP BY 1),
 coa AS (SELECT session_id, round((peer_ratio + overlap) / 2, 4) AS co_access FROM rto JOIN sim USING (session_id))"""


@query("a30_co_access_scores", _recursive(V.REQ, V.SES, _NAM, _MET, _CLU, _CO) + "SELECT * FROM coa")
def co_access_scores(spark, d):
    s = V.sessions(spark, d)
    inside = materialise(C.window_members(C.grid_windows(s, 120)), "windows")
    return C.co_access_scores(C.window_clusters(inside), C.peers_met(inside), s)


_COV = """hit AS (SELECT grp, session_id, path, count(*) AS n FROM (SELECT unnest([source_type, '*']) AS grp, session_id, path FROM ses) GROUP BY ALL),
 sess AS (SELECT grp, session_id, sum(n) AS n FROM hit GROUP BY ALL), idle AS (SELECT grp, count(*) AS sessions, avg((n <= 2)::INT) AS idle FROM sess GROUP BY 1 HAVING count(*) >= 2),
 frq AS (SELECT grp, path, count(*)::DOUBLE AS f FROM hit GROUP BY ALL), tot AS (SELECT grp, sum(f) AS t, sum(f * log2(f)) AS flf, count(*) AS u FROM frq GROUP BY 1),
 pat AS (SELECT DISTINCT grp, path, regexp_extract(path, '^(/.+?)/(\\d+)$', 1) AS item, regexp_extract(path, '^(/.+?)\\?.*page[=](\\d+)', 1) AS page FROM frq),
 spc AS (SELECT grp, cast(sum(e) AS BIGINT) AS estimated FROM (SELECT grp, max(coalesce(try_cast(regexp_extract(path, '/([0-9]+)$', 1) AS BIGINT), try_cast(regexp_extract(path, 'page=([0-9]+)', 1) AS BIGINT))) + 2 AS e FROM pat WHERE item <> '' OR page <> '' GROUP BY grp, CASE WHEN item <> '' THEN item ELSE page || '?page' END
   UNION ALL SELECT grp, 1 FROM pat WHERE item = '' AND page = '') GROUP BY 1)"""


@query("a25_a26_coverage", V.with_(V.REQ, V.SES, _COV) + """SELECT grp, sessions, round(least(1e0, u / estimated), 4) AS coverage_completeness, round(CASE WHEN u > 1 THEN (log2(t) - flf / t) / log2(u) ELSE 1e0 END, 4) AS coverage_entropy,
 round(idle, 4) AS idle_session_ratio, u AS total_unique_paths, estimated AS estimated_resource_space FROM idle JOIN tot USING (grp) JOIN spc USING (grp)""")
def coverage(spark, d):
    return C.coverage(V.sessions(spark, d), "source_type").select("grp", "sessions", "coverage_completeness", "coverage_entropy", "idle_session_ratio", "total_unique_paths", "estimated_resource_space")


_SEQ = """sps AS (SELECT grp, session_id, list_sort(list(DISTINCT path)) AS paths FROM hit GROUP BY ALL),
 ids AS (SELECT grp, [x::BIGINT for x in [regexp_extract(p, '/([0-9]+)$', 1) for p in paths] if x <> ''] AS v, row_number() OVER (PARTITION BY grp ORDER BY session_id) AS r FROM sps),
 stp AS (SELECT grp, v, [v[i + 1] - v[i] for i in range(1, len(v))] AS steps FROM ids WHERE r <= 100 AND len(v) >= 2),
 seq AS (SELECT grp, avg((list_min(steps) > 0 OR (len(v) >= 3 AND list_min(steps) = list_max(steps)))::INT) AS sequential FROM stp GROUP BY 1)"""


@query("a27_sequential_scores", V.with_(V.REQ, V.SES, _COV, _SEQ) + "SELECT grp AS source_type, sequential FROM seq WHERE grp <> '*'")
def sequential(spark, d):
    s = V.sessions(spark, d).groupBy("source_type", "session_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return C.sequential_scores(s, "source_type", cap=100)


@query("a28_group_similarity", V.with_(V.REQ, V.SES) + """, fst AS (SELECT source_type, session_id, list_sort(list(DISTINCT path)) AS paths, row_number() OVER (PARTITION BY source_type ORDER BY session_id) AS r FROM ses GROUP BY source_type, session_id)
 SELECT x.source_type, round(avg(len(list_intersect(x.paths, y.paths)) / len(list_distinct(list_concat(x.paths, y.paths)))), 6) AS similarity FROM fst x JOIN fst y ON x.source_type = y.source_type AND x.r < y.r AND y.r <= 20 GROUP BY 1""")
def similarity(spark, d):
    s = V.sessions(spark, d).groupBy("source_type", "session_id").agg(F.collect_set("path").alias("paths"))
    return C.group_similarity(s, "source_type", cap=20).withColumn("similarity", F.round("similarity", 6))


def _named(spark, d):
    """Sessions whose names carry a pattern, as the network layer's defaults read them."""
    s = V.sessions(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ["malicious_scraper_", "malicious_ddos_tool_", "malicious_crowdsourced_", "normal_", "legit_"])), (F.col("user_id") % 5 + 1).cast("int"))
    return s.withColumn("session_id", F.concat(kind, "session_id"))


@query("f11_session_pattern", V.with_(V.REQ) + "SELECT user_id % 5 AS m, ['scraper', 'ddos_tool', 'crowdsourced', 'normal', 'legit'][user_id % 5 + 1] AS pattern, count(*) AS n FROM req GROUP BY ALL")
def pattern(spark, d):
    return _named(spark, d).select((F.col("user_id") % 5).alias("m"), C.session_pattern().alias("pattern")).groupBy("m", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("a29_crowd_stats", V.with_(V.REQ, V.SES) + "SELECT malicious, small, small / malicious AS crowdsourced_ratio, small / malicious > 0.3 AS crowdsourced_flag FROM (SELECT count(*) AS malicious, count(*) FILTER (n <= 2) AS small FROM (SELECT session_id, count(*) AS n FROM ses WHERE user_id % 5 < 3 GROUP BY 1))")
def crowd(spark, d):
    return C.crowd_stats(_named(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")))


_KINDS = ["malicious_scraper_", "malicious_ddos_tool_", "malicious_crowdsourced_", "normal_", "legit_"]
_PATS = ["scraper", "ddos_tool", "crowdsourced", "normal", "legit"]
_SEQ_ALL = _SEQ.replace("r <= 100 AND ", "")
_FUSION = [
    V.REQ, V.SES, f"nam AS (SELECT * EXCLUDE (session_id), {_KINDS}[user_id % 5 + 1] || session_id AS session_id, {_PATS}[user_id % 5 + 1] AS pattern FROM ses)", _MET, _CLU, _CO,
    _COV.replace("unnest([source_type, '*'])", "unnest([pattern, '*'])").replace("FROM ses)", "FROM nam)"), _SEQ_ALL,
    """cvr AS (SELECT grp, least(1e0, u / estimated) AS complete, CASE WHEN u > 1 THEN (log2(t) - flf / t) / log2(u) ELSE 1e0 END AS entropy, idle, coalesce(sequential, 0e0) AS sequential, u FROM idle JOIN tot USING (grp) JOIN spc USING (grp) LEFT JOIN seq USING (grp)),
 cov AS (SELECT grp, round(complete, 4) AS complete, round(entropy, 4) AS entropy, round(idle, 4) AS idle, round(sequential, 4) AS sequential, entropy < 0.75 AND idle > 0.3 AS low, u >= 5 AND complete > 0.5 AND idle > 0.3 AS pieces FROM cvr),
 fst AS (SELECT pattern, session_id, paths, row_number() OVER (PARTITION BY pattern ORDER BY session_id) AS r FROM (SELECT DISTINCT pattern, session_id FROM nam) JOIN pth USING (session_id)),
 alike AS (SELECT x.pattern, avg(len(list_intersect(x.paths, y.paths)) / len(list_distinct(list_concat(x.paths, y.paths)))) AS similarity FROM fst x JOIN fst y ON x.pattern = y.pattern AND x.r < y.r GROUP BY 1),
 one AS (SELECT DISTINCT session_id, pattern FROM nam),
 fus AS (SELECT session_id, one.pattern, cluster_id, coalesce(cluster_size, 0) AS cluster_size, cluster_id IS NOT NULL AS inside, coalesce(co_access, 0e0) * CASE WHEN cluster_id IS NOT NULL THEN 1e0 ELSE 0.3e0 END AS temporal,
   coalesce(c.complete, g.complete) AS complete, coalesce(c.low, g.low) AS low, coalesce(c.pieces, g.pieces) AS pieces,
   greatest(0e0, (1 - coalesce(c.entropy, g.entropy)) * CASE WHEN coalesce(c.low, g.low) THEN 0.6e0 ELSE 0.2e0 END + coalesce(c.complete, g.complete) * 0.25e0 + coalesce(c.sequential, g.sequential) * 0.15e0) AS cover,
   CASE one.pattern WHEN 'scraper' THEN round(least(1e0, coalesce(similarity, 0e0) * 1.5e0), 4) WHEN 'ddos_tool' THEN 0.9e0 WHEN 'crowdsourced' THEN 0.15e0 WHEN 'normal' THEN 0.1e0 WHEN 'legit' THEN 0.2e0 ELSE 0e0 END AS net
   FROM one LEFT JOIN clu USING (session_id) LEFT JOIN coa USING (session_id) LEFT JOIN cov c ON c.grp = one.pattern CROSS JOIN (SELECT * FROM cov WHERE grp = '*') g LEFT JOIN alike ON alike.pattern = one.pattern),
 ver AS (SELECT session_id, pattern, CASE WHEN pattern = 'crowdsourced' AND pieces AND net <= 0.3 THEN 'crowdsourced_crawler' WHEN inside AND net > 0.4 AND (low OR complete > 0.3) AND f >= 0.55 THEN 'distributed_crawler' WHEN f >= 0.5 THEN 'suspicious' ELSE 'normal' END AS determination,
   round(f, 4) AS fusion_score, round(temporal, 4) AS temporal_score, round(cover, 4) AS coverage_score, round(net, 4) AS network_score, inside AS in_cluster, cluster_size, cluster_id
   FROM (SELECT *, 0.35e0 * temporal + 0.35e0 * cover + 0.30e0 * net AS f FROM fus))""",
]


@query("m18_fusion", _recursive(*_FUSION) + "SELECT * FROM ver")
def fusion(spark, d):
    return C.fusion(_named(spark, d), 120)


_PFX = """lev AS (SELECT pattern, source_ip, session_id, unnest([8, 16, 24]) AS bits FROM nam), pre AS (SELECT pattern, bits, array_to_string(string_split(source_ip, '.')[1:bits // 8], '.') AS prefix, count(*)::DOUBLE AS f FROM lev WHERE source_ip IS NOT NULL GROUP BY ALL),
 glo AS (SELECT bits, prefix, sum(f) AS every, sum(sum(f)) OVER (PARTITION BY bits) AS t FROM pre GROUP BY bits, prefix), own AS (SELECT *, sum(f) OVER (PARTITION BY pattern, bits) AS n FROM pre),
 rol AS (SELECT pattern, bits, count(*) AS prefixes, cast(max(n) AS BIGINT) AS requests, round(abs(sum(-(f / n) * log2(f / n))), 6) AS entropy, round(greatest(sum(f / n * log2(f / n / (every / t))), 0e0), 6) AS divergence FROM own JOIN glo USING (bits, prefix) GROUP BY ALL),
 pfx AS (SELECT session_id, coalesce(network_score, 0e0) AS network_score FROM (SELECT session_id, min(pattern) AS pattern FROM nam GROUP BY 1) LEFT JOIN
   (SELECT pattern, round(sum(CASE bits WHEN 8 THEN 0.2e0 WHEN 16 THEN 0.3e0 ELSE 0.5e0 END * (1 - pow(2e0, -divergence))), 4) AS network_score FROM rol GROUP BY 1) USING (pattern))"""
_AGENT = "nam AS (SELECT *, user_agent AS pattern FROM ses)"


@query("m17_prefix_rollup", V.with_(V.REQ, V.SES, _AGENT, _PFX) + "SELECT pattern, cast(bits AS INT) AS bits, prefixes, requests, entropy, divergence FROM rol")
def prefix_rollup(spark, d):
    return C.prefix_rollup(V.sessions(spark, d).withColumn("pattern", F.col("user_agent")))


@query("m17_prefix_scores", V.with_(V.REQ, V.SES, _AGENT, _PFX) + "SELECT * FROM pfx")
def prefix_scores(spark, d):
    return C.prefix_scores(V.sessions(spark, d).withColumn("pattern", F.col("user_agent")))


_BY_PREFIX = [
    x.replace("CASE one.pattern WHEN 'scraper' THEN round(least(1e0, coalesce(similarity, 0e0) * 1.5e0), 4) WHEN 'ddos_tool' THEN 0.9e0 WHEN 'crowdsourced' THEN 0.15e0 WHEN 'normal' THEN 0.1e0 WHEN 'legit' THEN 0.2e0 ELSE 0e0 END AS net", "coalesce(pfx.network_score, 0e0) AS net")
    .replace("FROM one LEFT JOIN clu", "FROM one LEFT JOIN pfx USING (session_id) LEFT JOIN clu")
    .replace(_SEQ_ALL, _SEQ).replace("x.r < y.r GROUP BY 1", "x.r < y.r AND y.r <= 20 GROUP BY 1")
    for x in [*_FUSION[:4], _PFX, *_FUSION[4:]]
]


@query("m18_fusion_by_prefix", _recursive(*_BY_PREFIX) + "SELECT * FROM ver")
def fusion_by_prefix(spark, d):
    """The same fusion with the network layer fed by address prefixes, and sequential scores of each pattern's first 100 sessions."""
    x = _named(spark, d)
    return C.fusion(x, 120, network=C.prefix_scores(x.withColumn("pattern", C.session_pattern())), cap=100)


@query("a31_cluster_rollup", _recursive(*_FUSION) + """SELECT cluster_id, size, ((2 * s + size) // (2 * size)) / 10000 AS avg_fusion_score, members,
 CASE WHEN s >= 5500 * size THEN 'distributed_crawler' WHEN s >= 4500 * size THEN 'suspicious' ELSE 'normal' END AS determination
 FROM (SELECT cluster_id, count(*) AS size, cast(sum(cast(round(fusion_score * 10000) AS BIGINT)) AS BIGINT) AS s, array_to_string(list_slice(list_sort(list(session_id)), 1, 10), ',') AS members FROM ver WHERE cluster_id IS NOT NULL GROUP BY 1)""")
def rollup(spark, d):
    return C.cluster_rollup(C.fusion(_named(spark, d), 120))


@query("a32_global_assessment", _recursive(*_FUSION) + """SELECT coalesce(bool_or(determination = 'distributed_crawler'), false) AS has_distributed, coalesce(bool_or(determination = 'crowdsourced_crawler'), false) AS has_crowdsourced,
 count(*) FILTER (determination = 'distributed_crawler') AS distributed_crawler_count, count(*) FILTER (determination = 'crowdsourced_crawler') AS crowdsourced_crawler_count, count(*) FILTER (determination = 'suspicious') AS suspicious_count FROM ver""")
def assessment(spark, d):
    return C.global_assessment(C.fusion(_named(spark, d), 120))


@query("a09_category_recall", V.with_(V.REQ) + "SELECT category, count(*) AS n, count(*) FILTER (status >= 500) AS detected, count(*) FILTER (status >= 500) / count(*) AS recall FROM req GROUP BY 1")
def category_recall(spark, d):
    return M.per_class_recall(V.requests(spark, d).withColumn("p", S.flag(F.col("status") >= 500)))


_FOUND = f"fnd AS (SELECT log_id, CASE category {_TYPES} END AS expected, CASE WHEN list_max(c) > 0 THEN [" + ", ".join(f"'{t}'" for t in SIGNATURES) + f"][list_position(c, list_max(c))] ELSE 'unknown' END AS found FROM (SELECT log_id, category, {_signature_sql('(method || chr(32) || path)')} AS c FROM req))"


def _found(spark, d):
    r = V.requests(spark, d)
    return r.select("log_id", R.category_type().alias("expected"), R.regex_class(F.concat_ws(" ", "method", "path"))["type"].alias("found"))


@query("a10_recall_by_type", V.with_(V.REQ, _FOUND) + "SELECT expected, count(*) AS n, count(*) FILTER (found = expected) AS hits, count(*) FILTER (found <> 'unknown') AS confirmed, count(*) FILTER (found = 'unknown') AS rejected, count(*) FILTER (found = expected) / count(*) AS recall FROM fnd WHERE expected IS NOT NULL GROUP BY 1")
def recall_by_type(spark, d):
    return M.recall_by_type(_found(spark, d))


@query("a11_type_outcomes", V.with_(V.REQ, _FOUND) + """SELECT type, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM (SELECT expected AS type, CASE WHEN expected = found THEN 'tp' ELSE 'fn' END AS o FROM fnd WHERE expected IS NOT NULL
 UNION ALL SELECT found, 'fp' FROM fnd WHERE found <> 'unknown' AND expected IS DISTINCT FROM found) GROUP BY 1""")
def type_outcomes(spark, d):
    return M.type_outcomes(_found(spark, d))


@query("a39_samples_per_type", V.with_(V.REQ) + "SELECT category, path FROM (SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY path) AS r FROM (SELECT DISTINCT category, path FROM req)) WHERE r <= 8")
def samples(spark, d):
    return M.samples_per_group(V.requests(spark, d).select("category", "path").distinct(), "category", "path", 8)


@query("a42_label_summary", V.with_(V.REQ) + "SELECT category, count(*) AS n FROM req GROUP BY 1")
def label_summary(spark, d):
    return V.requests(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a38_attack_health", V.with_(V.REQ) + "SELECT path, count(*) AS attacks, greatest(0.3e0, 1 - count(*) * 0.05e0) AS health_score FROM req WHERE status >= 400 GROUP BY 1")
def attack_health(spark, d):
    from wardline.operators.incidents import attack_health as f

    return f(V.requests(spark, d).filter("status >= 400"))


@query("k06_first_attacks", V.with_(V.REQ) + "SELECT log_id, path FROM req WHERE status >= 400 ORDER BY ts, log_id LIMIT 200")
def first_attacks(spark, d):
    return V.requests(spark, d).filter("status >= 400").orderBy("ts", "log_id").limit(200).select("log_id", "path")


@query("a17_training_profile", V.with_(V.REQ) + """SELECT label, n, mean_ms, median_ms, max_ms, min_ms, method_histogram, status_histogram FROM (SELECT category AS label, count(*) AS n, avg(response_time) AS mean_ms, median(response_time) AS median_ms, max(response_time) AS max_ms, min(response_time) AS min_ms FROM req GROUP BY 1)
 JOIN (SELECT category AS label, string_agg(x, ',' ORDER BY x) AS method_histogram FROM (SELECT category, method || ':' || count(*) AS x FROM req GROUP BY category, method) GROUP BY 1) USING (label)
 JOIN (SELECT category AS label, string_agg(x, ',' ORDER BY x) AS status_histogram FROM (SELECT category, status || ':' || count(*) AS x FROM req GROUP BY category, status) GROUP BY 1) USING (label)""")
def training_profile(spark, d):
    return M.training_profile(V.requests(spark, d).withColumnRenamed("category", "label"))


@query("k05_top_endpoints", V.with_(V.REQ) + "SELECT category, path, count AS count, rank FROM (SELECT category, path, count(*) AS count, cast(row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, path) AS INT) AS rank FROM req GROUP BY category, path) WHERE rank <= 5")
def top_endpoints(spark, d):
    return M.top_per_group(V.requests(spark, d), "category", "path", 5)


@query("a33_run_summary", V.with_(V.REQ, V.SES, V.FEAT, V.VERDICT) + "SELECT true_category, verdict AS determination, count(*) AS count FROM ver GROUP BY ALL")
def run_summary(spark, d):
    f = V.session_features(spark, d)
    return C.run_summary(Se.rule_verdicts(f).join(f.select("session_id", "true_category"), "session_id").withColumnRenamed("verdict", "determination"))


@query("u04_path_overlap", V.with_(V.REQ) + """, p AS (SELECT source_ip, coalesce(list(DISTINCT path) FILTER (status < 400), []) AS fine, coalesce(list(DISTINCT path) FILTER (status >= 400), []) AS bad FROM req GROUP BY 1)
 SELECT source_ip, CASE WHEN len(fine) + len(bad) = 0 THEN 0e0 ELSE round(len(list_intersect(fine, bad)) / len(list_distinct(list_concat(fine, bad))), 6) END AS overlap FROM p""")
def overlap(spark, d):
    """How far an address's answered and refused paths are the same, counted over its distinct paths."""
    fine, bad = (F.max(S.flag(c)) for c in (F.col("status") < 400, F.col("status") >= 400))
    p = V.requests(spark, d).groupBy("source_ip", "path").agg(fine.alias("fine"), bad.alias("bad"))
    both, either = (F.sum(F.when(F.col("path").isNotNull(), x)) for x in (F.col("fine") * F.col("bad"), F.greatest("fine", "bad")))
    return p.groupBy("source_ip").agg(F.round(S.ratio(both, either), 6).alias("overlap"))


@query("u03_path_union", V.with_(V.REQ) + "SELECT category, count(DISTINCT path) AS n_paths, md5(string_agg(DISTINCT path, ' ' ORDER BY path)) AS digest FROM req GROUP BY 1")
def path_union(spark, d):
    u = V.requests(spark, d).select("category", "path").distinct().groupBy("category").agg(F.sort_array(F.collect_list("path")).alias("u"))
    return u.select("category", F.size("u").cast("long").alias("n_paths"), F.md5(F.array_join("u", " ")).alias("digest"))


@query("k01_global_order", V.with_(V.REQ) + "SELECT log_id, row_number() OVER (ORDER BY ts, log_id) AS row_no FROM req")
def global_order(spark, d):
    return O.with_row_number(V.requests(spark, d).select("log_id", "ts"), ["ts", "log_id"]).select("log_id", "row_no")


@query("p04_parsable_times", V.with_(V.REQ) + "SELECT log_id, ts FROM req WHERE k % 10 > 1")
def parsable_times(spark, d):
    """Times as text, some of them broken; rows whose time can't be read go."""
    raw = V.requests(spark, d).withColumn("ts", F.when(F.col("k") % 10 == 0, "no time").when(F.col("k") % 10 == 1, F.concat(F.lit("2024-13-"), F.col("ts").cast("string"))).otherwise(F.col("ts").cast("string")))
    return Se.parsable(raw, "ts").select("log_id", "ts")


@query("f14_f15_f18_f26_scalars", V.with_(V.REQ) + """SELECT log_id, round(log2(1 + k), 6) AS bits, round(k / 7e0, 3) AS rounded, md5(source_ip || '|' || path) AS id, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS rank,
 upper(substr(severity, 1, 1)) || lower(substr(severity, 2)) AS severity_display FROM req""")
def more_scalars(spark, d):
    x = severity_flags(V.requests(spark, d))
    return x.select("log_id", F.round(F.log2(1 + F.col("k")), 6).alias("bits"), F.round(F.col("k") / 7, 3).alias("rounded"), F.md5(F.concat_ws("|", "source_ip", "path")).alias("id"), severity_rank().alias("rank"), "severity_display")


@query("f14_entropy", V.with_(V.REQ) + "SELECT endpoint, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT endpoint, n, sum(n) OVER (PARTITION BY endpoint) AS t FROM (SELECT endpoint, status, count(*)::DOUBLE AS n FROM req GROUP BY ALL)) GROUP BY 1")
def entropy(spark, d):
    n = V.requests(spark, d).groupBy("endpoint", "status").agg(F.count(F.lit(1)).cast("double").alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return n.groupBy("endpoint").agg(F.round(F.abs(h), 6).alias("entropy"))


@query("f22_json", V.with_(V.REQ) + """SELECT log_id, '{"path":"' || replace(path, '"', '\\"') || '","status":' || status || '}' AS packed, CASE k % 3 WHEN 2 THEN NULL ELSE method END AS verdict, CASE k % 3 WHEN 2 THEN NULL ELSE k END AS score FROM req""")
def json_text(spark, d):
    """Structs to JSON; fields out of replies that wrap JSON in prose or fences, null where there is none."""
    r = V.requests(spark, d)
    body = F.to_json(F.struct(F.col("method").alias("verdict"), F.col("k").alias("score")))
    reply = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\ndone"))).when(F.col("k") % 3 == 1, F.concat(F.lit("It is "), body)).otherwise("no answer")
    found = F.from_json(S.json_part(reply), "verdict string, score int")
    return r.select("log_id", F.to_json(F.struct("path", "status")).alias("packed"), found["verdict"].alias("verdict"), found["score"].alias("score"))


@query("j04_features_with_raw", V.with_(V.REQ, V.SES, V.FEAT) + "SELECT session_id, request_count, count(log_id) AS raw_rows, min(path) AS first_path FROM feat LEFT JOIN ses USING (session_id) GROUP BY ALL")
def features_with_raw(spark, d):
    s = V.sessions(spark, d)
    f = Se.session_features(s).select("session_id", "request_count")
    return f.join(s.select("session_id", "log_id", "path"), "session_id", "left").groupBy("session_id", "request_count").agg(F.count("log_id").alias("raw_rows"), F.min("path").alias("first_path"))


@query("j02_truth_by_row", V.with_(V.REQ) + """, t AS (SELECT row_number() OVER (ORDER BY log_id) AS row_no, log_id, (category <> 'normal')::INT AS y FROM req), p AS (SELECT row_number() OVER (ORDER BY ts, log_id) AS row_no, (status >= 400)::INT AS p FROM req)
 SELECT row_no, log_id, y, p FROM t JOIN p USING (row_no)""")
def truth_by_row(spark, d):
    """Two tables without a common key, paired by their row numbers."""
    r = V.requests(spark, d)
    truth = r.select("log_id", S.flag(F.col("category") != "normal").alias("y"))
    found = r.select(F.col("log_id").alias("_id"), "ts", S.flag(F.col("status") >= 400).alias("p"))
    return O.by_row_number(truth, ["log_id"], found, ["ts", "_id"]).select("row_no", "log_id", "y", "p")


@query("u05_distinct_values", V.with_(V.REQ) + "SELECT DISTINCT endpoint, severity, category FROM req")
def distinct_values(spark, d):
    return V.requests(spark, d).select("endpoint", "severity", "category").distinct()
