"""Queries over incidents, health records and knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import contains_any
from wardline.operators import incidents as I
from wardline.operators import metrics as M
from wardline.plans import views as V
from wardline.sources import logs as L

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("i01_disposition", V.with_(V.INC) + "SELECT severity, confidence, disposition, count(*) AS n FROM inc GROUP BY ALL")
def disposition(spark, d):
    return V.incidents(spark, d).groupBy("severity", "confidence", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("p17_severity_flags", V.with_(V.INC) + "SELECT severity, severity IN ('CRITICAL', 'HIGH') AS requires_immediate_action, severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AS should_notify, upper(substr(severity, 1, 1)) || lower(substr(severity, 2)) AS severity_display, count(*) AS n FROM inc GROUP BY ALL")
def flags(spark, d):
    return I.severity_flags(V.incidents(spark, d)).groupBy("severity", "requires_immediate_action", "should_notify", "severity_display").agg(F.count(F.lit(1)).alias("n"))


@query("p08_incident_history", V.with_(V.INC) + "SELECT id, api_endpoint, severity, detected_at FROM inc WHERE api_endpoint = '/api/error/1' AND severity = 'CRITICAL' ORDER BY detected_at DESC, id DESC LIMIT 50")
def history(spark, d):
    return I.history(V.incidents(spark, d), "/api/error/1", "CRITICAL").select("id", "api_endpoint", "severity", "detected_at")


def _stages(spark, d) -> tuple[DataFrame, DataFrame]:
    r = V.requests(spark, d)
    s1 = r.selectExpr("log_id", "case when k % 4 = 0 then 0 else 1 end AS predicted_label", "k / 100e0 AS probability")
    s2 = r.filter("k % 3 <> 1").selectExpr("log_id", "case when k % 5 < 3 then 'anomaly' else 'normal' end AS type", "category AS anomaly_type", "(50 + k % 50) / 100e0 AS confidence")
    return s1, s2


_STAGES = "s1 AS (SELECT log_id, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS predicted_label, k / 100e0 AS probability FROM req), s2 AS (SELECT log_id, CASE WHEN k % 5 < 3 THEN 'anomaly' ELSE 'normal' END AS type, category AS anomaly_type, (50 + k % 50) / 100e0 AS confidence FROM req WHERE k % 3 <> 1)"
_GRADE = """grd AS (SELECT s1.log_id, CASE WHEN predicted_label = 0 OR coalesce(type = 'normal', false) THEN 'normal' ELSE 'anomaly' END AS final_verdict,
 CASE WHEN predicted_label = 0 THEN 'INFO' WHEN type = 'anomaly' THEN CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END WHEN type = 'normal' THEN 'INFO' ELSE 'LOW' END AS severity,
 CASE WHEN predicted_label = 0 THEN probability WHEN type = 'anomaly' THEN confidence WHEN type = 'normal' THEN 0e0 ELSE probability END AS confidence,
 CASE WHEN predicted_label = 0 THEN '' WHEN type = 'anomaly' THEN anomaly_type WHEN type = 'normal' THEN '' ELSE 'unconfirmed' END AS anomaly_type,
 CASE WHEN predicted_label = 0 THEN 'stage1' WHEN type = 'anomaly' THEN 'stage2' WHEN type = 'normal' THEN 'stage2_cleared' ELSE 'stage1_only' END AS source FROM s1 LEFT JOIN s2 USING (log_id))"""


@query("j01_m14_grade", V.with_(V.REQ, _STAGES, _GRADE) + "SELECT * FROM grd")
def grade(spark, d):
    return I.grade(*_stages(spark, d))


@query("a15_severity_summary", V.with_(V.REQ, _STAGES, _GRADE) + """SELECT *, CASE WHEN (critical * 10 + high * 5) / n >= 2 THEN 'CRITICAL' WHEN (critical * 10 + high * 5) / n >= 1 THEN 'HIGH' WHEN (critical * 10 + high * 5) / n >= 0.5 THEN 'MEDIUM' WHEN critical + high > 0 THEN 'LOW' ELSE 'NORMAL' END AS threat_level
 FROM (SELECT count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info FROM grd)""")
def severity_summary(spark, d):
    return M.severity_summary(I.grade(*_stages(spark, d)))


@query("m13_cascade", V.with_(V.REQ, _STAGES) + "SELECT s1.log_id, CASE WHEN predicted_label = 0 THEN 'normal' ELSE coalesce(type, 'anomaly') END AS final FROM s1 LEFT JOIN s2 USING (log_id)")
def cascade(spark, d):
    from wardline.operators.models import cascade as f

    s1, s2 = _stages(spark, d)
    return f(s1.select("log_id", (F.col("predicted_label") == 1).alias("suspicious")), s2.select("log_id", F.col("type").alias("verdict")))


_Y = "SELECT log_id, (category <> 'normal')::INT AS y, predicted_label AS p1, (final_verdict = 'anomaly')::INT AS p2, probability, grd.anomaly_type, endpoint FROM req JOIN s1 USING (log_id) JOIN grd USING (log_id)"


def _y(spark, d):
    s1, s2 = _stages(spark, d)
    g = I.grade(s1, s2).select("log_id", "final_verdict", "anomaly_type")
    r = V.requests(spark, d).select("log_id", F.when(F.col("category") != "normal", 1).otherwise(0).alias("y"), "endpoint")
    return r.join(s1, "log_id").join(g, "log_id").withColumns({"p1": F.col("predicted_label"), "p2": F.when(F.col("final_verdict") == "anomaly", 1).otherwise(0)})


@query("a14_stage_counters", V.with_(V.REQ, _STAGES, _GRADE, f"y AS ({_Y})") + """SELECT count(*) AS n, count(*) FILTER (p1 = y) AS stage1_right, count(*) FILTER (p1 = 0) AS stage1_normal, count(*) FILTER (p1 = 1) AS stage1_suspicious, count(*) FILTER (p1 = 1 AND p2 = y) AS stage2_right,
 count(*) FILTER (p1 = 1 AND p2 = 0 AND y = 0) AS stage2_cleared, count(*) FILTER (p2 = y) AS final_right FROM y""")
def stage_counters(spark, d):
    return M.stage_counters(_y(spark, d))


@query("a16_bad_cases", V.with_(V.REQ, _STAGES, _GRADE, f"y AS ({_Y})") + "SELECT CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS error, anomaly_type, endpoint, count(*) AS n, round(avg(probability), 10) AS avg_probability FROM y WHERE y <> p2 GROUP BY ALL")
def bad_cases(spark, d):
    return M.bad_cases(_y(spark, d).withColumn("p", F.col("p2"))).withColumn("avg_probability", F.round("avg_probability", 10))


@query("a13_call_cost", V.with_(V.REQ, _STAGES) + """SELECT n, n * 7 AS potential, actual, n * 7 - actual AS saved, actual / (actual + 7 * cleared) * 100 AS call_rate, 100 - actual / (actual + 7 * cleared) * 100 AS saved_rate, actual / n AS avg_calls FROM (
 SELECT count(*) AS n, count(*) FILTER (predicted_label = 0) AS cleared, cast(sum(CASE WHEN predicted_label = 0 THEN 0 WHEN type = 'normal' THEN 7 ELSE 1 END) AS BIGINT) AS actual FROM s1 LEFT JOIN s2 USING (log_id))""")
def call_cost(spark, d):
    s1, s2 = _stages(spark, d)
    x = s1.join(s2, "log_id", "left").select((F.col("predicted_label") == 1).alias("suspicious"), F.col("type").alias("verdict"), "anomaly_type")
    return M.call_cost(M.calls_per_log(x))


@query("s14_merge_incidents", V.with_(V.INC) + "SELECT id, detected_at, severity FROM (SELECT id, detected_at, severity, 0 AS b FROM inc WHERE id % 3 = 0 UNION ALL SELECT id, detected_at, severity, 1 FROM inc WHERE id % 3 <> 0) ORDER BY b, detected_at DESC, id LIMIT 1000")
def merge_incidents(spark, d):
    x = V.incidents(spark, d).select("id", "detected_at", "severity")
    return L.merge_incidents(x.filter("id % 3 = 0"), x.filter("id % 3 <> 0"))


@query("s20_outbox", V.with_(V.INC) + """SELECT id, channel, '[' || severity || '] ' || anomaly_type || ' on ' || api_endpoint AS subject, 'Incident: ' || id || chr(10) || 'Disposition: ' || disposition || chr(10) || 'Reason: ' || reason AS body FROM (
 SELECT *, CASE disposition WHEN 'notify_email' THEN 'email' WHEN 'auto_block' THEN 'gateway' WHEN 'auto_log' THEN 'log' END AS channel FROM inc) WHERE channel IS NOT NULL""")
def outbox(spark, d):
    return L.outbox(V.incidents(spark, d))


@query("s21_health_notices", V.with_(V.INC) + "SELECT id AS incident_id, api_endpoint, 'Health ' || CASE WHEN health_delta > 0 THEN 'improved' ELSE 'degraded' END || ' on ' || api_endpoint AS message FROM inc WHERE abs(health_delta) > 0.1")
def notices(spark, d):
    return L.health_notices(V.incidents(spark, d).withColumnRenamed("id", "incident_id"))


@query("a18_severity_by_api", V.with_(V.INC) + """SELECT api_endpoint, total, severities FROM (SELECT api_endpoint, cast(sum(c) AS BIGINT) AS total, string_agg(severity || ':' || c, ',' ORDER BY severity) AS severities FROM (SELECT api_endpoint, severity, count(*) AS c FROM inc GROUP BY ALL) GROUP BY 1) ORDER BY total DESC, api_endpoint LIMIT 20""")
def severity_by_api(spark, d):
    x = I.severity_by_api(V.incidents(spark, d))
    pairs = F.transform(F.map_entries("severities"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return x.select("api_endpoint", "total", F.array_join(pairs, ",").alias("severities"))


@query("a19_executive_summary", V.with_(V.INC) + "SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info, count(DISTINCT api_endpoint) AS apis, count(*) FILTER (disposition = 'auto_block') AS blocked FROM inc")
def executive_summary(spark, d):
    return I.executive_summary(V.incidents(spark, d))


@query("a20_incident_breakdown", V.with_(V.INC) + "SELECT api_endpoint, severity, disposition, count(*) AS n, cast(grouping(api_endpoint, severity, disposition) AS BIGINT) AS level FROM inc GROUP BY GROUPING SETS ((api_endpoint, severity, disposition), (api_endpoint, severity), (api_endpoint), ())")
def breakdown(spark, d):
    return I.incident_breakdown(V.incidents(spark, d))


_KNOW = """kno AS (SELECT *, round(greatest(0e0, least(1e0, 0.5e0 + CASE WHEN result = 'completed' THEN 0.2e0 ELSE 0e0 END + CASE WHEN health_delta > 0 THEN health_delta * 2 WHEN health_delta < -0.1 THEN -0.2e0 ELSE 0e0 END
 + CASE WHEN severity = 'CRITICAL' AND disposition = 'auto_block' THEN 0.15e0 ELSE 0e0 END - CASE WHEN disposition = 'escalate' THEN 0.1e0 ELSE 0e0 END)), 4) AS effectiveness_score,
 CASE WHEN health_delta > 0.05 THEN 'improved' WHEN health_delta < -0.05 THEN 'degraded' ELSE 'unchanged' END AS health_impact FROM inc)"""


_PATTERN = """severity || ' ' || anomaly_type || ' at ' || api_endpoint || ', answered by ' || disposition || ': ' || CASE health_impact WHEN 'improved' THEN 'the endpoint recovered' WHEN 'degraded' THEN 'the endpoint got worse' ELSE 'nothing changed' END"""
_ADVICE = """CASE health_impact WHEN 'improved' THEN 'Repeat ' WHEN 'degraded' THEN 'Go beyond ' ELSE 'Review ' END || disposition || ' when ' || api_endpoint || ' shows ' || severity || ' ' || anomaly_type ||
 CASE WHEN contains(lower(reason), 'passwd') THEN ' (seen: etc_passwd)' WHEN contains(lower(reason), 'or 1=1') THEN ' (seen: tautology)' ELSE '' END"""


@query("i05_i07_internalise", V.with_(V.INC, _KNOW) + f"SELECT id, anomaly_type AS incident_type, health_impact, effectiveness_score, {_PATTERN} AS learned_pattern, {_ADVICE} AS recommendation FROM kno")
def internalise(spark, d):
    return I.internalise(V.incidents(spark, d)).select("id", "incident_type", "health_impact", "effectiveness_score", "learned_pattern", "recommendation")


@query("a22_effectiveness_summary", V.with_(V.INC, _KNOW) + "SELECT health_impact, count(*) AS n, round(avg(effectiveness_score), 6) AS avg_effectiveness, max(effectiveness_score) AS max_effectiveness, min(effectiveness_score) AS min_effectiveness FROM kno GROUP BY 1")
def effectiveness(spark, d):
    return I.effectiveness_summary(I.internalise(V.incidents(spark, d))).withColumn("avg_effectiveness", F.round("avg_effectiveness", 6))


@query("a23_best_recommendations", V.with_(V.INC, _KNOW) + "SELECT anomaly_type AS incident_type, api_endpoint, count(*) AS n, round(avg(effectiveness_score), 6) AS avg_effectiveness, arg_max(id, struct_pack(a := effectiveness_score, b := -id)) AS best_id FROM kno GROUP BY ALL")
def best_recommendations(spark, d):
    k = I.internalise(V.incidents(spark, d)).withColumn("recommendation", F.col("id"))
    return I.best_recommendations(k).select("incident_type", "api_endpoint", "n", F.round("avg_effectiveness", 6).alias("avg_effectiveness"), F.col("best").alias("best_id"))


@query("p09_search_knowledge", V.with_(V.INC, _KNOW) + "SELECT id, effectiveness_score FROM kno WHERE anomaly_type = 'injection attack' AND effectiveness_score >= 0.8")
def search_knowledge(spark, d):
    return I.search_knowledge(I.internalise(V.incidents(spark, d)), kind="injection attack", least=0.8).select("id", "effectiveness_score")


@query("k03_top_knowledge", V.with_(V.INC, _KNOW) + "SELECT id, api_endpoint, anomaly_type AS incident_type FROM (SELECT *, row_number() OVER (PARTITION BY api_endpoint, anomaly_type ORDER BY effectiveness_score DESC, id) AS r FROM kno) WHERE r <= 5")
def top_knowledge(spark, d):
    from pyspark.sql import Window

    k = I.internalise(V.incidents(spark, d))
    w = Window.partitionBy("api_endpoint", "incident_type").orderBy(F.desc("effectiveness_score"), "id")
    return k.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("id", "api_endpoint", "incident_type")


def _templates(spark, d):
    """One row a template; a table of the log's types and variants would be this small, too."""
    t = V.table(spark, d, "region").selectExpr("explode(array(named_struct('anomaly_type', '*', 'variant', 'default', 'template', 'Investigate {anomaly_type} on {api_endpoint}.'), named_struct('anomaly_type', 'injection attack', 'variant', 'tautology', 'template', 'Tautology on {api_endpoint}: use bound parameters.'), named_struct('anomaly_type', 'injection attack', 'variant', 'default', 'template', 'Audit the queries of {api_endpoint}.'))) AS x")
    return t.select("x.*").distinct()


_EXPLAIN = """CASE WHEN anomaly_type = 'injection attack' AND contains(lower(reason), 'or 1=1') AND NOT contains(lower(reason), 'passwd') THEN 'Tautology on ' || api_endpoint || ': use bound parameters.'
 WHEN anomaly_type = 'injection attack' THEN 'Audit the queries of ' || api_endpoint || '.' ELSE 'Investigate ' || anomaly_type || ' on ' || api_endpoint || '.' END"""


@query("i08_explain", V.with_(V.INC) + f"SELECT id, {_EXPLAIN} AS explanation FROM inc")
def explain(spark, d):
    return I.explain(V.incidents(spark, d), _templates(spark, d))


@query("a34_attack_patterns", V.with_(V.INC) + "SELECT api_endpoint, count(*) AS count FROM inc GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10")
def attack_patterns(spark, d):
    return I.attack_patterns(V.incidents(spark, d))


@query("w10_escalations", V.with_(V.INC) + """SELECT api_endpoint, arg_min(severity, struct_pack(a := detected_at, b := id)) AS start, arg_max(severity, struct_pack(a := detected_at, b := id)) AS "end", count(*) AS step_count FROM inc GROUP BY 1
 HAVING list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], CASE WHEN arg_max(severity, struct_pack(a := detected_at, b := id)) = 'INFO' THEN 'LOW' ELSE arg_max(severity, struct_pack(a := detected_at, b := id)) END)
      > list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], CASE WHEN arg_min(severity, struct_pack(a := detected_at, b := id)) = 'INFO' THEN 'LOW' ELSE arg_min(severity, struct_pack(a := detected_at, b := id)) END)""")
def escalations(spark, d):
    return I.escalations(V.incidents(spark, d))


@query("a35_mass_attacks", V.with_(V.INC) + "SELECT date_trunc('day', detected_at) AS day, count(DISTINCT api_endpoint) AS endpoints FROM inc GROUP BY 1 HAVING count(DISTINCT api_endpoint) > 3")
def mass_attacks(spark, d):
    x = V.incidents(spark, d).withColumn("detected_at", F.date_trunc("day", "detected_at"))
    return I.mass_attack_minutes(x).withColumnRenamed("minute", "day")


@query("a36_widespread_types", V.with_(V.INC) + "SELECT anomaly_type, count(DISTINCT api_endpoint) AS endpoints FROM inc GROUP BY 1 HAVING count(DISTINCT api_endpoint) > 1")
def widespread(spark, d):
    return I.widespread_types(V.incidents(spark, d))


@query("w14_latest_incident", V.with_(V.INC) + "SELECT id, api_endpoint, detected_at FROM inc ORDER BY detected_at DESC, id DESC LIMIT 1")
def latest(spark, d):
    return I.latest_incident(V.incidents(spark, d)).select("id", "api_endpoint", "detected_at")


# ---- health


@query("health_view", V.with_(V.REQ, V.HEALTH) + "SELECT api_endpoint, ts, total_requests, anomaly_count, errors, round(avg_rt, 6) AS avg_rt, round(health_score, 6) AS health_score, status FROM hea")
def health_view(spark, d):
    return V.health(spark, d).select("api_endpoint", "ts", "total_requests", "anomaly_count", "errors", F.round("avg_rt", 6).alias("avg_rt"), F.round("health_score", 6).alias("health_score"), "status")


_HIST = """his AS (SELECT *, avg(CASE WHEN avg_rt > 0 THEN avg_rt END) OVER (PARTITION BY api_endpoint ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS baseline_rt, lag(status) OVER (PARTITION BY api_endpoint ORDER BY ts) AS previous_status,
 (SELECT count(*) FROM inc WHERE inc.api_endpoint = hea.api_endpoint AND inc.detected_at <= hea.ts AND inc.detected_at >= hea.ts - INTERVAL 1 DAY) AS incidents_24h FROM hea)"""


@query("i03_health_scores", V.with_(V.REQ, V.HEALTH, V.INC, _HIST) + """SELECT api_endpoint, ts, round(baseline_rt, 6) AS baseline_rt, previous_status, incidents_24h, round(greatest(0e0, least(1e0, 1 - 0.7e0 * anomaly_count / total_requests - 0.4e0 * errors / total_requests
 - CASE WHEN baseline_rt > 0 AND avg_rt / baseline_rt > 1.5 THEN least((avg_rt / baseline_rt - 1.5e0) * 0.15e0, 0.2e0) ELSE 0e0 END - least(incidents_24h * 0.01e0, 0.3e0) - CASE WHEN previous_status IN ('degraded', 'critical') THEN 0.1e0 ELSE 0e0 END)), 6) AS score FROM his""")
def health_scores(spark, d):
    x = I.incidents_in_last_day(I.with_history(V.health(spark, d)), V.incidents(spark, d))
    return x.select("api_endpoint", "ts", F.round("baseline_rt", 6).alias("baseline_rt"), "previous_status", "incidents_24h", F.round(I.health_score(), 6).alias("score"))


_RESCORE = """hin AS (SELECT hea.*, (SELECT count(*) FROM inc WHERE inc.api_endpoint = hea.api_endpoint AND inc.detected_at <= hea.ts AND inc.detected_at >= hea.ts - INTERVAL 1 DAY) AS incidents_24h, row_number() OVER (PARTITION BY api_endpoint ORDER BY ts) AS rn,
   avg(CASE WHEN avg_rt > 0 THEN avg_rt END) OVER (PARTITION BY api_endpoint ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM hea),
 raw AS (SELECT *, 1e0 - anomaly_count / total_requests * 0.7e0 - errors / total_requests * 0.4e0 - CASE WHEN avg_rt > 0 AND avg_rt / base > 1.5 THEN least((avg_rt / base - 1.5e0) * 0.15e0, 0.2e0) ELSE 0e0 END - least(incidents_24h * 0.01e0, 0.3e0) AS s FROM hin),
 res(api_endpoint, ts, rn, old_score, new_score, new_status) AS (
   SELECT api_endpoint, ts, rn, health_score, CASE WHEN abs(x - health_score) > 0.001 THEN round(x, 4) ELSE health_score END, CASE WHEN abs(x - health_score) > 0.001 THEN CASE WHEN x >= 0.8 THEN 'normal' WHEN x >= 0.5 THEN 'degraded' ELSE 'critical' END ELSE status END
   FROM (SELECT *, round(greatest(0e0, least(1e0, s)), 6) AS x FROM raw WHERE rn = 1)
   UNION ALL
   SELECT api_endpoint, ts, rn, health_score, CASE WHEN abs(x - health_score) > 0.001 THEN round(x, 4) ELSE health_score END, CASE WHEN abs(x - health_score) > 0.001 THEN CASE WHEN x >= 0.8 THEN 'normal' WHEN x >= 0.5 THEN 'degraded' ELSE 'critical' END ELSE status END
   FROM (SELECT raw.*, round(greatest(0e0, least(1e0, raw.s - CASE WHEN res.new_status IN ('degraded', 'critical') THEN 0.1e0 ELSE 0e0 END)), 6) AS x FROM res JOIN raw ON raw.api_endpoint = res.api_endpoint AND raw.rn = res.rn + 1))"""


@query("w08_rescore", V.with_(V.REQ, V.HEALTH, V.INC, _RESCORE).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT api_endpoint, ts, round(old_score, 6) AS old_score, round(new_score, 4) AS new_score, new_status FROM res")
def rescore(spark, d):
    h = V.health(spark, d)
    x = I.rescore(I.incidents_in_last_day(h, V.incidents(spark, d)))
    return x.join(h.select("id", "api_endpoint", "ts"), ["id", "api_endpoint"]).select("api_endpoint", "ts", F.round("old_score", 6).alias("old_score"), F.round("new_score", 4).alias("new_score"), "new_status")


@query("w09_health_trend", V.with_(V.REQ, V.HEALTH) + """, las AS (SELECT *, row_number() OVER (PARTITION BY api_endpoint ORDER BY ts DESC) AS r FROM hea)
 SELECT api_endpoint, round(arg_max(health_score, ts), 6) AS current_score, round(avg(health_score), 6) AS avg_score, round(min(health_score), 6) AS min_score, round(max(health_score), 6) AS max_score, count(*) AS records_count, arg_max(status, ts) AS current_status,
 CASE WHEN arg_max(health_score, ts) > arg_min(health_score, ts) THEN 'improving' WHEN arg_max(health_score, ts) < arg_min(health_score, ts) THEN 'declining' ELSE 'stable' END AS trend FROM las WHERE r <= 10 GROUP BY 1""")
def health_trend(spark, d):
    x = I.health_trend(V.health(spark, d))
    return x.withColumns({c: F.round(c, 6) for c in ("current_score", "avg_score", "min_score", "max_score")})


def _changes(spark, d):
    return I.health_changes(V.incidents(spark, d), V.health(spark, d))


_CHG = """chg AS (SELECT inc.id AS incident_id, inc.api_endpoint, inc.disposition AS disposition_taken, b.ts AS before_ts, a.ts AS after_ts, round(a.health_score - b.health_score, 4) AS health_delta, a.anomaly_count - b.anomaly_count AS anomaly_delta,
 (a.health_score > b.health_score OR a.anomaly_count < b.anomaly_count) AS improvement FROM inc ASOF JOIN hea b ON inc.api_endpoint = b.api_endpoint AND inc.detected_at >= b.ts ASOF JOIN hea a ON inc.api_endpoint = a.api_endpoint AND inc.detected_at < a.ts)"""


@query("i04_health_changes", V.with_(V.REQ, V.HEALTH, V.INC, _CHG) + "SELECT incident_id, api_endpoint, disposition_taken, before_ts, after_ts, health_delta, anomaly_delta, improvement FROM chg")
def health_changes(spark, d):
    return _changes(spark, d).select("incident_id", "api_endpoint", "disposition_taken", F.col("before.ts").alias("before_ts"), F.col("after.ts").alias("after_ts"), "health_delta", "anomaly_delta", "improvement")


@query("a21_health_assessment", V.with_(V.REQ, V.HEALTH, V.INC, _CHG) + "SELECT api_endpoint, round(sum(health_delta), 4) AS total_delta, round(avg(health_delta), 6) AS avg_delta, count(*) FILTER (health_delta > 0) AS improved, count(*) FILTER (health_delta < 0) AS degraded, count(*) FILTER (health_delta = 0) AS unchanged FROM chg GROUP BY 1")
def health_assessment(spark, d):
    x = I.health_assessment(_changes(spark, d))
    return x.withColumns({"total_delta": F.round("total_delta", 4), "avg_delta": F.round("avg_delta", 6)})


@query("u02_timeline", V.with_(V.REQ, V.HEALTH, V.INC, _CHG) + """SELECT time, type, api_endpoint, coalesce(incident_id, -1) AS incident_id FROM (SELECT ts AS time, 'health_snapshot' AS type, api_endpoint, NULL::BIGINT AS incident_id FROM hea UNION ALL SELECT detected_at, 'incident', api_endpoint, id FROM inc UNION ALL SELECT after_ts, 'health_change', api_endpoint, incident_id FROM chg)""")
def timeline(spark, d):
    return I.timeline(V.health(spark, d), V.incidents(spark, d), _changes(spark, d)).select("time", "type", "api_endpoint", F.coalesce("incident_id", F.lit(-1)).alias("incident_id"))


@query("a37_time_span", V.with_(V.INC) + 'SELECT count(*) AS n, min(detected_at) AS start, max(detected_at) AS "end" FROM inc')
def time_span(spark, d):
    return I.time_span(V.incidents(spark, d), "detected_at")


@query("i13_attack_path", V.with_(V.REQ, V.HEALTH, V.INC, _KNOW, _CHG) + """, tgt AS (SELECT * FROM inc ORDER BY detected_at DESC, id DESC LIMIT 1)
 SELECT id, api_endpoint, severity, anomaly_type, disposition, confidence, coalesce((SELECT round(sum(health_delta), 4) FROM chg WHERE incident_id = tgt.id), 0e0) AS delta, (SELECT count(*) FROM kno WHERE kno.api_endpoint = tgt.api_endpoint) AS knowledge,
 (SELECT round(avg(effectiveness_score), 6) FROM kno WHERE kno.api_endpoint = tgt.api_endpoint) AS avg_effectiveness, (SELECT count(*) FROM inc WHERE inc.api_endpoint = tgt.api_endpoint AND inc.id <> tgt.id) AS nearby,
 severity || ' severity ' || anomaly_type || ' on ' || api_endpoint || ', disposition: ' || disposition || ', nearby: ' || (SELECT count(*) FROM inc WHERE inc.api_endpoint = tgt.api_endpoint AND inc.id <> tgt.id) AS summary FROM tgt""")
def attack_path(spark, d):
    x = V.incidents(spark, d)
    p = I.attack_path(x, I.latest_incident(x), _changes(spark, d), I.internalise(x))
    return p.withColumns({"delta": F.round("delta", 4), "avg_effectiveness": F.round("avg_effectiveness", 6)})


@query("i09_rebuild_knowledge", V.with_(V.INC, _KNOW) + f"""SELECT title, source_type, min(content) AS content, min(category) AS category FROM (
 SELECT 'Case: ' || anomaly_type || ' on ' || api_endpoint AS title, {_ADVICE} AS content, 'case' AS category, 'internalized_knowledge' AS source_type FROM kno
 UNION ALL SELECT 'Incidents of ' || anomaly_type, 'Severity ' || severity, 'case', 'incident' FROM inc
 UNION ALL SELECT 'Owner of /api/' || s_nationkey || '/*', 'Person ' || s_suppkey, 'role_insight', 'person_binding' FROM supplier
 UNION ALL SELECT 'Widespread ' || anomaly_type, count(DISTINCT api_endpoint) || ' endpoints', 'pattern', 'traceability' FROM inc GROUP BY anomaly_type HAVING count(DISTINCT api_endpoint) > 1) GROUP BY ALL""")
def rebuild(spark, d):
    x = V.incidents(spark, d)
    b = V.table(spark, d, "supplier").selectExpr("'/api/' || s_nationkey || '/*' AS api_pattern", "s_suppkey AS person_id")
    return I.rebuild_knowledge(I.internalise(x), x, b, I.widespread_types(x))


# ---- owners and knowledge entries


_BIND = "bnd AS (SELECT s_suppkey AS person_id, s_nationkey % 4 AS priority, CASE s_nationkey % 5 WHEN 0 THEN '*/en/*' WHEN 1 THEN '*/de/*' WHEN 2 THEN '*example.org*' WHEN 3 THEN '*/fr/?' ELSE '*//www.*' END AS api_pattern FROM supplier)"


def _bindings(spark, d):
    b = V.table(spark, d, "supplier").selectExpr("s_suppkey AS person_id", "s_nationkey % 4 AS priority", "CASE s_nationkey % 5 WHEN 0 THEN '*/en/*' WHEN 1 THEN '*/de/*' WHEN 2 THEN '*example.org*' WHEN 3 THEN '*/fr/?' ELSE '*//www.*' END AS api_pattern")
    return b, V.table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS id", "s_name AS name")


_OWN = """own AS (SELECT url AS endpoint, person_id, coalesce(s_name, 'Unknown') AS name, cast(row_number() OVER (PARTITION BY url ORDER BY priority DESC, length(api_pattern) DESC, person_id) AS INT) AS rank
 FROM (SELECT DISTINCT url FROM pages) JOIN bnd ON url GLOB api_pattern LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = person_id)"""


@query("j05_owners", V.with_(_BIND, _OWN) + "SELECT * FROM own")
def owners(spark, d):
    return I.owners(V.table(spark, d, "pages").withColumnRenamed("url", "endpoint"), *_bindings(spark, d))


@query("u08_responsible_persons", V.with_(_BIND, _OWN) + "SELECT person_id, name, count(*) AS endpoints FROM own GROUP BY ALL")
def persons(spark, d):
    return I.responsible_persons(V.table(spark, d, "pages").withColumnRenamed("url", "endpoint"), *_bindings(spark, d))


def _entries(spark, d):
    """Knowledge entries made of parts."""
    return V.table(spark, d, "part").selectExpr(
        "p_partkey AS id", "p_name AS title", "p_type AS content", "element_at(array('policy', 'case', 'pattern', 'role_insight', 'best_practice'), cast(p_partkey % 5 AS int) + 1) AS category",
        "element_at(array('CRITICAL', 'HIGH', 'MEDIUM'), cast(p_size % 3 AS int) + 1) AS severity", "array(p_brand, p_type) AS tags", "array('/api/' || p_size || '/*', '/x') AS affected_endpoints", "p_size / 50e0 AS effectiveness_score", "p_partkey % 11 <> 0 AS is_active",
    )


_ENT = "ent AS (SELECT p_partkey AS id, p_name AS title, p_type AS content, ['policy', 'case', 'pattern', 'role_insight', 'best_practice'][p_partkey % 5 + 1] AS category, ['CRITICAL', 'HIGH', 'MEDIUM'][p_size % 3 + 1] AS severity, [p_brand, p_type] AS tags, '/api/' || p_size || '/*' AS pat, p_size / 50e0 AS effectiveness_score, p_partkey % 11 <> 0 AS is_active FROM part)"


@query("p10_j06_search_entries", V.with_(_ENT) + "SELECT id, effectiveness_score FROM ent WHERE is_active AND category = 'case' AND effectiveness_score >= 0.1 AND '/api/7/users' GLOB pat")
def search_entries(spark, d):
    return I.search_entries(_entries(spark, d), category="case", least=0.1, endpoint="/api/7/users").select("id", "effectiveness_score")


_REL = """rel AS (SELECT *, round(least(1e0, CASE WHEN category = 'policy' THEN 0.3e0 ELSE 0e0 END + CASE WHEN contains(lower(tags[1]), 'brand') OR contains(lower(tags[2]), 'brand') THEN 0.15e0 ELSE 0e0 END + CASE WHEN '/api/7/users' GLOB pat THEN 0.2e0 ELSE 0e0 END
 + CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 0.15e0 ELSE 0e0 END + effectiveness_score * 0.1e0), 6) AS relevance FROM ent WHERE is_active)"""


def _scored(spark, d):
    return _entries(spark, d).filter("is_active").withColumn("relevance", F.round(I.relevance(["brand"], ["/api/7/users"], ["CRITICAL", "HIGH"]), 6))


@query("r06_relevance", V.with_(_ENT, _REL) + "SELECT id, relevance FROM rel")
def relevance(spark, d):
    return _scored(spark, d).select("id", "relevance")


@query("k04_capped_entries", V.with_(_ENT, _REL) + "SELECT id, category, relevance FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY relevance DESC, id) AS r FROM rel) WHERE r <= 5 ORDER BY relevance DESC, id LIMIT 15")
def capped(spark, d):
    return I.capped_by_category(_scored(spark, d)).select("id", "category", "relevance")


@query("r07_context_text", V.with_(_ENT, _REL) + "SELECT category, string_agg('[' || severity || '] ' || title, chr(10) ORDER BY relevance DESC, id) AS text FROM rel GROUP BY 1")
def context(spark, d):
    return I.context_text(_scored(spark, d))


@query("a24_entry_stats", V.with_(_ENT) + "SELECT category, severity, count(*) AS n, round(avg(effectiveness_score), 6) AS avg_effectiveness, max(effectiveness_score) AS max_effectiveness FROM ent WHERE is_active GROUP BY ALL")
def entry_stats(spark, d):
    return _entries(spark, d).filter("is_active").groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("effectiveness_score"), 6).alias("avg_effectiveness"), F.max("effectiveness_score").alias("max_effectiveness"))


_LINES = """lin AS (SELECT 0 AS section, row_number() OVER (ORDER BY api_endpoint) AS ord, '| ' || api_endpoint || ' | ' || n || ' |' AS line FROM (SELECT api_endpoint, count(*) AS n FROM inc GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10)
 UNION ALL SELECT 1, row_number() OVER (ORDER BY anomaly_type), '| ' || anomaly_type || ' | ' || n || ' |' FROM (SELECT anomaly_type, count(DISTINCT api_endpoint) AS n FROM inc GROUP BY 1 HAVING count(DISTINCT api_endpoint) > 1)
 UNION ALL SELECT 2, 1, '| ' || count(*) || ' | ' || count(*) FILTER (severity = 'CRITICAL') || ' | ' || count(*) FILTER (severity = 'HIGH') || ' | ' || count(*) FILTER (severity = 'MEDIUM') || ' | ' || count(*) FILTER (severity = 'LOW') || ' | ' || count(*) FILTER (severity = 'INFO') || ' | ' || count(DISTINCT api_endpoint) || ' | ' || count(*) FILTER (disposition = 'auto_block') || ' |' FROM inc)"""


@query("s22_report_lines", V.with_(V.INC, _LINES) + "SELECT section::INT AS section, ord, line FROM lin UNION ALL SELECT i::INT, -1, '## ' || ['Top endpoints', 'Widespread types', 'Summary'][i + 1] FROM range(3) t(i)")
def report_lines(spark, d):
    x = V.incidents(spark, d)
    return L.report_lines({"Top endpoints": I.attack_patterns(x), "Widespread types": I.widespread_types(x), "Summary": I.executive_summary(x)})


_BATCH = [
    "chb AS (SELECT inc.id, b.health_score AS hb, a.health_score AS ha FROM inc ASOF JOIN hea b ON inc.api_endpoint = b.api_endpoint AND inc.detected_at >= b.ts ASOF JOIN hea a ON inc.api_endpoint = a.api_endpoint AND inc.detected_at < a.ts)",
    "imp AS (SELECT inc.* EXCLUDE (health_delta), round(hb, 6) AS health_before, round(ha, 6) AS health_after, coalesce(round(ha - hb, 4), 0e0) AS health_delta FROM inc LEFT JOIN chb USING (id))",
    _KNOW.replace("FROM inc)", "FROM imp)"),
    "rul AS (SELECT s_suppkey AS person_id, s_nationkey % 4 AS priority, '/api/' || CASE s_nationkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'purchase' ELSE '*' END || '/*' AS api_pattern FROM supplier)",
    "fst AS (SELECT api_endpoint, person_id FROM (SELECT api_endpoint, person_id, row_number() OVER (PARTITION BY api_endpoint ORDER BY priority DESC, length(api_pattern) DESC, person_id) AS r FROM (SELECT DISTINCT api_endpoint FROM inc) JOIN rul ON api_endpoint GLOB api_pattern) WHERE r = 1)",
    "own AS (SELECT api_endpoint, person_id, coalesce(s_name, 'Unknown') AS owner FROM fst LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = person_id)",
]


@query("i02_incident_batch", V.with_(V.REQ, V.HEALTH, V.INC, *_BATCH) + f"SELECT id, api_endpoint, disposition, person_id, owner, health_before, health_after, health_impact, {_PATTERN} AS learned_pattern, {_ADVICE} AS recommendation, effectiveness_score, {_EXPLAIN} AS explanation FROM kno LEFT JOIN own USING (api_endpoint)")
def incident_batch(spark, d):
    rules = V.table(spark, d, "supplier").selectExpr("s_suppkey AS person_id", "s_nationkey % 4 AS priority", "'/api/' || CASE s_nationkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'purchase' ELSE '*' END || '/*' AS api_pattern")
    x = I.incident_batch(V.incidents(spark, d).drop("disposition", "health_delta"), V.health(spark, d), rules, _bindings(spark, d)[1], _templates(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("health_before", "health_after")]
    return x.select("id", "api_endpoint", "disposition", "person_id", "owner", *rounded, "health_impact", "learned_pattern", "recommendation", "effectiveness_score", "explanation")


@query("p05_suspicious", V.with_(V.REQ, _STAGES) + "SELECT log_id, probability FROM s1 WHERE predicted_label = 1")
def suspicious(spark, d):
    return I.suspicious(_stages(spark, d)[0]).select("log_id", "probability")


@query("p15_anomalies", V.with_(V.REQ, _STAGES, _GRADE) + "SELECT log_id, severity, source FROM grd WHERE final_verdict = 'anomaly'")
def anomalies(spark, d):
    return I.anomalies(I.grade(*_stages(spark, d))).select("log_id", "severity", "source")


@query("p16_sync_severity", V.with_(V.INC) + "SELECT anomaly_type, CASE WHEN regexp_matches(anomaly_type, 'injection|traversal') THEN 'CRITICAL' WHEN contains(anomaly_type, 'scripting') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS n FROM inc GROUP BY ALL")
def sync(spark, d):
    t = F.col("anomaly_type")
    s = F.when(contains_any(t, ["injection", "traversal"]), "CRITICAL").when(contains_any(t, ["scripting"]), "HIGH").otherwise("MEDIUM")
    return V.incidents(spark, d).select("anomaly_type", s.alias("severity")).groupBy("anomaly_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("i14_correlation", V.with_(V.INC) + """SELECT (SELECT count(*) FROM inc) AS total_incidents, (SELECT count(DISTINCT api_endpoint) FROM inc) AS unique_apis,
 (SELECT count(*) FROM (SELECT date_trunc('minute', detected_at) AS m FROM inc GROUP BY 1 HAVING count(DISTINCT api_endpoint) > 3)) AS mass_attack_windows,
 (SELECT count(*) FROM (SELECT anomaly_type FROM inc GROUP BY 1 HAVING count(DISTINCT api_endpoint) > 1)) AS widespread_attack_types""")
def correlation(spark, d):
    return I.correlation(V.incidents(spark, d))


@query("a43_dashboard", V.with_(V.REQ, V.HEALTH, V.INC, _KNOW, _CHG) + """SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
 count(*) FILTER (severity = 'INFO') AS info, count(DISTINCT api_endpoint) AS apis, count(*) FILTER (disposition = 'auto_block') AS blocked, (SELECT count(*) FROM kno) AS knowledge, (SELECT round(avg(effectiveness_score), 6) FROM kno) AS avg_effectiveness, (SELECT count(*) FROM chg) AS changes FROM inc""")
def dashboard(spark, d):
    x = V.incidents(spark, d)
    return I.dashboard(x, I.internalise(x), _changes(spark, d)).withColumn("avg_effectiveness", F.round("avg_effectiveness", 6))


@query("i10_seed_policies", V.with_(_ENT) + "SELECT title, count(*) AS n FROM (SELECT title FROM ent UNION ALL SELECT r_name FROM region WHERE r_name NOT IN (SELECT title FROM ent)) GROUP BY 1")
def seed_policies(spark, d):
    e = I.seed_policies(_entries(spark, d).select("id", "title"), V.table(spark, d, "region").selectExpr("r_name AS title"))
    return e.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("i11_report_feedback", V.with_(V.INC, _KNOW) + "SELECT DISTINCT 'Best practice: ' || anomaly_type AS title, 'best_practice' AS category FROM kno")
def feedback(spark, d):
    return I.report_feedback(I.internalise(V.incidents(spark, d)), _entries(spark, d)).select("title", "category")


@query("i12_usage_counts", V.with_(_ENT, _REL) + "SELECT ent.id, coalesce(u.n, 0) AS usage_count FROM ent LEFT JOIN (SELECT id, count(*) AS n FROM rel WHERE relevance > 0.3 GROUP BY 1) u USING (id)")
def usage(spark, d):
    return I.count_usage(_entries(spark, d).select("id", F.lit(0).alias("usage_count")), _scored(spark, d).filter("relevance > 0.3")).select("id", F.col("usage_count").cast("long").alias("usage_count"))


@query("i16_enriched_insights", V.with_(V.INC, _KNOW, _ENT, _REL) + """SELECT anomaly_type AS incident_type, count(*) AS n, (SELECT title FROM rel WHERE category = 'policy' ORDER BY relevance DESC, id LIMIT 1) AS policy, (SELECT title FROM rel WHERE category = 'pattern' ORDER BY relevance DESC, id LIMIT 1) AS pattern FROM kno GROUP BY 1""")
def insights(spark, d):
    return I.enriched_insights(I.internalise(V.incidents(spark, d)), _scored(spark, d)).select("incident_type", "n", "policy", "pattern")


@query("k08_last_events", V.with_(V.INC) + "SELECT id, detected_at FROM inc ORDER BY detected_at DESC, id DESC LIMIT 20")
def last_events(spark, d):
    return I.history(V.incidents(spark, d), n=20).select("id", "detected_at")


@query("i15_posture_breakdown", V.with_(V.INC) + "SELECT api_endpoint, severity, disposition, count(*) AS n FROM inc GROUP BY ALL")
def posture(spark, d):
    x = V.incidents(spark, d)
    p = I.posture(x, _changes(spark, d), I.internalise(x), *_bindings(spark, d))
    return p["breakdown"].filter("level = 0").drop("level")
