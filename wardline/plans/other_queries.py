"""Queries over documents, labels, embeddings, conversations and the trade tables; models and streams."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import graph as G
from wardline.operators import metrics as M
from wardline.operators import models as Mo
from wardline.operators import retrieval as R
from wardline.operators import sessions as Se
from wardline.plans import views as V
from wardline.sources import logs as L
from wardline.storage import new_path
from wardline.streaming import twins as X

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- metrics on labels

_LAB = "lab AS (SELECT quality AS y, toxic AS p, (doc_id * 37 % 1000) / 1000e0 AS score, doc_id % 3 AS grp FROM labels)"


def _labels(spark, d) -> DataFrame:
    return V.table(spark, d, "labels").selectExpr("quality AS y", "toxic AS p", "(doc_id * 37 % 1000) / 1000e0 AS score", "doc_id % 3 AS grp")


_CM = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn, count(*) FILTER (y <> 1 AND p <> 1) AS tn"
_METRICS = "tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr"


@query("a07_confusion", V.with_(_LAB) + f"SELECT grp, {_METRICS} FROM (SELECT grp, {_CM} FROM lab GROUP BY 1)")
def confusion(spark, d):
    return M.confusion(_labels(spark, d), by=["grp"])


@query("a08_roc_auc", V.with_(_LAB) + """SELECT grp, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
 SELECT grp, score, count(*) FILTER (y = 1)::DOUBLE AS pos, count(*) FILTER (y <> 1)::DOUBLE AS neg FROM lab GROUP BY ALL)) GROUP BY 1""")
def auc(spark, d):
    return M.roc_auc(_labels(spark, d), by=["grp"])


@query("a12_one_vs_rest", V.with_(V.REQ, "ovr AS (SELECT unnest([{'detector': 'any', 'y': (category LIKE '%crawler')::INT, 'p': (status >= 400)::INT}, {'detector': 'bad', 'y': (category = 'malicious_crawler')::INT, 'p': (status = 403)::INT}], recursive := true) FROM req)") + f"SELECT detector, {_METRICS} FROM (SELECT detector, {_CM} FROM ovr GROUP BY 1)")
def one_vs_rest(spark, d):
    r = V.requests(spark, d)
    one = lambda n, y, p: r.select(F.lit(n).alias("detector"), F.when(y, 1).otherwise(0).alias("y"), F.when(p, 1).otherwise(0).alias("p"))
    x = one("any", F.col("category").endswith("crawler"), F.col("status") >= 400).union(one("bad", F.col("category") == "malicious_crawler", F.col("status") == 403))
    return M.confusion(x, by=["detector"])


@query("a41_j17_paired_lengths", "SELECT source AS category, count(*) AS n, avg(la) AS avg_a, avg(lb) AS avg_b, avg(lb - la) AS avg_diff, count(*) FILTER (la = 0) AS empty_a, count(*) FILTER (lb = 0) AS empty_b FROM (SELECT source, length(text) AS la, length(text) // 2 AS lb FROM documents) GROUP BY 1")
def paired(spark, d):
    a = V.table(spark, d, "documents").selectExpr("doc_id AS id", "source AS category", "text AS answer")
    return M.paired_lengths(a, a.selectExpr("id", "left(answer, cast(length(answer) div 2 AS int)) AS answer"))


# ---- keyed tables

_CHANGES = "chg AS (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'X' || c_custkey END AS c_name, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 5 = 0)"


@query("s17_upsert", V.with_(_CHANGES) + "SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o FULL JOIN chg n ON o.c_custkey = n.c_custkey")
def upsert(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return L.upsert(c, c.filter("c_custkey % 5 = 0").selectExpr("c_custkey + 100 AS c_custkey", "case when c_custkey % 2 = 0 then 'X' || c_custkey end AS c_name", "c_acctbal * 2 AS c_acctbal"), "c_custkey")


@query("s18_insert_with_parent", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def with_parent(spark, d):
    return L.insert_with_parent(V.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), V.table(spark, d, "nation").filter("n_regionkey < 3"), "s_nationkey", "n_nationkey")


@query("s19_delete_cascade", "SELECT 'parent' AS kind, count(*) AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'child', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def cascade(spark, d):
    n = V.table(spark, d, "nation")
    p, c = L.delete_cascade(n, V.table(spark, d, "customer"), n.filter("n_regionkey = 2"), "n_nationkey", "c_nationkey")
    one = lambda k, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("parent", p).union(one("child", c))


@query("j15_insert_absent", "SELECT s_nationkey AS k, 'old' AS src FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_nationkey, 'new' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")
def insert_absent(spark, d):
    old = V.table(spark, d, "supplier").filter("s_suppkey % 2 = 0").selectExpr("s_nationkey AS k", "'old' AS src")
    return L.insert_absent(old, V.table(spark, d, "customer").selectExpr("c_nationkey AS k", "'new' AS src"), ["k"])


@query("j16_restrict_to_targets", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def restrict(spark, d):
    return V.table(spark, d, "documents").join(V.table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("a20_orders_by_region", """SELECT n_name, c_mktsegment, o_orderpriority, count(*) AS n, cast(grouping(n_name, c_mktsegment, o_orderpriority) AS BIGINT) AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 GROUP BY GROUPING SETS ((n_name, c_mktsegment, o_orderpriority), (n_name, c_mktsegment), (n_name), ())""")
def orders_by_region(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderpriority").join(V.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    o = o.join(V.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return o.groupingSets([["n_name", "c_mktsegment", "o_orderpriority"], ["n_name", "c_mktsegment"], ["n_name"], []], "n_name", "c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


# ---- retrieval

_KNN = """knn AS (SELECT query_id, base_id, distance, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, b.vec_id AS base_id,
 round(1 - list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id))"""


def _vectors(spark, d):
    """The stated queries, ids divisible by 50, and the base, all rows."""
    e = V.table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "base_id")


def _knn(spark, d, k):
    return R.knn_join(*_vectors(spark, d), k, but_itself=True)


@query("j10_knn_join", V.with_(_KNN) + "SELECT query_id, base_id, distance, rank FROM knn WHERE rank <= 3")
def knn(spark, d):
    return _knn(spark, d, 3).withColumn("distance", F.round("distance", 6))


@query("r03_similar_events", V.with_(_KNN) + "SELECT query_id, base_id, round(1 - distance, 6) AS similarity, rank FROM knn WHERE rank <= 3 AND 1 - distance >= 0.3")
def similar(spark, d):
    return R.similar_events(*_vectors(spark, d), 3, 0.3, but_itself=True).withColumn("similarity", F.round("similarity", 6))


@query("u06_first_hits", V.with_(_KNN) + "SELECT doc_id, query_no FROM (SELECT base_id AS doc_id, query_id AS query_no, row_number() OVER (PARTITION BY base_id ORDER BY query_id, rank) AS r FROM knn WHERE rank <= 3) WHERE r = 1")
def first_hits(spark, d):
    return R.first_hits(_knn(spark, d, 3).select(F.col("base_id").alias("doc_id"), F.col("query_id").alias("query_no"), "rank")).select("doc_id", "query_no")


_LAY = """lay AS (SELECT query_id, base_id % 7 AS t, distance FROM knn WHERE rank = 1)"""


@query("m11_layered_type", V.with_(_KNN, _LAY) + """SELECT query_id, CASE WHEN distance < 0.55 AND t < 2 THEN CASE t WHEN 0 THEN 'unauthorized access attack' ELSE 'sensitive data leakage' END WHEN distance < 0.6 AND distance - 0.4 < 0.20 THEN 'type' || t WHEN distance < 0.66 THEN 'know' || t ELSE 'injection attack' END AS attack_type,
 CASE WHEN distance < 0.55 AND t < 2 THEN 'semantic' WHEN distance < 0.6 AND distance - 0.4 < 0.20 THEN 'pattern' WHEN distance < 0.66 THEN 'knowledge' ELSE 'regex' END AS layer FROM lay""")
def layered(spark, d):
    x = _knn(spark, d, 1).select("query_id", (F.col("base_id") % 7).alias("t"), F.round("distance", 6).alias("distance"))
    near = lambda most: F.when(F.col("distance") < most, F.col("distance") - 0.4)
    x = x.withColumns({
        "semantic_type": F.when(F.col("t") == 0, "unauthorized access attack").when(F.col("t") == 1, "sensitive data leakage").otherwise("other"), "semantic_distance": near(0.55),
        "pattern_type": F.concat(F.lit("type"), F.col("t").cast("string")), "pattern_distance": near(0.6), "knowledge_type": F.concat(F.lit("know"), F.col("t").cast("string")), "knowledge_distance": near(0.66),
        "regex_type": F.lit("injection attack"), "regex_confidence": F.lit(0.9),
    })
    y = x.select("query_id", R.layered_type().alias("x"))
    return y.select("query_id", F.col("x.type").alias("attack_type"), F.col("x.layer").alias("layer"))


@query("m12_semantic_candidates", V.with_(V.REQ) + "SELECT log_id, CASE WHEN contains(lower(path), '/admin') THEN 'admin' WHEN regexp_matches(lower(path), '/debug|/config|/\\.env|/actuator|/internal|/metrics') THEN 'debug' END AS question FROM req WHERE status >= 400")
def semantic(spark, d):
    return V.requests(spark, d).filter("status >= 400").select("log_id", R.semantic_candidate().alias("question"))


@query("r01_r02_index_rows", "SELECT content, md5(content) AS chunk_id, count(*) AS n FROM (SELECT 'source: ' || source || chr(10) || 'text: ' || text AS content FROM documents) WHERE trim(content) <> '' GROUP BY 1")
def index_rows(spark, d):
    c = R.chunk_documents(V.table(spark, d, "documents"), ["source", "text"], ["lang", "source"], "doc_id")
    n = c.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    return R.index_rows(c).join(n, "content").select("content", "chunk_id", "n")


@query("r04_default_embedding")
def embedding(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", R.hashed_embedding("text").alias("embedding"))


_TYPES = "['directory traversal attack', 'cross-site scripting attack', 'unauthorized access attack', 'injection attack', 'performance issue', 'sensitive data leakage', 'invalid item value']"


@query("r08_prompts", V.with_(V.REQ, """past AS (SELECT log_id, attack_type, string_agg(content, chr(10) ORDER BY r) AS past FROM (SELECT q.log_id, CASE q.k % 2 WHEN 0 THEN 'injection attack' ELSE 'performance issue' END AS attack_type, p.path AS content, row_number() OVER (PARTITION BY q.log_id ORDER BY q.log_id - p.log_id) AS r
   FROM req q JOIN req p ON p.log_id BETWEEN q.log_id - 3 AND q.log_id - 1 WHERE q.status = 500) WHERE r <= 2 GROUP BY ALL)""")
 + f"SELECT log_id, attack_type, 'Log ' || log_id || ': ' || path || ' [' || attack_type || '] past: ' || coalesce(past, 'none') AS prompt FROM req CROSS JOIN (SELECT unnest({_TYPES}) AS attack_type) LEFT JOIN past USING (log_id, attack_type) WHERE status = 500")
def prompts(spark, d):
    t = R.attack_type_table(spark).select("attack_type", F.concat(F.lit("Log {log_id}: {log} ["), "attack_type", F.lit("] past: {history}")).alias("template"))
    r = V.requests(spark, d)
    logs = r.filter("status = 500")
    kind = F.when(F.col("k") % 2 == 0, "injection attack").otherwise("performance issue")
    asked = logs.select("log_id", kind.alias("attack_type"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    past = asked.join(r.select(F.col("log_id").alias("_p"), F.col("path").alias("content")), F.col("log_id") - F.col("rank") == F.col("_p")).drop("_p")
    return R.prompt_table(logs.selectExpr("log_id", "path AS log_text"), t, past)


_REPLY = "'Number|Type' || chr(10) || CASE k % 5 WHEN 0 THEN log_id || '|normal' WHEN 1 THEN (log_id + 3) || '|anomaly|xss|1.7|bad tag' WHEN 2 THEN (log_id + 500) || '|Anomaly|leak' WHEN 3 THEN 'found|injection attack here' ELSE 'no bar here' END"


def _replies(spark, d):
    return V.requests(spark, d).filter("status >= 400").selectExpr("log_id", "case k % 2 when 0 then 'injection attack' else 'performance issue' end AS attack_type", f"{_REPLY.replace('chr(10)', 'char(10)')} AS content")


_PARSED = f"""par AS (SELECT log_id AS asked_id, attack_type, CASE r WHEN 1 THEN log_id + 3 ELSE log_id END AS log_id, CASE r WHEN 0 THEN 'normal' ELSE 'anomaly' END AS type, CASE r WHEN 0 THEN '' WHEN 1 THEN 'xss' WHEN 2 THEN 'leak' ELSE 'injection attack' END AS anomaly_type,
 CASE r WHEN 0 THEN 0.9e0 WHEN 1 THEN 1e0 WHEN 2 THEN 0.9e0 ELSE CASE WHEN attack_type = 'injection attack' THEN 0.85e0 ELSE 0.8e0 END END AS confidence, CASE r WHEN 1 THEN 'bad tag' ELSE '' END AS reason
 FROM (SELECT log_id, k % 5 AS r, CASE k % 2 WHEN 0 THEN 'injection attack' ELSE 'performance issue' END AS attack_type FROM req WHERE status >= 400) WHERE r < 4)"""


@query("r09_parse_replies", V.with_(V.REQ, _PARSED) + "SELECT * FROM par")
def parse(spark, d):
    return R.parse_replies(_replies(spark, d))


@query("r10_serial_verdict", V.with_(V.REQ, _PARSED) + "SELECT asked_id AS log_id, CASE WHEN type = 'anomaly' THEN 'anomaly' ELSE 'normal' END AS verdict, CASE WHEN type = 'anomaly' THEN anomaly_type ELSE '' END AS anomaly_type, CASE WHEN type = 'anomaly' THEN CASE attack_type WHEN 'injection attack' THEN 4 ELSE 5 END ELSE 7 END AS calls FROM par")
def serial(spark, d):
    return R.serial_verdict(R.parse_replies(_replies(spark, d)), R.attack_type_table(spark))


@query("r11_chat_format", "SELECT conv_id, count(*)::INT AS n_turns, string_agg('<' || role || '>: ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1")
def chat(spark, d):
    return R.format_chat(V.table(spark, d, "conversations"))


@query("r12_quota_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE (source = 'src1' AND r <= 50) OR (source = 'src2' AND r <= 30) OR (source = 'src3' AND r <= 20)")
def quota(spark, d):
    return R.quota_sample(V.table(spark, d, "documents"), {"src1": 50, "src2": 30, "src3": 20}, key="doc_id").select("doc_id", "source")


@query("r05_report_queries", "SELECT attack_type, query_no FROM (SELECT 'grp' || g AS attack_type, q AS query_no FROM range(3) t(g), range(3) u(q) WHERE g IN (SELECT doc_id % 3 FROM labels GROUP BY 1 HAVING avg(quality) < 0.9)) ORDER BY 1, 2 LIMIT 10")
def report_queries(spark, d):
    recall = V.table(spark, d, "labels").groupBy(F.concat(F.lit("grp"), (F.col("doc_id") % 3).cast("string")).alias("expected")).agg(F.avg("quality").alias("recall"))
    qs = recall.select(F.col("expected").alias("attack_type"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("query_no"))
    return R.report_queries(recall, qs, False, per_type=None)


@query("r05_first_questions", "SELECT 'grp' || g AS attack_type, cast(0 AS BIGINT) AS query_no FROM range(3) t(g) WHERE g IN (SELECT doc_id % 3 FROM labels GROUP BY 1 HAVING avg(quality) < 0.9) ORDER BY 1 LIMIT 10")
def first_questions(spark, d):
    recall = V.table(spark, d, "labels").groupBy(F.concat(F.lit("grp"), (F.col("doc_id") % 3).cast("string")).alias("expected")).agg(F.avg("quality").alias("recall"))
    return R.report_queries(recall, recall.select(F.col("expected").alias("attack_type"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("query_no")), False)


@query("r05_report_chunks", V.with_(_KNN) + "SELECT doc_id, query_no, rank FROM (SELECT base_id AS doc_id, query_id AS query_no, rank, row_number() OVER (PARTITION BY base_id ORDER BY query_id, rank) AS r FROM knn WHERE rank <= 3) WHERE r = 1 ORDER BY query_no, rank LIMIT 8")
def report_chunks(spark, d):
    return R.report_chunks(_knn(spark, d, 3).select(F.col("base_id").alias("doc_id"), F.col("query_id").alias("query_no"), "rank"))


# ---- graph


def _graph(spark, d):
    r, n, c = V.table(spark, d, "region"), V.table(spark, d, "nation"), V.table(spark, d, "customer")
    node = lambda df, k, p, label: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(label).alias("type"), F.col(df.columns[1]).alias("label"))
    nodes = G.build_nodes([node(r, "r_regionkey", "r", "region"), node(n, "n_nationkey", "n", "nation"), node(c, "c_custkey", "c", "customer")])
    edge = lambda df, a, pa, b, pb, t: df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"), F.lit(t).alias("type"))
    lost = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("r99").alias("dst"), F.lit("lost").alias("type"))
    return nodes, [edge(n, "n_nationkey", "n", "n_regionkey", "r", "in_region"), edge(c, "c_custkey", "c", "c_nationkey", "n", "in_nation"), lost]


_GRAPH = """nod AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer),
 edg AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer)"""


@query("g02_build_graph", V.with_(_GRAPH) + "SELECT src, dst, type FROM edg")
def build(spark, d):
    nodes, parts = _graph(spark, d)
    return G.build_edges(parts, nodes)


@query("g02_unknown_nodes", "SELECT 'r99' AS id, 'unknown' AS type, 'r99' AS label")
def unknown(spark, d):
    nodes, parts = _graph(spark, d)
    return G.unknown_nodes(nodes, G.build_edges(parts, nodes, "keep"))


_HOOD = "bth AS (SELECT src, dst FROM edg UNION SELECT dst, src FROM edg), h1 AS (SELECT DISTINCT dst AS id FROM bth WHERE src = 'n3'), h2 AS (SELECT DISTINCT dst AS id FROM bth JOIN h1 ON src = h1.id WHERE dst <> 'n3' AND dst NOT IN (SELECT id FROM h1)), hood AS (SELECT 'n3' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"


def _hood(spark, d):
    nodes, parts = _graph(spark, d)
    edges = G.build_edges(parts, nodes)
    return nodes, edges, G.neighbourhood(edges, nodes.filter("id = 'n3'"))


@query("g03_neighbourhood", V.with_(_GRAPH, _HOOD) + "SELECT id, hop FROM hood")
def neighbourhood(spark, d):
    return _hood(spark, d)[2]


@query("g03_induced_edges", V.with_(_GRAPH, _HOOD) + "SELECT src, dst, type FROM edg WHERE src IN (SELECT id FROM hood) AND dst IN (SELECT id FROM hood)")
def induced(spark, d):
    _, edges, hood = _hood(spark, d)
    return G.induced_edges(edges, hood).select("src", "dst", "type")


@query("g04_fuzzy_find", V.with_(_GRAPH) + "SELECT id, type, label FROM nod WHERE contains(id, 'NATION_1') OR contains(label, 'NATION_1') ORDER BY id LIMIT 1")
def fuzzy(spark, d):
    return G.fuzzy_find(_graph(spark, d)[0], "NATION_1")


_WALK = """bth AS (SELECT src, dst FROM edg WHERE type = 'in_region' UNION SELECT dst, src FROM edg WHERE type = 'in_region'),
 wlk AS (SELECT 'n1' AS id, ['n1'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM wlk JOIN bth ON src = id WHERE NOT list_contains(path, dst) AND len(path) <= 10)"""


@query("g05_shortest_path", V.with_(_GRAPH, _WALK).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT (len(path) - 1)::INT AS length, array_to_string(path, '>') AS path FROM wlk WHERE id = 'n6' ORDER BY 1, 2 LIMIT 1")
def path(spark, d):
    nodes, parts = _graph(spark, d)
    return G.shortest_path(G.build_edges(parts, nodes), "n1", "n6")


@query("g06_impact", V.with_(_GRAPH, _HOOD) + "SELECT type, count(*) AS n FROM hood JOIN nod USING (id) WHERE hop > 0 GROUP BY 1")
def impact(spark, d):
    nodes, parts = _graph(spark, d)
    return G.impact(nodes, G.build_edges(parts, nodes), nodes.filter("id = 'n3'"))


@query("g07_statistics", V.with_(_GRAPH) + "SELECT 'node' AS kind, type, count(*)::DOUBLE AS value FROM nod GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edg GROUP BY 2 UNION ALL SELECT 'density', 'all', (SELECT count(*) FROM edg) / ((SELECT count(*) FROM nod) * ((SELECT count(*) FROM nod) - 1))")
def statistics(spark, d):
    nodes, parts = _graph(spark, d)
    return G.statistics(nodes, G.build_edges(parts, nodes))


@query("g08_k07_most_connected", V.with_(_GRAPH) + "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg) WHERE id LIKE 'n%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def connected(spark, d):
    nodes, parts = _graph(spark, d)
    return G.most_connected(nodes, G.build_edges(parts, nodes), "nation")


@query("s23_graph_export", V.with_(_GRAPH) + "SELECT 'node' AS kind, '{\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"label\":\"' || label || '\"}' AS json FROM nod UNION ALL SELECT 'edge', '{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"type\":\"' || type || '\"}' FROM edg")
def export(spark, d):
    nodes, parts = _graph(spark, d)
    return L.graph_export(nodes, G.build_edges(parts, nodes))


# ---- models


def _features(spark, d):
    return Se.session_features_wide(V.session_features(spark, d))


@query("m03_stratified_split", V.with_(V.REQ, V.SES, V.FEAT) + ", r AS (SELECT session_id, (true_category = 'malicious_crawler')::INT AS label, row_number() OVER (PARTITION BY (true_category = 'malicious_crawler') ORDER BY md5(session_id), session_id) AS i, count(*) OVER (PARTITION BY (true_category = 'malicious_crawler')) AS n FROM feat) SELECT session_id, label, i <= floor(n * 0.7e0) AS is_train FROM r")
def split(spark, d):
    from wardline.storage import materialise

    f = materialise(_features(spark, d).select("session_id", "label"), "session-labels")  # counted and ranked
    return Mo.stratified_split(f, "session_id", "label").select("session_id", "label", "is_train")


@query("m05_balanced_weights", V.with_(V.REQ, V.SES, V.FEAT) + "SELECT label, n, (SELECT count(*) FROM feat) / (2 * n) AS weight FROM (SELECT (true_category = 'malicious_crawler')::INT AS label, count(*) AS n FROM feat GROUP BY 1)")
def weights(spark, d):
    return Mo.class_weights(_features(spark, d).select("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


def _forest(spark, d, features=None):
    from wardline.storage import materialise

    f = materialise(_features(spark, d), "session-features") if features is None else Se.session_features_wide(features)
    f = materialise(Mo.stratified_split(f, "session_id", "label"), "session-split")
    return f, Mo.fit_forest(f.filter("is_train"), Se.FEATURES, trees=20, depth=6, key="session_id")


@query("m06_session_forest")
def forest(spark, d):
    f, model = _forest(spark, d)
    return Mo.predict(model, f.filter("not is_train")).select("session_id", "label", "p_attack", "pred")


@query("a40_feature_importance")
def importance(spark, d):
    return Mo.feature_importance(_forest(spark, d)[1], Se.FEATURES, spark)


@query("m08_isolation_forest")
def isolation(spark, d):
    return Mo.isolation_scores(_features(spark, d), Se.FEATURES, "session_id", trees=50)


@query("m10_m19_ensemble")
def ensemble(spark, d):
    from wardline.storage import materialise

    features = materialise(V.session_features(spark, d), "session-features")  # the rules read more of them than the forests
    f, model = _forest(spark, d, features)
    test = f.filter("not is_train")
    rf = materialise(Mo.predict(model, test).select("session_id", "label", "p_attack", "pred"), "forest-votes")
    iso = Mo.isolation_scores(test, Se.FEATURES, "session_id", trees=50)
    rule = Se.rule_verdicts(features)
    e = Mo.ensemble(rf, iso, rule).join(test.select("session_id", "label"), "session_id")
    return Mo.compare({
        "forest": rf.selectExpr("label AS y", "pred AS p", "p_attack AS score"),
        "isolation": iso.join(test.select("session_id", "label"), "session_id").selectExpr("label AS y", "pred AS p", "anomaly_score AS score"),
        "ensemble": e.selectExpr("label AS y", "pred AS p", "confidence AS score"),
        "rules": rule.join(test.select("session_id", "label"), "session_id").selectExpr("label AS y", "cast(verdict = 'malicious_crawler' AS int) AS p", "rule_score AS score"),
    })


@query("m07_request_cascade")
def request_forest(spark, d):
    from wardline.functions.requests import request_features
    from wardline.storage import materialise

    r = V.requests(spark, d).withColumn("request_url", F.col("path"))
    x = request_features(r, ("log_id", "category"))
    names = [c for c in x.columns if c not in ("log_id", "category")]
    x = materialise(x.withColumn("label", F.when(F.col("category").isin("normal", "legit_crawler"), 0).otherwise(1)), "request-features")
    model = Mo.fit_forest(x.filter("log_id % 10 < 7"), names, trees=20, depth=6, key="log_id")
    return Mo.predict(model, x.filter("log_id % 10 >= 7"), 0.1).select("log_id", "label", "p_attack", "pred")


# ---- streams: the event log read as a stream, to the end


def _stream(spark, d) -> DataFrame:
    raw = V.table(spark, d, "events")
    s = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return s.selectExpr(*V._columns(V.REQUEST, V._SPARK_K))


def _run(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    return X.run_once(df, new_path(spark, "stream-out"), new_path(spark, "stream-checkpoint"), mode)


@contextlib.contextmanager
def _rocks(spark):
    """The state store that arbitrary state needs, for the queries that are started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old)


_LATE = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM req)"


@query("x01_stream_ingest", V.with_(V.REQ) + "SELECT log_id, ts FROM req WHERE ts >= TIMESTAMP '2024-01-10'")
def ingest(spark, d):
    return _run(spark, X.ingest([_stream(spark, d)], since="2024-01-10").select("log_id", "ts"))


@query("x02_stream_sessions", V.with_(V.REQ, V.SES) + f", s AS (SELECT source_ip, min(ts) AS start, max(ts) AS last, count(*) AS n FROM ses GROUP BY source_ip, session_no) SELECT * FROM s WHERE last + INTERVAL {V.GAP} SECOND <= {_LATE}")
def stream_sessions(spark, d):
    return _run(spark, X.sessions(_stream(spark, d), f"{V.GAP} seconds"))


@query("x03_stream_peak_rate", V.with_(V.REQ) + """SELECT source_ip, start, count(*) AS n FROM (SELECT source_ip, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM req)
 WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM req) GROUP BY ALL""")
def stream_peaks(spark, d):
    return _run(spark, X.peak_rate(_stream(spark, d), "1 hour", "30 minutes"))


_DENSE = "den AS (SELECT '10.0.' || (user_id % 5) AS net, make_timestamp(epoch_us(ts) // 1000) AS ts FROM req)"


@query("x03_exact_peaks", V.with_(V.REQ, _DENSE) + """SELECT DISTINCT net, ts, count(*) OVER (PARTITION BY net, ts) AS n, count(*) OVER (PARTITION BY net ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND PRECEDING AND CURRENT ROW) AS peak_1s,
 count(*) OVER (PARTITION BY net ORDER BY ts RANGE BETWEEN INTERVAL 5 SECOND PRECEDING AND CURRENT ROW) AS peak_5s FROM den QUALIFY ts <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM den)""")
def stream_exact_peaks(spark, d):
    """The log a thousand times as dense, by network: spans of 1 and 5 seconds hold several requests."""
    s = _stream(spark, d).select(F.concat(F.lit("10.0."), (F.col("user_id") % 5).cast("string")).alias("net"), F.timestamp_micros(F.expr("unix_micros(ts) div 1000")).alias("ts"))
    with _rocks(spark):
        return _run(spark, X.exact_peaks(s, "net"))


@query("x04_stream_mass_attacks", V.with_(V.REQ) + f"SELECT minute, endpoints FROM (SELECT date_trunc('day', ts) AS minute, count(DISTINCT path)::INT AS endpoints FROM req GROUP BY 1) WHERE endpoints > 3 AND minute + INTERVAL 1 DAY <= {_LATE}")
def stream_mass(spark, d):
    return _run(spark, X.mass_attacks(_stream(spark, d), size="1 day"))


@query("x07_stream_without_repeats", V.with_(V.REQ) + "SELECT log_id, path FROM req")
def stream_distinct(spark, d):
    s = _stream(spark, d)
    return _run(spark, X.without_repeats(s.union(s)).select("log_id", "path"))


@query("x06_stream_upsert", V.with_(V.INC) + "SELECT id, detected_at, severity FROM inc ORDER BY detected_at DESC, id LIMIT 1000")
def stream_upsert(spark, d):
    raw = V.table(spark, d, "events")
    s = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet*").parquet(d).filter("event_type in ('error', 'purchase')")
    s = s.selectExpr(*V._columns({c: V.INCIDENT[c] for c in ("id", "detected_at", "severity")}, V._SPARK_K))
    folder = new_path(spark, "stream-incidents")
    X.upsert_incidents(s, folder, new_path(spark, "stream-checkpoint")).awaitTermination()
    return X.latest_version(spark, folder)


_RECORD = {"is_hit": "{k} >= 90", "api_endpoint": "event_type", "id": "event_id", "ts": "cast(ts AS timestamp)", "anomaly_count": "user_id % 4", "errors": "user_id % 2", "avg_rt": "value"}
_LIVE = f"""rec AS (SELECT {', '.join(V._columns(_RECORD, V._DUCK_K))} FROM events), seq AS (SELECT *, row_number() OVER w AS rn, avg(CASE WHEN avg_rt > 0 THEN avg_rt END) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base,
   count(*) FILTER (is_hit) OVER (PARTITION BY api_endpoint ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS hits FROM rec WINDOW w AS (PARTITION BY api_endpoint ORDER BY ts, id)),
 raw AS (SELECT *, 1e0 - anomaly_count / 10 * 0.7e0 - errors / 10 * 0.4e0 - CASE WHEN avg_rt > 0 AND avg_rt / base > 1.5 THEN least((avg_rt / base - 1.5e0) * 0.15e0, 0.2e0) ELSE 0e0 END - least(hits * 0.01e0, 0.3e0) AS s FROM seq),
 liv(api_endpoint, rn, id, health_score) AS (SELECT api_endpoint, rn, id, round(greatest(0e0, least(1e0, s)), 6) FROM raw WHERE rn = 1
   UNION ALL SELECT raw.api_endpoint, raw.rn, raw.id, round(greatest(0e0, least(1e0, raw.s - CASE WHEN liv.health_score < 0.8 THEN 0.1e0 ELSE 0e0 END)), 6) FROM liv JOIN raw ON raw.api_endpoint = liv.api_endpoint AND raw.rn = liv.rn + 1)"""


@query("x05_stream_health", V.with_(_LIVE).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT api_endpoint, id, health_score, CASE WHEN health_score >= 0.8 THEN 'normal' WHEN health_score >= 0.5 THEN 'degraded' ELSE 'critical' END AS status FROM liv")
def stream_health(spark, d):
    raw = V.table(spark, d, "events")
    s = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    s = s.selectExpr(*V._columns(_RECORD, V._SPARK_K), "10L AS total_requests")
    s = s.withColumn("is_incident", F.explode(F.when(F.col("is_hit"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    with _rocks(spark):
        return _run(spark, X.health(s))
