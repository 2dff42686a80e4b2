"""Golden rows and brute-force twins of what SQL doesn't express."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import requests as R
from wardline.functions import scalars as S
from wardline.operators import crawler as C
from wardline.operators import graph as G
from wardline.operators import incidents as I
from wardline.operators import models as Mo
from wardline.operators import sessions as Se
from wardline.operators.components import connected_components
from wardline.sources import logs as L


def _union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _union_find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_request_features_golden(spark):
    rows = [
        (0, "GET", "", "/api/test", "", "200", "50", "user"), (1, "POST", "<script>alert(1)</script>", "/api/search", "", "200", "50", "user"),
        (2, "GET", "", "/api/../../../etc/passwd", "", "200", "100", "guest"), (3, "DELETE", "", "/admin/delete", "", "200", "3000", "guest"), (4, None, None, None, None, None, "x", None),
    ]
    df = spark.createDataFrame(rows, "log_id long, method string, request_body string, request_url string, response_body string, status string, response_time string, user_identity string")
    f = {r.log_id: r for r in R.request_features(df).collect()}
    assert len(f[0]) == 43
    assert f[0].method_get == 1 and f[0].status_2xx == 1
    assert f[1].xss_score > 0
    assert f[2].dir_traversal_score > 0
    assert f[3].unauthorized_access_score > 0 and f[3].slow_response == 1 and f[3].very_slow_response == 0
    assert f[4].response_time_ms == 0 and f[4].total_payload_length == 0


def _log(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(microseconds=us) if us is not None else None, ip, p) for i, (us, ip, p) in enumerate(rows)], "log_id long, ts timestamp, source_ip string, path string")


def test_stitch_cuts_after_the_gap_only(spark):
    df = _log(spark, [(0, "a", "/x"), (60_000_000, "a", "/x"), (120_000_001, "a", "/x"), (None, "a", "/x"), (5, "b", "/x")])
    got = {r.log_id: r.session_no for r in Se.stitch(df, 60).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 4: 0}


def test_peak_and_runs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(30_000_000), rng.choice("ab"), rng.choice(["/x", "/y"])) for _ in range(120)]
    df = _log(spark, rows).withColumns({"session_id": F.col("source_ip"), "status": F.lit(200), "method": F.lit("GET"), "user_agent": F.lit("curl/8"), "category": F.lit("c")})
    got = {r.session_id: r for r in Se.session_features(df).collect()}
    for s in "ab":
        own = sorted((us, i, p) for i, (us, ip, p) in enumerate(rows) if ip == s)
        peak = max(sum(1 for u, _, _ in own if 0 <= t - u <= 5_000_000) for t, _, _ in own)
        run = best = 0
        for (_, _, a), (_, _, b) in zip(own, own[1:]):
            run = run + 1 if a == b else 0
            best = max(best, run)
        assert got[s].peak_rps_5s == pytest.approx(peak / 5, abs=1e-3)
        assert got[s].max_consecutive_same_path == best


def test_two_requests_at_once(spark):
    df = _log(spark, [(7, "a", "/x"), (7, "a", "/y")]).withColumns({"session_id": F.col("source_ip"), "status": F.lit(403), "method": F.lit("POST"), "user_agent": F.lit("Googlebot"), "category": F.lit("c")})
    r = Se.session_features(df).first()
    assert r.duration_sec == 0 and r.requests_per_second == 2 and r.auth_fail_count == 2 and r.known_crawler_ua_ratio == 1


def test_anchored_windows_equal_the_sequential_rule(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(4 * 86_400) * 1_000_000, "a", "/x") for _ in range(800)]
    got = {r.log_id: r.win for r in C.anchored_windows(_log(spark, rows), 600).collect()}
    start, want = None, {}
    epoch = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1e6)
    for us, i in sorted((us, i) for i, (us, _, _) in enumerate(rows)):
        if start is None or us - start > 600_000_000:
            start = us
        want[i] = start + epoch
    assert got == want


def test_fusion_shapes(spark):
    df = _log(spark, [(k * 1000, "a", f"/api/items/{k % 9}") for k in range(60)]).withColumn("session_id", F.concat(F.lit("malicious_scraper_"), (F.col("log_id") % 6).cast("string")))
    v = C.fusion(df, 5)
    rows = v.collect()
    assert len(rows) == 6 and all(r.in_cluster and r.cluster_size == 6 for r in rows)
    assert C.cluster_rollup(v).count() == 1
    assert C.global_assessment(v).first()["distributed_crawler_count"] + sum(r.determination != "distributed_crawler" for r in rows) == 6


@pytest.mark.parametrize(("severity", "confidence", "want"), [("CRITICAL", 0.95, "auto_block"), ("CRITICAL", 0.75, "notify_email"), ("HIGH", 0.0, "notify_email"), ("MEDIUM", 0.0, "notify_email"), ("LOW", 0.0, "auto_log"), ("INFO", 0.0, "none"), ("CRITICAL", 0.5, "auto_log")])
def test_disposition(spark, severity, confidence, want):
    df = spark.createDataFrame([(severity, confidence)], "severity string, confidence double")
    assert df.select(I.disposition()).first()[0] == want


def test_globs(spark):
    df = spark.createDataFrame([("/api/users/*", "/api/users/list"), ("/api/users/*", "/api/admin"), ("/a?c", "/abc"), ("/a[!b]c", "/abc"), ("/a[bx]c", "/abc"), ("/a.c", "/abc")], "g string, e string")
    got = [r[0] for r in df.select(F.rlike("e", S.glob_regex("g"))).collect()]
    assert got == [True, False, True, False, True, False]


def test_owner_priority(spark):
    b = spark.createDataFrame([("p1", 1, "/api/*"), ("p5", 5, "/api/users/*")], "person_id string, priority int, api_pattern string")
    p = spark.createDataFrame([("p5", "Ann")], "id string, name string")
    rows = I.owners(spark.createDataFrame([("/api/users/list",)], "endpoint string"), b, p).orderBy("rank").collect()
    assert [(r.person_id, r["name"]) for r in rows] == [("p5", "Ann"), ("p1", "Unknown")]


def test_health_score_follows_the_formula(spark):
    df = spark.createDataFrame([(90, 100, 0, 0.0, None, 0, None)], "anomaly_count int, total_requests int, errors int, avg_rt double, baseline_rt double, incidents_24h int, previous_status string")
    r = df.select(I.health_score().alias("s")).withColumn("t", I.health_status("s")).first()
    assert r.s == pytest.approx(0.37) and r.t == "critical"


def test_rescore_sees_the_new_status(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "/a", t0 + dt.timedelta(hours=i), 10, a, 0, 5.0, 0, 0.9, "normal") for i, a in enumerate([8, 2, 0])]
    df = spark.createDataFrame(rows, "id long, api_endpoint string, ts timestamp, total_requests int, anomaly_count int, errors int, avg_rt double, incidents_24h int, health_score double, status string")
    got = [(r.new_score, r.new_status) for r in I.rescore(df).orderBy("id").collect()]
    assert got == [(0.44, "critical"), (0.76, "degraded"), (0.9, "normal")]


def test_upsert_keeps_old_values_for_nulls(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, L.upsert(old, new, "k").collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", None)]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('method,request_body,request_url,response_body,status,response_time,user_identity,label\nGET,"a\nb",/x,,200,5,user,normal\n')
    good, bad = L.split_rejects(L.read_csv(spark, str(tmp_path / "a.csv")))
    assert good.first().request_body == "a\nb" and bad.count() == 0
    assert L.read_json_table(spark, str(tmp_path / "none.json"), L.API_LOG).count() == 0
    L.write_batches(spark.range(120).selectExpr("id", "id % 3 AS t").coalesce(1), str(tmp_path / "out"), 50)
    assert len(list((tmp_path / "out").glob("part-*"))) == 3


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("a", "d", "t"), ("d", "e", "t"), ("e", "c", "t"), ("x", "y", "t")], "src string, dst string, type string")
    assert tuple(G.shortest_path(edges, "a", "c").first()) == (2, "a>b>c")
    assert G.shortest_path(edges, "a", "y").count() == 0


def test_isolation_forest_finds_the_outlier(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(200)] + [(999, 12.0, -11.0)]
    s = Mo.isolation_scores(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], "id", trees=40, contamination=0.02)
    assert s.orderBy(F.desc("anomaly_score")).first().id == 999
    assert s.agg(F.sum("pred")).first()[0] <= 5


def test_partition_count_does_not_matter(spark):
    rng = random.Random(6)
    df = _log(spark, [(rng.randrange(10**9), rng.choice("abc"), rng.choice(["/x", "/y", "/z"])) for _ in range(300)])
    seen = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, Se.stitch(df, 5).select("log_id", "session_no").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_rest_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['wardline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries())"
    from pathlib import Path

    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, timeout=120).returncode == 0


def test_co_access_pairs_all_sessions_of_a_window(spark):
    import pyspark.sql.functions as F
    from wardline.operators import crawler

    rows = spark.range(700).select(F.format_string("s%04d", "id").alias("session_id"), F.lit(7).cast("long").alias("win"), F.lit("/p").alias("path"))
    edges = crawler.co_access(rows.union(rows.filter("session_id < 's0002'").withColumn("win", F.lit(8).cast("long"))))
    assert edges.count() == edges.distinct().count() == 700 * 699 // 2
    assert [tuple(r) for r in edges.filter("weight <> 1").collect()] == [("s0000", "s0001", 2)]
    scores = crawler.co_access_scores(crawler.clusters(edges), edges, rows).collect()
    assert len(scores) == 700 and all(r.co_access == 1 for r in scores)


@pytest.mark.parametrize("chunk", [16, 4096])
def test_knn_join_in_chunks_equals_brute_force(spark, chunk):
    from wardline.operators import retrieval

    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    out = retrieval.knn_join(rows.filter("id < 50").withColumnRenamed("id", "query_id"), rows.filter("id >= 50").withColumnRenamed("id", "base_id"), 3, chunk=chunk)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan and "Join Inner\n" not in plan
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(q, int(b) + 50, k + 1) for q in range(50) for k, b in enumerate(np.argsort(-(u[50:] @ u[q]))[:3])}
    assert {(r.query_id, r.base_id, r["rank"]) for r in out.collect()} == want


def test_anchored_windows_of_a_log_without_gaps(spark):
    rng = random.Random(2)
    times, t = [], 1_700_000_000_000_000
    for k in range(3000):
        t += rng.choice([0, 1, 300_000, 1_000_000, 1_200_000, 4_999_999, 5_000_000, 5_000_001] if k % 700 else [60_000_000])
        times.append(t)
    want, start = [], None
    for x in times:
        start = x if start is None or x - start > 5_000_000 else start
        want.append(start)
    d = spark.createDataFrame(list(enumerate(times)), "log_id long, us long").selectExpr("log_id", "timestamp_micros(us) AS ts")
    for cell in (1, 3, 720):
        assert [r.win for r in C.anchored_windows(d, 5, cell).orderBy("log_id").collect()] == want
    assert C.anchored_windows(d.limit(0)).count() == 0
