"""Scans composed of cells give the rows of windows over whole keys, and no group is a whole key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.operators import incidents as I
from wardline.operators import scans, sessions

T0 = dt.datetime(2024, 1, 1)


def _log(spark, n=3000, seed=1):
    """A third of the rows are one address that hardly rests; null addresses, ties of time, nulls of time and path."""
    rng, t = random.Random(seed), 0
    rows = []
    for i in range(n):
        ip = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        t += rng.choice([0, 0, 1, 2, 5, 30, 61]) if ip == "hot" else rng.choice([0, 3])
        rows.append((i, ip, None if rng.random() < 0.01 else T0 + dt.timedelta(seconds=t, microseconds=rng.choice([0, 500_000])), rng.choice(["/a", "/a", "/b", None]), "GET", rng.choice([200, 401, 500]), "curl/8", "x"))
    return spark.createDataFrame(rows, "log_id long, source_ip string, ts timestamp, path string, method string, status int, user_agent string, category string").cache()


@pytest.fixture(scope="module")
def log(spark):
    return _log(spark)


def _same(a, b, keys=("log_id",)):
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (a, b))
    assert a == b


@pytest.mark.parametrize("seconds", [7, 600, 10**9])
def test_sessions_equal_whole_windows(log, seconds):
    got = sessions.stitch(log, 30, cell_seconds=seconds).select("log_id", "session_no", "session_start")
    w = Window.partitionBy("source_ip").orderBy("ts", "log_id")
    x = log.filter("ts is not null").withColumn("n", F.when((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6 > 30, 1).otherwise(0))
    x = x.withColumn("session_no", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    _same(got, x.select("log_id", "session_no", F.min("ts").over(Window.partitionBy("source_ip", "session_no"))))


@pytest.mark.parametrize("seconds", [7, 600])
def test_runs_counts_and_repeats_equal_whole_windows(log, seconds):
    x = log.filter("ts is not null")
    w = Window.partitionBy("source_ip").orderBy(F.unix_micros("ts"))
    plain = x.select("log_id", *(F.count(F.lit(1)).over(w.rangeBetween(-s * 1_000_000, 0)) for s in (1, 5)))
    _same(scans.recent_counts(x, ["source_ip"], "ts", {"p1": 1, "p5": 5}, seconds).select("log_id", "p1", "p5"), plain)
    w = Window.partitionBy("source_ip", "path").orderBy("ts", "log_id")
    _same(sessions.repeated_path_count(x, "source_ip", seconds).select("log_id", "repetitive_path_count"), x.select("log_id", F.row_number().over(w) - 1))
    o = Window.partitionBy("source_ip").orderBy("ts", "log_id")
    runs = x.withColumn("r", F.row_number().over(o) - F.row_number().over(w)).groupBy("source_ip", "path", "r").count().groupBy("source_ip").agg(F.max("count") - 1)
    _same(sessions.longest_path_runs(x, "source_ip", seconds), runs)


def test_features_do_not_depend_on_the_cells(log):
    x = log.withColumn("session_id", F.coalesce("source_ip", F.lit("none")))
    _same(sessions.session_features(x, cell_seconds=11), sessions.session_features(x, cell_seconds=10**9))


def test_no_group_is_a_whole_key(log):
    """The hot address has a third of the rows; no cell of it has more than a fortieth of those."""
    cells = scans.in_cells(log.filter("ts is not null"), ["source_ip"], "ts", 60)
    hot = cells.filter("source_ip = 'hot'")
    assert hot.groupBy(scans.CELL).count().agg(F.max("count")).first()[0] <= hot.count() / 40
    plan = sessions.stitch(log, 30, cell_seconds=60)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" :+-").startswith("Window ")]
    assert windows and all(scans.CELL in line for line in windows)


def test_small_keys_are_scanned_whole_and_large_ones_in_cells(log, monkeypatch):
    """Sessions and features are the same where all addresses are small, where one is large, and where all go in cells."""
    x = log.withColumn("category", F.coalesce("category", F.lit("normal")))
    cut = lambda **k: sessions.with_session_id(sessions.stitch(x, 30, **k))
    want = cut(cell_seconds=60)
    features = sessions.session_features(want, cell_seconds=60)
    _same(cut().select(want.columns), want)
    _same(sessions.session_features(cut(), within=("source_ip",)), features)
    monkeypatch.setattr(scans, "WHOLE", 900, raising=False)
    few, many = scans.split_keys(x, ["source_ip"])
    assert {r[0] for r in many.select("source_ip").distinct().collect()} == {"hot"} and few.count() + many.count() == x.count()
    _same(cut().select(want.columns), want)
    _same(sessions.session_features(cut(), within=("source_ip",)), features)


def test_features_of_small_sessions_move_rows_once(log):
    """From the log to features by address: one shuffle, and the log is read once."""
    f = sessions.session_features(sessions.with_session_id(sessions.stitch(log, 30)), within=("source_ip",))
    plan = f._jdf.queryExecution().sparkPlan().toString(), f._jdf.queryExecution().executedPlan().toString()
    assert plan[1].count("Exchange hashpartitioning") == 1 and "Join" not in plan[0]


# ---- health


def _records(spark, n=400):
    rng = random.Random(2)
    day = lambda i: T0 + dt.timedelta(hours=6 * (i // 3))
    rows = [(i, "hot" if i % 3 == 0 else rng.choice("ab"), day(i), rng.choice([0, 10, 10, 20]), rng.randint(0, 8), rng.randint(0, 5), rng.choice([0.0, 5.0, 7.5, 40.0]), rng.choice([0, 3, 40]), round(rng.random(), 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, api_endpoint string, ts timestamp, total_requests int, anomaly_count int, errors int, avg_rt double, incidents_24h int, health_score double")
    return df.withColumn("status", I.health_status("health_score"))


def _score(r, past, incidents, status):
    n = r.total_requests
    s = 1.0 - (r.anomaly_count / n * 0.7 if n else 0) - (r.errors / n * 0.4 if n else 0)
    base = [t for t in past if t > 0]
    slow = r.avg_rt / (sum(base) / len(base)) if r.avg_rt > 0 and base else 0
    s -= min((slow - 1.5) * 0.15, 0.2) if slow > 1.5 else 0
    return round(max(0.0, min(1.0, s - min(incidents * 0.01, 0.3) - (0.1 if status in ("degraded", "critical") else 0))), 6)


@pytest.mark.parametrize("seconds", [3600, 86_400 * 5, 10**10])
def test_health_history_equals_a_fold(spark, seconds):
    records = _records(spark)
    got = {r.id: r for r in I.with_history(records, cell_seconds=seconds).withColumn("s", I.health_score()).collect()}
    new = {r.id: r for r in I.rescore(records, cell_seconds=seconds).collect()}
    seen = {}
    for r in sorted(records.collect(), key=lambda r: (r.ts, r.id)):
        past, status, again = seen.get(r.api_endpoint, ([], None, None))
        base = [t for t in past if t > 0]
        assert got[r.id].previous_status == status and (got[r.id].baseline_rt is None) == (not base)
        assert not base or abs(got[r.id].baseline_rt - sum(base) / len(base)) < 1e-9
        assert abs(got[r.id].s - _score(r, past, r.incidents_24h, status)) < 2e-6
        x = _score(r, past, r.incidents_24h, again)
        moved = abs(x - r.health_score) > 0.001
        again = ("normal" if x >= 0.8 else "degraded" if x >= 0.5 else "critical") if moved else r.status
        assert new[r.id].new_status == again and abs(new[r.id].new_score - (x if moved else r.health_score)) < 1e-4
        seen[r.api_endpoint] = ([*past, r.avg_rt][-10:], r.status, again)


@pytest.mark.parametrize("seconds", [3600, 10**10])
def test_health_changes_look_over_cells(spark, seconds):
    records = _records(spark, 120)
    rng = random.Random(5)
    inc = [(i, rng.choice(["hot", "a", "none"]), T0 + dt.timedelta(hours=rng.randint(-5, 300)), "auto_log") for i in range(150)]
    x = I.health_changes(spark.createDataFrame(inc, "id long, api_endpoint string, detected_at timestamp, disposition string"), records.dropDuplicates(["api_endpoint", "ts"]), cell_seconds=seconds)
    got = {r.incident_id: (r.before.ts, r.after.ts) for r in x.collect()}
    times = {}
    for r in records.collect():
        times.setdefault(r.api_endpoint, set()).add(r.ts)
    want = {}
    for i, e, t, _ in inc:
        a, b = [s for s in times.get(e, ()) if s <= t], [s for s in times.get(e, ()) if s > t]
        if a and b:
            want[i] = (max(a), min(b))
    assert got == want


def test_scores_on_the_limits(spark):
    """0.7 of anomalies and 0.01 an incident add up to 0.8 and 0.5 in any order: never just below."""
    rows = [(k, 10, a, 0, inc) for k, (a, inc) in enumerate([(2, 6), (4, 22), (1, 13), (5, 15), (0, 20)])]
    df = spark.createDataFrame(rows, "id int, total_requests int, anomaly_count int, errors int, incidents_24h int").selectExpr("*", "0.0D as avg_rt", "cast(null as double) as baseline_rt", "'normal' as previous_status")
    got = [(r.s, r.t) for r in df.withColumn("s", I.health_score()).withColumn("t", I.health_status("s")).orderBy("id").collect()]
    assert got == [(0.8, "normal"), (0.5, "degraded"), (0.8, "normal"), (0.5, "degraded"), (0.8, "normal")]
