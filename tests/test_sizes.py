"""What must grow no faster than its input: owners by sets of globs, JSON arrays by blocks of rows."""

import random

from pyspark.sql import functions as F

from wardline.operators import incidents as I


def _owned(spark, seed):
    rng = random.Random(seed)
    urls = [f"/{rng.choice('ab')}/{rng.choice('xy')}/{k % 90}" for k in range(120)]
    bind = [(k % 40, rng.randint(0, 2), rng.choice(["/a/*", "/*/x/*", "*/1?", "/b/y/?", "/none/*", None])) for k in range(60)]
    e, b = spark.createDataFrame([(u,) for u in urls], "endpoint string"), spark.createDataFrame(bind, "person_id long, priority int, api_pattern string")
    return e, b, spark.createDataFrame([(k, f"P{k}") for k in range(0, 40, 3)], "id long, name string")


def _ranked(e, b, p):
    import fnmatch

    names, out = dict(map(tuple, p.collect())), []
    for u in {r[0] for r in e.collect()}:
        met = sorted((-r.priority, -len(r.api_pattern), r.person_id) for r in b.collect() if r.api_pattern is not None and fnmatch.fnmatchcase(u, r.api_pattern))
        out += [(u, x[2], names.get(x[2], "Unknown"), k + 1) for k, x in enumerate(met)]
    return sorted(out)


def test_owners_of_sets_of_globs(spark, monkeypatch):
    for seed, chunk in [(1, 1024), (2, 4)]:
        monkeypatch.setattr(I, "OWNER_CHUNK", chunk)
        args = _owned(spark, seed)
        want = _ranked(*args)
        assert sorted(map(tuple, I.owners(*args).collect())) == want and want
        by_person = {}
        for _, person, name, _ in want:
            by_person[person, name] = by_person.get((person, name), 0) + 1
        assert {(r[0], r[1]): r.endpoints for r in I.responsible_persons(*args).collect()} == by_person


def test_owners_expand_nothing_before_the_last_join(spark):
    """No window and no broadcast of endpoints by persons: counts need no pairs, and ranks are made once a set of globs."""
    e, b, p = _owned(spark, 3)
    counts = I.responsible_persons(e, b, p)._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count("Join") and "Window" not in counts
    assert "Window" not in I.owners(e, b, p)._jdf.queryExecution().optimizedPlan().toString()


def test_json_arrays_are_as_many_as_blocks_of_rows(spark, monkeypatch):
    from pathlib import Path

    from wardline.plans import source_queries as Q

    paths = []
    monkeypatch.setattr(Q, "new_path", lambda s, label, new=Q.new_path: paths.append(new(s, label)) or paths[-1])
    assert Q.json_arrays(spark, "/root/testdata/sf0.01").count() == 10_000
    files = list(Path(paths[0].removeprefix("file://")).glob("part-*"))
    assert 1 <= len(files) <= 2, len(files)  # one a source address before: 150


def test_exact_peaks_end_at_a_microsecond(spark, tmp_path):
    """The last time given out is the last event's less the lateness, to the microsecond, also where it is a key's only one."""
    import datetime as dt

    from wardline.storage import new_path
    from wardline.streaming import twins as X

    t0 = dt.datetime(2024, 1, 1)
    at = lambda us: t0 + dt.timedelta(microseconds=us)
    df = spark.createDataFrame([("a", at(10)), ("a", at(700)), ("b", at(700)), ("a", at(701)), ("c", at(999)), ("z", at(10_000_700))], "session_id string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = X.run_once(X.exact_peaks(X.read_stream(spark, str(tmp_path / "in"), df.schema), lateness="10 seconds"), new_path(spark, "t"), new_path(spark, "c"))
        got = sorted((r.session_id, r.ts, r.n, r.peak_1s) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [("a", at(10), 1, 1), ("a", at(700), 1, 2), ("b", at(700), 1, 1)]


def test_every_trusted_document_counts(spark):
    """No bound on the trusted documents: weights are those of all of them, and nothing is sampled."""
    from wardline.llm import rules

    labels = spark.range(41_000).selectExpr("id AS doc_id", "1 AS quality")
    assert rules.trusted_ids(labels.union(labels)).count() == 41_000
    docs = spark.range(41_000).selectExpr("id AS doc_id", "concat('w', id) AS text")
    assert not rules.bucket_weights(docs, labels, 64).any()  # all are trusted: both multinomials are the same


def test_peers_of_classes_of_windows(spark, monkeypatch):
    """Counts of peers are exact however many members a session's windows have, and copies of a session meet as one class."""
    from wardline.operators import crawler as C

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(8), rng.randint(1, 5))) for _ in range(40)]
    rows = [(w, f"s{k}_{c}") for k, s in enumerate(sets) for c in range(1 + k % 3 * 4) for w in s]
    met = {}
    for w, s in rows:
        met.setdefault(s, set()).update(p for v, p in rows if v == w and p != s)
    df = spark.createDataFrame(rows, "win long, session_id string")
    for long in (200, 3):
        monkeypatch.setattr(C, "LONG", long)
        assert {r.session_id: r.peers for r in C.peers_met(df, exact=1 if long == 200 else 10_000).collect()} == {s: len(p) for s, p in met.items()}


def _lower_bounds(df):
    """Lower bounds of the window frames in the plan, other than the start."""
    import re

    return [x for x in re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", df._jdf.queryExecution().optimizedPlan().toString().lower()) if not x.startswith("unbounded")]


def test_incidents_of_a_day_by_a_running_sum(spark):
    """Counts of closed days to the microsecond, equal times and days without records included; no frame that slides along the rows."""
    import datetime as dt

    rng, day, t0 = random.Random(12), 86_400_000_000, dt.datetime(2024, 1, 1)
    at = lambda us: None if us is None else t0 + dt.timedelta(microseconds=us)
    hits = [(rng.choice("ab"), rng.choice([0, day - 1, day, day + 1, 2 * day, rng.randrange(4 * day)])) for _ in range(200)] + [("c", day - 1), ("a", None)]
    recs = [(k, rng.choice("abd"), rng.choice([0, 1, day - 1, day, 2 * day, 2 * day + 1, rng.randrange(6 * day)])) for k in range(100)] + [(100, "c", 2 * day - 1), (101, "c", 2 * day), (102, "a", None)]
    r = spark.createDataFrame([(k, e, at(us)) for k, e, us in recs], "id long, api_endpoint string, ts timestamp")
    i = spark.createDataFrame([(e, at(us)) for e, us in hits], "api_endpoint string, detected_at timestamp")
    out = I.incidents_in_last_day(r, i)
    want = {k: sum(e == f and None not in (us, u) and u <= us <= u + day for f, u in hits) for k, e, us in recs}
    assert {x.id: x.incidents_24h for x in out.collect()} == want and want[100] == 1 and want[101] == 0
    assert not _lower_bounds(out)


def test_trusted_documents_meet_texts_in_one_way_at_any_size(spark):
    """No broadcast that gives way to a shuffle once the labels have grown, and no sort of texts."""
    from wardline.llm import rules

    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    out = rules.marked(docs, labels)
    assert sorted((bytes(r.t), r.good) for r in out.collect()) == [(b"", False), (b"a", True), (b"b", True), (b"c", False), (b"d", False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_health_state_holds_arrays(monkeypatch):
    """Scores of many blocks and batches are those of one record at a time, and rows leave in blocks, not at once."""
    import numpy as np
    import pandas as pd

    from wardline.streaming.twins import HealthState

    rng, day = np.random.default_rng(14), 86_400_000_000
    n = 3000
    rows = pd.DataFrame({
        "us": np.sort(rng.integers(0, 9 * day, n)) // 3_000_000_000 * 3_000_000_000, "id": np.arange(n), "total_requests": rng.choice([0, 10], n, p=[0.1, 0.9]),
        "anomaly_count": rng.integers(0, 4, n), "errors": rng.integers(0, 2, n), "avg_rt": rng.choice([0.0, 20.0, 60.0, 200.0], n), "is_incident": rng.random(n) < 0.1,
    })

    want, status, times, hits = [], "normal", [], []
    for r in rows.assign(late=~rows["is_incident"]).sort_values(["us", "late", "id"]).itertuples():
        if r.is_incident:
            hits.append(r.us)
            continue
        past, rate = [t for t in times[-10:] if t > 0], [x / r.total_requests if r.total_requests else 0.0 for x in (r.anomaly_count, r.errors)]
        slow = r.avg_rt / (sum(past) / len(past)) if r.avg_rt > 0 and past else 0.0
        s = 1.0 - rate[0] * 0.7 - rate[1] * 0.4 - (min((slow - 1.5) * 0.15, 0.2) if slow > 1.5 else 0.0) - min(sum(r.us - day <= h for h in hits) * 0.01, 0.3)
        s = round(max(0.0, min(1.0, s - (0.1 if status != "normal" else 0.0))), 6)
        status = "normal" if s >= 0.8 else "degraded" if s >= 0.5 else "critical"
        times.append(r.avg_rt)
        want.append((r.id, s, status))

    class Value:
        held = None
        get, update = lambda self: self.held, lambda self, x: setattr(self, "held", x)

    monkeypatch.setattr(HealthState, "BLOCK", 64, raising=False)
    state, got, most = HealthState(), [], 0
    state.state = Value()
    cut = np.searchsorted(rows["us"], rows["us"].iloc[n // 2])
    for part in (rows[:cut], rows[cut:]):
        part = part.sample(frac=1, random_state=1)
        for out in state.handleInputRows(("a",), iter([part[:700], part[700:]]), None):
            most = max(most, len(out))
            got += [(r.id, r.health_score, r.status) for r in out.itertuples()]
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and np.allclose([b for _, b, _ in got], [b for _, b, _ in want], atol=1.1e-6)
    assert len({c for *_, c in want}) == 3 and most <= 64


def test_large_groups_are_joined_by_component(spark, monkeypatch):
    """What is known to be one component goes into later searches for components as one node, not with all its edges."""
    from wardline.llm import simhash as S

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (6, 1)], "a long, b long")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "node long, component long")
    assert sorted(map(tuple, S._contracted(edges, comp).collect())) == [(1, 4), (1, 6)]
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [(k, " ".join(base[:60] + [f"x{k}"] + base[60:])) for k in range(80)] + [(k, " ".join(f"y{k}_{i}" for i in range(60))) for k in range(80, 90)]
    sizes, own = [], S.connected_components
    monkeypatch.setattr(S, "connected_components", lambda e: sizes.append(e.count()) or own(e))
    groups = S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.first.doc_id for r in groups.collect()) == [0, *range(80, 90)]
    assert len(sizes) == 3 and max(sizes[1:]) < 40, sizes


def test_forest_rows_are_dealt_to_tasks(spark, monkeypatch):
    """A training table that lies in one partition is dealt out by rows, and the forest is the same from any number of partitions."""
    from wardline.operators import models as Mo

    rng = random.Random(8)
    rows = [(k, rng.random(), rng.random(), rng.randint(0, 1)) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    parts, own = [], Mo.Pipeline.fit
    monkeypatch.setattr(Mo, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(Mo.Pipeline, "fit", lambda self, d: parts.append(d.rdd.getNumPartitions()) or own(self, d))
    models = [Mo.fit_forest(df.repartition(k), ["x", "y"], trees=3, depth=3, key="id") for k in (1, 5)]
    assert parts == [10, 10]
    a, b = ([r.p_attack for r in Mo.predict(m, df).orderBy("id").collect()] for m in models)
    assert a == b


def test_isolation_rows_are_computed_once(spark):
    """Counted, picked from and scored: what computes the rows runs once."""
    from wardline.operators import models as Mo

    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(500).selectExpr("id", "id % 7 * 1.0D AS x", "id % 11 * 1.0D AS y").mapInPandas(rows, "id long, x double, y double")
    assert Mo.isolation_scores(df, ["x", "y"], "id", trees=5).count() == 500 and seen.value == 500


def test_ensemble_takes_sessions_from_the_log_once(spark, monkeypatch):
    from wardline.plans import catalog
    from wardline.plans import views as V

    calls, own = [], V.sessions
    monkeypatch.setattr(V, "sessions", lambda *a: calls.append(1) or own(*a))
    got = catalog.queries()["m10_m19_ensemble"](spark, "/root/testdata/sf0.001")
    assert {r.method for r in got.collect()} == {"forest", "isolation", "rules", "ensemble"} and len(calls) == 1


def test_co_access_shuffles_no_pairs(spark):
    """Pairs of sessions are counted where they first meet, also of sessions over many windows and before the epoch; what is shuffled grows with the members, not with the pairs."""
    from collections import Counter
    from itertools import combinations

    from wardline.operators import crawler

    rng = random.Random(5)
    long = [(w, f"long{k}") for k in range(6) for w in rng.sample(range(-200, 400), 90)]
    mid = [(s + w, f"mid{k}") for k, s in enumerate(rng.sample(range(-150, 300), 12)) for w in [0, 63, *rng.sample(range(64), 9)]]
    edge = [(w, f"edge{k}") for k, at in enumerate((0, 1, 63, 64, -64, -65)) for w in (at, at + 63)] + [(w, f"over{k}") for k in range(3) for w in (0, 64, 128)]
    rows = long + mid + edge + [(7, f"s{k:03}") for k in range(300)] + [(8, "s000"), (8, "s001"), (8, "s001"), (9, None), (9, ""), (None, "s002"), (None, "s003")]
    want = Counter(p for w in {w for w, _ in rows if w is not None} for p in combinations(sorted({s for v, s in rows if v == w and s}), 2))
    df = spark.createDataFrame(rows, "win long, session_id string")
    for chunk in (16, 4096):
        edges = crawler.co_access(df, chunk)
        got = [((r.a, r.b), r.weight) for r in edges.collect()]
        assert len(got) == len(dict(got)) and dict(got) == want and max(want.values()) > 2
    assert dict(edges.dtypes) == {"a": "string", "b": "string", "weight": "bigint"}

    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    big = spark.range(3000).selectExpr("7L AS win", "md5(string(id)) AS session_id")
    assert crawler.co_access(big).selectExpr("count(*)", "sum(weight)").first() == (3000 * 2999 // 2,) * 2
    sc.listenerBus().waitUntilEmpty()
    stages = [sc.statusStore().lastStageAttempt(k) for k in range(first, sc.dagScheduler().nextStageId())]
    assert 3000 <= sum(x.shuffleWriteRecords() for x in stages) < 100_000
