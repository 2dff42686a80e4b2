"""Latency runs, peers and components without pairs, prefix spread, and the AUC by ranges, against plain Python."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.operators import crawler as C
from wardline.operators import latency as T
from wardline.operators import metrics as M

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seconds", [5, 10**8])
def test_latency_runs_equal_a_fold(spark, seconds):
    rng = random.Random(1)
    rows = [(i, rng.choice(["/a", "/a", "/b"]), T0 + dt.timedelta(seconds=i // 2), "GET", "/x", rng.choice([0, 100, 150, 400, 2500, 6000, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "log_id long, endpoint string, ts timestamp, method string, path string, response_time long")
    rising, slow = set(), set()
    for e in ("/a", "/b"):
        own = sorted((r[2], r[0], r[5]) for r in rows if r[1] == e)
        runs, last = [], None
        for _, i, ms in own:
            if ms:
                runs = [*runs[:-1], [*runs[-1], (i, ms)]] if last is not None and ms > last else [*runs, [(i, ms)]]
                last = ms
        rising |= {(e, r[0][0], r[-1][0], len(r), r[0][1], r[-1][1]) for r in runs if r[-1][1] > 2 * r[0][1]}
        held = []
        for _, i, ms in [*own, (None, None, 0)]:
            if ms and ms > 2000:
                held.append(i)
            else:
                if len(held) >= 3:
                    slow.add((e, held[0], held[-1], len(held)))
                held = []
    got = {(r.endpoint, r.first_id, r.last_id, r.steps, r.first_ms, r.last_ms) for r in T.rising_latency(df, cell_seconds=seconds).collect()}
    assert got == rising and rising
    assert {(r.endpoint, r.first_id, r.last_id, r.steps) for r in T.repeated_latency(df, cell_seconds=seconds).collect()} == slow and slow


def _windows(spark, n=300):
    rng = random.Random(2)
    rows = [(rng.randint(0, 80), f"s{rng.randint(0, 150):03}") for _ in range(n)] + [(500, f"s{k:03}") for k in range(40, 60)] + [(501, None), (502, "")]
    return rows, spark.createDataFrame(rows, "win long, session_id string")


def test_peers_and_components_need_no_pairs(spark):
    rows, df = _windows(spark)
    members = C.window_members(df)
    inside = defaultdict(set)
    for w, s in rows:
        if s:
            inside[w].add(s)
    met = defaultdict(set)
    for own in inside.values():
        for s in own:
            met[s] |= own - {s}
    assert {r.session_id: r.peers for r in C.peers_met(members).collect()} == {s: len(p) for s, p in met.items()}
    stars = sorted(map(tuple, C.clusters(C.star_edges(members)).collect()))
    assert stars == sorted(map(tuple, C.clusters(C.co_access(df)).collect())) and stars


def test_clusters_are_found_over_windows(spark, monkeypatch):
    """What goes into the search for components are edges of windows, whatever the number of sessions, and the clusters are the same."""
    members = C.window_members(_windows(spark, 250)[1].union(spark.createDataFrame([(600 + k // 40, f"t{k}") for k in range(400)], "win long, session_id string")))
    want = sorted(map(tuple, C.clusters(C.star_edges(members)).collect()))
    seen, own = [], C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda e: seen.append(e.collect()) or own(e))
    assert sorted(map(tuple, C.window_clusters(members).collect())) == want and len(want) > 400
    wins = {r.win for r in members.collect()}
    assert seen and {w for e in seen[0] for w in e} <= wins and len(seen[0]) <= 250


def test_many_peers_are_counted_by_sketches(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("win"), F.concat(F.lit("s"), F.col("id")).alias("session_id")).union(spark.createDataFrame([(0, "both"), (1, "both")], "win long, session_id string"))
    got = {r.session_id: r.peers for r in C.peers_met(C.window_members(df), exact=1000).collect()}
    assert len(got) == 6001 and got["s0"] == 3000 and abs(got["both"] - 6000) <= 0.03 * 6000


def test_peers_of_long_sessions_are_exact(spark):
    """Sessions of more windows than pairs are listed for, with more members than were counted one by one: among them equal ones, ones that overlap, and short ones that several long ones meet."""
    wins = list(range(-100, 150))
    sets = {"long_a": wins, "long_b": wins, "long_c": wins[30:], "long_d": wins[:205]} | {f"two{k}": [wins[k], wins[k + 40]] for k in range(200)} | {f"also{k}": [wins[k], wins[k + 40]] for k in range(0, 200, 3)}
    sets |= {f"one{k}": [wins[k % 250]] for k in range(12_000)} | {"away1": [500, 501], "away2": [500]}
    inside = defaultdict(set)
    for s, own in sets.items():
        for w in own:
            inside[w].add(s)
    want = {s: len(set().union(*(inside[w] for w in own)) - {s}) for s, own in sets.items() if not s.startswith("one") or s.endswith("77")}
    df = spark.createDataFrame([(w, s) for s, own in sets.items() for w in own], "win long, session_id string")
    got = {r.session_id: r.peers for r in C.peers_met(df).collect()}
    assert len(got) == len(sets) and {s: got[s] for s in want} == want and want["long_a"] > 12_000


def test_prefixes_of_a_concentrated_group_stand_out(spark):
    rng = random.Random(3)
    rows = [(f"n{i % 200}", f"{rng.randint(1, 40)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{i % 250}", "normal") for i in range(3000)]
    rows += [(f"m{i % 30}", f"77.1.2.{i % 250}", "scraper") for i in range(300)] + [("x", None, "normal"), ("y", None, "ghost")]
    df = spark.createDataFrame(rows, "session_id string, source_ip string, pattern string")
    own, every = Counter(), Counter()
    for _, ip, p in rows:
        if ip:
            own[p, ip.rsplit(".", 1)[0]] += 1
            every[ip.rsplit(".", 1)[0]] += 1
    t = sum(every.values())
    for p in ("normal", "scraper"):
        mine = {k: v for (g, k), v in own.items() if g == p}
        n = sum(mine.values())
        r = C.prefix_rollup(df).filter((F.col("pattern") == p) & (F.col("bits") == 24)).first()
        assert r.prefixes == len(mine) and r.requests == n
        assert abs(r.entropy + sum(v / n * math.log2(v / n) for v in mine.values())) < 1e-5
        assert abs(r.divergence - sum(v / n * math.log2(v / n / (every[k] / t)) for k, v in mine.items())) < 1e-5
    got = {r.session_id: r.network_score for r in C.prefix_scores(df).collect()}
    assert len(got) == 232 and got["m0"] > 0.8 and got["n0"] < 0.2 and got["y"] == 0.0


@pytest.mark.parametrize("by", [None, ["g"]])
def test_auc_of_continuous_scores(spark, by):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), rng.choice([rng.random(), round(rng.random(), 1)])) for _ in range(1500)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, score double")

    def auc(own):
        pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.0

    want = {g: auc([(y, s) for h, y, s in rows if not by or h == g]) for g in ({r[0] for r in rows} if by else {None})}
    got = {r.g if by else None: r.auc for r in M.roc_auc(df.repartition(4), by=by).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


@pytest.mark.parametrize("more", [{}, {"chunk": 7}])
def test_similarity_of_all_pairs_of_a_group(spark, more):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"s{k:03}", sorted(rng.sample([f"/p{i}" for i in range(9)], rng.choice([0, 1, 1, 2, 3, 6])))) for k in range(150)]
    rows += [("one", "x", ["/p1"]), ("empty", "y", []), ("empty", "z", []), (None, "n", ["/p1"])]
    df = spark.createDataFrame(rows, "pattern string, session_id string, paths array<string>")
    want = {}
    for g in {r[0] for r in rows}:
        sets = [set(p) for h, _, p in sorted(rows, key=lambda r: r[1]) if h == g and g]
        js = [len(a & b) / len(a | b) if a | b else 0.0 for k, a in enumerate(sets) for b in sets[k + 1 :]]
        want[g] = sum(js) / len(js) if js else 0.0
    got = {r.pattern: r.similarity for r in C.group_similarity(df, **more).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want) and want["a"] > 0
    sets = [set(p) for h, _, p in rows if h == "a"][:20]
    js = [len(a & b) / len(a | b) if a | b else 0.0 for k, a in enumerate(sets) for b in sets[k + 1 :]]
    first = {r.pattern: r.similarity for r in C.group_similarity(df, cap=20, **more).collect()}
    assert abs(first["a"] - sum(js) / len(js)) < 1e-12


def test_sequential_scores_take_every_session(spark):
    """Beyond the first hundred of a group, too, and with numbers that no long holds."""
    rows = [("g", f"a{k:03}", [f"/i/{9 - k % 3}", "/i/3"]) for k in range(100)] + [("g", f"b{k:03}", ["/i/3", f"/i/{4 + k}", "/x", "/i/" + "9" * 30]) for k in range(300)]
    df = spark.createDataFrame(rows, "grp string, session_id string, paths array<string>")
    assert {r.grp: r.sequential for r in C.sequential_scores(df).collect()} == {"g": 0.75}
    assert {r.grp: r.sequential for r in C.sequential_scores(df, cap=100).collect()} == {"g": 0.0}
