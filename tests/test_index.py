"""Globs through the index of grams, and shortest paths of any length."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import globs, graph


def test_globs_match_as_one_by_one(spark):
    rng = random.Random(1)
    values = ["", "/api/users/1", "/api/users/2/x", "a.b+c", "(x)|y", "äöü/日本", None, "/a", "x" * 300, *("/" + "/".join(rng.choice(["api", "v1", "users", "x", "ab", "orders"]) for _ in range(rng.randint(1, 5))) for _ in range(150))]
    patterns = ["*", "?", "/a*", "*users*", "/api/*/x", "/api/users/?", "[ab].b+c", "*[!x]", "/*", "", "(x)|y", "*日?", None, "/api/v1", "nothing*here", "??", "x*", *("*" + rng.choice(["api", "v1", "us", "x", "ab"]) + rng.choice(["*", "/*", "?", ""]) for _ in range(30))]
    v, g = spark.createDataFrame([(x,) for x in values * 2], "v string"), spark.createDataFrame([(x,) for x in patterns * 2], "g string")
    got = sorted((r.v, r.g) for r in globs.match_globs(v, "v", g, "g").collect())
    assert got == sorted({(x, p) for x in values for p in patterns if x is not None and p is not None and fnmatch.fnmatchcase(x, p)})
    assert globs.match_globs(v.limit(0), "v", g, "g").count() == 0 and globs.match_globs(v, "v", g.limit(0), "g").count() == 0


def test_globs_need_no_nested_loop(spark):
    v, g = spark.range(1000).select(F.concat(F.lit("/p/"), F.col("id")).alias("v")), spark.createDataFrame([("/p/7*",)], "g string")
    plan = globs.match_globs(v, "v", g, "g")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert globs.match_globs(v, "v", g, "g").count() == 111


def test_grams_of_values_are_not_broadcast(spark):
    """Endpoints' grams, hundreds a value, go neither through the driver nor to all executors, whatever the optimiser takes their size for."""
    v = spark.range(20_000).select(F.concat(F.lit("https://www.example.org/en/"), F.md5(F.col("id").cast("string"))).alias("v"))
    g = spark.createDataFrame([("*/en/*",), ("*//www.*",), ("*/fr/?",)], "g string")
    met = globs.match_globs(v, "v", g, "g")
    assert met.count() == 40_000
    plan = met.groupBy().count()
    plan.collect()
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan and "Generate" not in plan


def _plain_path(edges, a, b):
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    if a not in near or b not in near:
        return None
    front, seen = {a: (a,)}, {a}
    while front and b not in front:
        nxt = {}
        for x, p in front.items():
            for y in near[x] - seen:
                nxt[y] = min(nxt.get(y, (chr(1 << 20),)), (*p, y))
        front = nxt
        seen |= set(nxt)
    return front.get(b)


@pytest.mark.parametrize("seed", range(3))
def test_shortest_paths_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    e = [(f"n{rng.randint(0, 25):02}", f"n{rng.randint(0, 25):02}") for _ in range(30)]
    edges = spark.createDataFrame([(a, b, "t") for a, b in e], "src string, dst string, type string")
    for a, b in [("n00", "n13"), ("n04", "n21"), ("n05", "n05"), ("n01", "nowhere")]:
        want = _plain_path(e, a, b)
        got = [(r.length, r.path) for r in graph.shortest_path(edges, a, b).collect()]
        assert got == ([(len(want) - 1, ">".join(want))] if want else [])


def test_a_path_of_39_hops(spark):
    names = [f"n{k:03}" for k in range(40)]
    edges = spark.createDataFrame([(b, a, "t") if k % 2 else (a, b, "t") for k, (a, b) in enumerate(zip(names, names[1:]))], "src string, dst string, type string")
    assert [(r.length, r.path) for r in graph.shortest_path(edges.coalesce(1), names[0], names[-1]).collect()] == [(39, ">".join(names))]


def test_pieces_stand_in_every_match():
    from wardline.functions.patterns import FAMILIES, SIGNATURES
    from wardline.functions.scalars import required_pieces

    assert required_pieces(r"union.*?select") == ["select", "union"] and required_pieces(r"ab?c+d*e{2}(f|g)[hi]j\.k") == ["j.k", "a", "c"]
    assert required_pieces("a|b") == required_pieces(r"[<>]") == required_pieces(r"\d{4}") == [] and required_pieces("") == []
    every = [p for ps in FAMILIES.values() for p in ps] + [p for ps in SIGNATURES.values() for p, _ in ps]
    for p in every:
        for text in (_SEEN + p).lower().split("\n") + every:
            if re.search(p, text, re.IGNORECASE):
                assert all(x in text.lower() for x in required_pieces(p)), (p, text)


def test_guarded_counts_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    from wardline.functions.patterns import FAMILIES
    from wardline.functions.scalars import pattern_count

    texts = [(t,) for t in [*_SEEN.split("\n"), _SEEN, "", None, "ALERT(1) İ K", "Union\nSelect", "x" * 200_000 + "../"]]
    rows = spark.createDataFrame(texts, "t string").select("t", *(pattern_count("t", ps).alias(f) for f, ps in FAMILIES.items()))
    for r in rows.collect():
        for f, ps in FAMILIES.items():
            assert r[f] == sum(len(re.findall(f"(?:{p})", r["t"] or "", re.IGNORECASE | re.ASCII)) for p in ps), (f, r["t"])


_SEEN = """../../etc/passwd ..%2f ..%5C /proc/self /var/log/x ..\\\\.. <script>alert(1)</script> javascript: onerror = x
' or 1=1 -- ' and 'a'='a' UNION ALL SELECT 1; drop  table x `id` $(id) ${x} $ne : 1 | cat
password: "abcdefgh" api_key='0123456789ab' 1234-5678 9012 3456 email="a@b.cd" bearer abcdefghijklmnopqrstuv
limit = 100000 order by a, group by b, with recursive {"a": {"b": [[1]]}} ""x"" test admin null %2F id=12345 user1=5 userd=7 x.php"""
