"""Fill-in-the-middle, quality rules and exact clustering against plain Python and SQL, with the odd rows each must take."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.llm import centroids, infill, rules

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "word", "é", "日本語 and 🎉🎉 mixed ñandú\n\nß", "a<P>b", "x <S> y", "tail <", "<M", "\t\r\n", "the same line\nthe same line\n\n  \nother", "a b c d e f g h " * 3000, "é" * 5000,
    "one two three four five six seven eight nine ten " * 2 + "#*$%&|<> end", "x" * 70_000,
]
CLASH = "doc_id long, text string, lang string, fim_n string, fim_output long, n_words string, llr_micro string, h1 long, t string, c0 string, kept string"


def table(spark, texts):
    ids = [None if k == 3 else k // 2 for k in range(len(texts))]  # a null id, ids twice
    return spark.createDataFrame([(i, t, "en", "n", 5, "w", "m", 9, "t", "c", "k") for i, t in zip(ids, texts)], CLASH)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def equal(a, b):
    a, b = (x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize(("query", "sql"), [(infill.op11_fill_in_middle, infill.ORACLE_OP11), (rules.op12_quality_rules, rules.ORACLE_OP12), (centroids.op13_centroid_clustering, centroids.ORACLE_OP13)])
def test_query_equals_sql(spark, duck, query, sql):
    equal(query(spark, SF).toPandas(), duck.sql(sql).df())


# ---- 11 fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("ab <>PSMé日🎉\n") for _ in range(rng.randint(0, 60))) for _ in range(400))]
    d = table(spark, texts)
    out = infill.fill_in_middle(d)
    assert out.columns[:3] == ["doc_id", "text", "lang"] and sorted(out.columns) == sorted({*d.columns, *infill.ADDED})
    rows = out.withColumn("back", infill.restore()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == plain_fim(r.doc_id, r.text), r.text
        assert r.back == (r.text or "") and (r.h1, r.t, r.c0) == (9, "t", "c")
    assert {r.fim_form for r in rows} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(d.limit(0)).count() == 0


def test_exception_index_converts_both_ways():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abcdef é日🎉") for _ in range(rng.randint(0, 80)))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        index = infill.Exceptions(data)
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in points])
        assert len(index) == len(text) and len(index.lead) == sum(ord(c) > 127 for c in text)
        assert (index.to_bytes(points) == places).all() and (index.to_points(places) == points).all()


def test_fill_in_middle_by_characters(spark):
    rows = infill.fill_in_middle(table(spark, ["日本語 text ß", "plain ascii", "é"] * 20), unit="char").withColumn("back", infill.restore()).collect()
    assert all(r.back == r.text and r.fim_n == len(r.text) for r in rows)


# ---- 12 quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    again = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in rules.SYMBOLS), dup, len(again)


def plain_grams(text):
    def horner(w):
        h = 0
        for b in w.encode():
            h = (h * rules.BASE + b) % rules.PRIME
        return h

    hs = [horner(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [h * rules.ONE % rules.PRIME % rules.BUCKETS for h in hs] + [(a * rules.FIRST + b * rules.SECOND) % rules.PRIME % rules.BUCKETS for a, b in zip(hs, hs[1:])]


def test_quality_rules_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "ñ", "c\n", "\n", "#x"]) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    d = table(spark, texts)
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (2, 0), (None, 1), (9, 1), (40, 1)], "doc_id long, quality int")
    weights = rules.bucket_weights(d, labels)
    rows = rules.judged(rules.score(d, weights)).collect()
    good = {0, 1, 9, 40}
    every, own = {}, {}
    for r in rows:
        for b in plain_grams(r.text):
            every[b] = every.get(b, 0) + 1
            own[b] = own.get(b, 0) + (r.doc_id in good)
    n, t = sum(every.values()), sum(own.values())
    told = {b: round(1e6 * math.log((own[b] + rules.PRIOR) * n / (c * t + rules.PRIOR * n))) for b, c in every.items()}
    assert len(rows) == len(texts)
    for r in rows:
        grams = plain_grams(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text), r.text
        assert r.n_grams == len(grams) and r.llr_micro == sum(told[b] for b in grams)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.llr_micro >= rules.THRESHOLD * len(grams))
    nobody = rules.bucket_weights(d, labels.limit(0))
    assert not nobody.any() and not rules.bucket_weights(d.limit(0), labels).any() and rules.score(d.limit(0), nobody).count() == 0


def test_quality_rules_tell_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    x = rules.judged(rules.score(docs, rules.bucket_weights(docs, labels.filter(~held)))).filter("not base_failed").join(labels.filter(held), "doc_id")
    got = {(r.quality, r.kept): r["count"] for r in x.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.002 * got[1, True] and got.get((0, True), 0) <= 0.05 * got[0, False]


# ---- 13 centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in own)
    c = [v for _, v in draw[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        sums = {}
        for _, v in own:
            n, s = sums.get(j := near(v)[1], (0, [0] * 64))
            sums[j] = n + 1, [a + b for a, b in zip(s, v)]
        for j, (n, s) in sums.items():
            c[j] = [a // n for a in s]
    return sorted(((i if i is not None else -1, near(v)[1], near(v)[0]) for i, v in own)), c


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=64).round(3).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (301, rows[7][1]), (302, [0.0] * 64), (None, [0.5] * 64), (303, None), (304, [1.0] * 63), (305, [None, *[1.0] * 63]), (306, [float("nan")] * 64), (307, [float("inf")] * 64), (308, [])]
    d = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int, dots string")
    for own in (d, d.filter("vec_id < 9"), d.filter("vec_id = 5")):
        got, c = centroids.cluster_vectors(own)
        want, plain = plain_clusters([(r.vec_id, r.embedding) for r in own.collect()])
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got.collect()) == want
        assert c.tolist() == plain
        for r in got.collect():
            assert r.dots == [sum(a * b for a, b in zip(r.v, x)) for x in plain]  # the matrix that was only ever updated
    assert centroids.cluster_vectors(d.limit(0))[0].count() == 0


def test_clusters_of_large_components(spark):
    d = spark.createDataFrame(pd.DataFrame({"vec_id": [1, 2, 3, 4], "embedding": [[2e6] * 64, [-2e6] * 64, [1e300] * 64, [3e6] * 64]}), "vec_id long, embedding array<double>")
    got, _ = centroids.cluster_vectors(d, clusters=1)
    assert sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 64 * 128_000_000**2), (2, 64 * 128_000_000**2)]


# ---- token ids


def test_token_ids_of_random_unicode_equal_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    from wardline.llm import tokens

    whole, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(7)
    kinds = [(0x20, 0x7E), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x5FF), (0x900, 0x97F), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0x1F300, 0x1F6FF), (0x9, 0xD), (0, 0x1F)]
    for _ in range(3000):
        text = "".join(chr(rng.randint(*rng.choice(kinds))) if rng.random() < 0.7 else rng.choice([" ", "  ", "\n", "'s", "'LL", "the", "123", " ", "　", "\x85"]) for _ in range(rng.randint(1, 40)))
        assert tokens.encode(text) == whole.encode(text, add_special_tokens=False).ids, text
