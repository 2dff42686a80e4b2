"""The numbered operators against brute force, exact round trips and held-out accuracy, with the odd rows each must take."""

import bisect
import collections
import hashlib
import io
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import batches, curves, langid, lattice, mixing, packing, pages, quality, simhash, suffixes, tokens, vectors, warc
from wardline.storage import new_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, fp string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, None, 1.5, 7, "x") for k, (i, t) in enumerate(zip(ids, texts))], DOC)


ODD = [None, "", " ", "word", "the same text here again", "the same text here again", "é" * 5000, "a b c d e f g h " * 4000, "line one\nline two\n\nTHREE!!"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [*ODD, ODD[4]], [None, 1, 2, 3, 4, 4, 6, 7, 8, 4])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).limit(0)


# ---- 1 packing


def check_packing(rows):
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        own.sort()
        end = 0
        for o, n in own:
            assert o == end
            end += n
        assert end <= 1024
    return len(used)


def test_packing_places_every_piece_once(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.best_fit_packing(d).collect()
    n = check_packing(rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for doc_id, text in [(r.doc_id, r.text) for r in d.collect()]:
        ids = [*tokens.encode(text or ""), 2]
        own = sorted(by.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        total += len(ids)
    assert not by and n <= 1.03 * -(-total // 1024) + 1


def test_token_ids_equal_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()] + ["a<|endoftext|>b", "  x \n\n y\t", "日本語 ümlaut 123's", "", "\x00\x01"]
    assert [tokens.encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_odd_rows(spark, odd, empty):
    rows = packing.best_fit_packing(odd).collect()
    check_packing(rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and sum(r.doc_id == 4 for r in rows) == 3
    assert packing.best_fit_packing(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5.2 + seed / 4, 0.9, 20_000).astype(int), 1, 1024)
    runs = packing.plan_runs(collections.Counter(sizes.tolist()))
    assert runs[:, 2].sum() == len(sizes)
    assert len({q + k for _, _, n, q, _ in runs.tolist() for k in range(n)}) <= 1.02 * -(-sizes.sum() // 1024) + 100


def fewest_by_best_fit(counts):
    """Sequences that plain best-fit decreasing needs."""
    rooms, n = [], 0
    for size in sorted(counts.elements(), reverse=True):
        at = bisect.bisect_left(rooms, size)
        room = rooms.pop(at) if at < len(rooms) else 1024
        n += room == 1024
        if room > size:
            bisect.insort(rooms, room - size)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5 + seed / 4, 0.9, 5000).astype(int), 1, 1024)
    if seed % 2:
        sizes = np.r_[sizes, np.full(2000, 1024), np.full(700, 341), rng.integers(300, 700, 2000)]
    counts = collections.Counter(sizes.tolist())
    runs = packing.plan_runs(counts)
    assert len({q + k for _, _, n, q, _ in runs.tolist() for k in range(n)}) <= fewest_by_best_fit(counts)


# ---- 2 mixing


def test_mixing_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(tuple(r) for r in c.sql(mixing.ORACLE_OP2).fetchall())
    assert sorted((r.doc_id, r.source, r.mix_block, r.mix_epoch, r.mix_slot) for r in mixing.op2_mixing(spark, SF).collect()) == want


def test_schedule_never_strays_a_block(spark):
    shares = spark.createDataFrame([(0, 501), (1, 250), (2, 160), (3, 88), (4, 1)], "i int, share long")
    slots = mixing.period_schedule(shares).orderBy("slot").collect()
    want, n = {0: 501, 1: 250, 2: 160, 3: 88, 4: 1}, collections.Counter()
    for t, r in enumerate(slots, 1):
        assert r.k == n[r.i]
        n[r.i] += 1
        assert all(abs(n[i] - w * t / 1000) < 1 for i, w in want.items())
    assert n == want


@pytest.mark.parametrize("small", [40, 700])
def test_mix_keeps_to_unrounded_targets(spark, small):
    """A source of a third of the text, many small ones and a tiny one, at every place of the mix."""
    rows = [(k, "big", "x" * 1000) for k in range(10 * small // 2)] + [(10_000 + k, f"s{k % small:03}", "y" * 1000) for k in range(10 * small)] + [(50_000, "tiny", "z")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    shares = mixing.source_shares(d, block_chars=500)
    target = {r.i: r.target for r in shares.collect()}
    assert abs(sum(target.values()) - 1) < 1e-9
    n = collections.Counter()
    for r in mixing.period_schedule(shares).orderBy("slot").collect():
        n[r.i] += 1
        # one block by the schedule, one by whole shares, one for the tiny source, which has a slot though its target is less
        assert all(abs(n[i] - w * (r.slot + 1)) < 3 for i, w in target.items())
    out = mixing.mix(d, block_chars=500)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r[0] for r in rows} and out.count() < 2 * len(rows)


def test_scarce_sources_repeat_as_often_as_their_weight_asks(spark):
    d = spark.createDataFrame([(k, "a" if k else "b", "x" * 1000) for k in range(101)], "doc_id long, source string, text string")
    n = collections.Counter(r.doc_id for r in mixing.mix(d, weights={"b": 0.5}, block_chars=1000).collect())
    assert 95 <= n[0] <= 110 and set(n) == set(range(101))
    assert max(collections.Counter(r.doc_id for r in mixing.mix(d, weights={"b": 0.5}, block_chars=1000, max_epochs=4).collect()).values()) == 4


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(k, f"s{k}", "t") for k in range(3)], "doc_id long, source string, text string"))


def test_mixing_odd_rows(spark, odd, empty):
    out = mixing.mix(odd.withColumnRenamed("fp", "mix_slot"), weights={"s1": 0.7})
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.mix(empty).count() == 0


# ---- 3 suffix arrays


def brute_repeats(texts, n):
    raw = [batches.text_bytes(t) for t in texts]
    seen = collections.Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "k"), [(40, 12), (400, 128)])
def test_removal_equals_brute_force(spark, length, k):
    rng = random.Random(3)
    letters = "abcdefgh éü\n"
    base = "".join(rng.choice(letters) for _ in range(3000))
    texts = []
    for _ in range(100):
        part = lambda: (lambda r, a: base[a : a + rng.randint(10, 900)] if r < 0.4 else "ab" * rng.randint(5, 300) if r < 0.5 else "x" * rng.randint(5, 600) if r < 0.55 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 500))))(rng.random(), rng.randrange(2900))
        texts.append("".join(part() for _ in range(rng.randint(1, 4))))
    texts += [texts[0], texts[1], "", None]
    ids = [*range(len(texts) - 4), 0, 900, None, 901]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal(docs(spark, texts, ids), length, k, 3).collect())
    assert got == sorted((str(i), *x) for i, x in zip(ids, brute_repeats(texts, length)))


def brute_keep_first(texts, ids, n):
    """What stays of every text if a string goes that starts earlier by (id, place)."""
    seen, kept = set(), {}
    for i, t in sorted(zip(ids, texts)):
        raw = batches.text_bytes(t)
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - n + 1):
            s = raw[k : k + n]
            if s in seen:
                gone[k : k + n] = True
            seen.add(s)
        kept[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return kept


@pytest.mark.parametrize(("length", "k"), [(40, 12), (200, 64)])
def test_first_occurrences_stay(spark, length, k):
    rng = random.Random(5)
    letters = "abcdefgh éü\n"
    base = "".join(rng.choice(letters) for _ in range(2000))
    texts = []
    for _ in range(80):
        part = lambda: (lambda r, a: base[a : a + rng.randint(10, 700)] if r < 0.5 else "ab" * rng.randint(5, 300) if r < 0.6 else "x" * rng.randint(5, 600) if r < 0.65 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 500))))(rng.random(), rng.randrange(1900))
        texts.append("".join(part() for _ in range(rng.randint(1, 4))))
    texts += [texts[0], texts[1], "", None]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: bytes(r.kept) for r in suffixes.removal(docs(spark, texts, ids), length, k, 3, keep_first=True).collect()}
    assert got == brute_keep_first(texts, ids, length)


def test_stage_keeps_one_copy_of_a_passage(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n))
    passage = words(51)
    texts = [f"{words(30)} {passage} {words(30)}" for _ in range(6)] + [words(80), "", None]
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(spark, docs(spark, texts), SF).collect()}
    assert [k for k, t in got.items() if t and passage in t] == [0] and got[0] == texts[0] and got[6] == texts[6]
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 8} and all(t is None or len(t) > 300 for t in got.values())


def test_removal_of_nothing(spark, empty):
    assert suffixes.removal(empty).count() == 0
    assert [r.n_removed for r in suffixes.removal(docs(spark, ["short"])).collect()] == [0]


def test_segments_across_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000)) * 3
    rows = suffixes.segments(data, 400, 128, chunk=1000)
    covered = sorted((lo, lo + more) for lo, more, _, _ in rows.tolist())
    assert covered[0][0] == 0 and covered[-1][1] == len(data) - 400 and all(b[0] == a[1] + 1 for a, b in zip(covered, covered[1:]))


def test_index_family_merges_geometrically():
    rng = np.random.default_rng(0)
    f, seen = suffixes.IndexFamily(), collections.Counter()
    for _ in range(16):
        key = np.unique(rng.integers(0, 4000, 300))
        seen.update(key.tolist())
        f.add(key, key, key, np.zeros(len(key), bool))
    assert sorted(f.repeated()[0].tolist()) == sorted(k for k, n in seen.items() if n > 1)
    assert len(f.levels) <= 5


# ---- 4 quality


def _auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert _auc([r.quality for r in rows], np.array([r.score for r in rows])) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    evidence, doc, pair = rng.normal(size=7), np.array([0, 0, 0, 1, 2, 2, 2]), rng.normal(size=(2, 2))
    good, joint, z = quality.forward_backward(evidence, doc, pair)
    want, pairs, logz = np.zeros(7), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights = {y: np.exp(evidence[at] @ y + sum(pair[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(at))}
        total = sum(weights.values())
        logz += np.log(total)
        for y, w in weights.items():
            want[at] += np.array(y) * w / total
            for a, b in itertools.pairwise(y):
                pairs[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(joint, pairs) and z == pytest.approx(logz)


def test_quality_odd_rows(spark, odd, empty):
    model = quality.LineField.fit(["good text here.", "BAD!! ##", "more good text."], [1, 0, 1])
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, model).count() == 0
    assert quality.LineField.fit(["x"], [1]).scores([None])[0] == 0.5


def test_lines_of_a_mixed_document_are_told_apart():
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + "."
    bad = lambda: "BUY $$$ NOW!!! " * 3
    texts = ["\n".join((good if k % 2 else bad)() for _ in range(rng.randint(3, 9))) for k in range(200)]
    m = quality.LineField.fit(texts, [k % 2 for k in range(200)])
    x, _, doc = quality.line_features(["\n".join([*(good() for _ in range(6)), *(bad() for _ in range(6)), *(good() for _ in range(6))])])
    p, _, _ = quality.forward_backward(x @ m.weights, doc, m.pair)
    assert (p[1:5] > 0.5).all() and (p[7:11] < 0.5).all() and (p[13:17] > 0.5).all()


def test_quality_of_a_text_of_very_many_lines():
    m = quality.LineField(np.full(quality.FEATURES, 0.01), np.zeros((2, 2)))
    assert 0.5 < m.scores(["a line\n" * 200_000])[0] <= 1


def test_quality_learns_from_a_bounded_sample(spark):
    d = docs(spark, [("fine words here. " * 50) if k % 2 else "$$$ !!! " * 100 for k in range(60)] + ["x" * 200_000])
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)], "doc_id long, quality long")
    seen = []
    fit = quality.LineField.fit
    try:
        quality.LineField.fit = classmethod(lambda cls, texts, good: seen.extend(texts) or fit(texts, good))
        quality.train(d, labels, train_bytes=20_000)
    finally:
        quality.LineField.fit = fit
    assert 0 < sum(map(len, seen)) <= 20_000 and max(map(len, seen)) <= 1250


# ---- 5 language


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_code_length_equals_a_plain_ppm():
    texts = {"a": ["abracadabra", "abc abc"], "b": ["xyzzy xyzzy", "bxa"]}
    model = langid.ContextTrees(texts, order=2)
    trees = {}
    for lang, own in texts.items():
        trees[lang] = collections.defaultdict(collections.Counter)
        for t in own:
            s = b"\0\0" + t.encode()
            for i in range(2, len(s)):
                for k in range(3):
                    trees[lang][s[i - k : i]][s[i]] += 1

    def bits(tree, text):
        s, total = b"\0\0" + text.encode(), 0.0
        for i in range(2, len(s)):
            for k in (2, 1, 0):
                seen = tree.get(s[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total -= np.log2(seen[s[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d))
            else:
                total += 8
        return total

    probes = ["abra", "xyz qq", "bxabx", "", "zzzzzzab"]
    assert np.allclose(model.code_lengths(probes, step=3), [[bits(trees[x], p) for x in ("a", "b")] for p in probes], atol=1e-3)


def test_language_odd_rows(spark, odd, empty):
    model = langid.ContextTrees({"en": ["the and of to"], "fr": ["le la les de"]})
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert rows[None].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[3].lang_pred in ("en", "fr")
    assert langid.predict(empty, model).count() == 0
    assert langid.predict(odd, langid.ContextTrees({})).first().lang_pred == "und"


# ---- 6 SimHash


def test_every_close_pair_meets_in_a_table():
    rng = random.Random(0)
    masks = simhash.covering_masks(list(range(64)))
    assert all(any(not any(m >> i & 1 for i in rng_bits) for m in masks) for rng_bits in (rng.sample(range(64), 4) for _ in range(2000)))


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tC d E"
    hs = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e")]
    assert simhash.fingerprint(text) == hs[0] & hs[1]
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_fingerprint_hash_is_sparks(spark):
    import xxhash

    assert spark.sql("select xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("cap", [4096, 40])
def test_links_equal_brute_force(spark, cap):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in list(fps)[:20]:
        for _ in range(15):
            y = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    signed = lambda v: v - 2**64 if v >> 63 else v
    from wardline.operators.components import connected_components

    got = connected_components(simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 4, cap)).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.component].add(r.node % 2**64)
    x = sorted(fps)
    root = {v: v for v in x}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(x):
        for b in x[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = collections.defaultdict(set)
    for v in x:
        want[find(v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.component_id for r in rows}
    assert by[None] == by[1] == by[2] == 1 and by[4] == 4
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(spark, odd, SF)
    assert kept.columns == odd.columns and sum(r.doc_id == 4 for r in kept.collect()) == 1


def brute_groups(texts, words=5, least=0.8):
    w = [(t or "").lower().split() for t in texts]
    sets = [{tuple(x[i : i + words]) for i in range(max(1, len(x) - words + 1))} for x in w]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("split", [256, 8])
def test_near_stage_equals_brute_force_jaccard(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "CLUSTER_ROWS", 4)
    monkeypatch.setattr(simhash, "chunk_count", lambda rows: batches.chunk_count(rows, split, 2 * split))
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(30):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for n in (2, 4, 6, 9) if k else range(40):  # about 1 - 10 n / 300 of the shingles in common, some below 0.8
            copy = list(base)
            for i in rng.sample(range(300), n if k else 4):
                copy[i] = word()
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[40], "", None]
    kept = {r.doc_id for r in simhash.keep_one(spark, docs(spark, texts), SF).collect()}
    assert kept == brute_groups(texts)


# ---- 7 and 8 vectors


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, node string, score double")


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    z = lattice.nearest_e8(y)
    near = ((y[:, None] - (z[:, None] + lattice.AROUND[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((y - z) ** 2).sum(axis=1) <= near + 1e-9).all() and len(lattice.AROUND) == 240 and np.allclose((lattice.AROUND**2).sum(axis=1), 2)


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_vectors_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    x = [*base, *(base[k % 8] + rng.normal(size=64) * s for k in range(60) for s in (0.05, 0.2)), base[0], base[0], base[1]]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [float("inf")] * 64), (905, [1.0])]
    got = {r.vec_id: r for r in lattice.near_duplicate_vectors(_vectors(spark, rows + odd), chunk=chunk).collect()}
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(rows))] == near.sum(axis=1).tolist()
    comp = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    assert [got[i].component_id for i in range(len(rows))] == comp
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)


def test_near_vectors_without_or_with_shared_ids(spark):
    v, w = [1.0, 2.0] + [0.5] * 6, [2.0, -1.0] + [0.0] * 6
    rows = [(None, v), (7, v), (3, v), (5, w), (5, None), (5, [x * 3 for x in w]), (None, None), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (None, [0.0, 0.0, 1.0]), (1, [0.0, 0.0, 2.0])]
    got = collections.Counter(map(tuple, lattice.near_duplicate_vectors(_vectors(spark, rows)).collect()))
    want = [(None, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (5, 1, 5, True), (5, 0, 5, True), (5, 1, 5, True), (None, 0, None, False), (8, 1, 8, True), (9, 1, 8, False), (None, 1, 1, False), (1, 1, 1, True)]
    assert got == collections.Counter(want)


@pytest.mark.parametrize("n", [300, 700])
def test_components_are_split_over_tasks(spark, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.05).tolist()) for i in range(n)]
    assert {tuple(r)[1:] for r in lattice.near_duplicate_vectors(_vectors(spark, rows)).collect()} == {(n - 1, 0, True), (n - 1, 0, False)}
    groups = batches.chunk_pairs(spark.range(n).select(F.col("id").alias("node")), batches.chunk_count(F.lit(n))).groupBy("a", "b").count()
    assert groups.agg(F.max("count")).first()[0] <= 2.5 * batches.SPLIT


def test_no_vectors(spark):
    none = _vectors(spark, [])
    assert lattice.near_duplicate_vectors(none).count() == 0 and curves.nearest(none, none).count() == 0


def test_hilbert_keys_walk_neighbours():
    pts = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    walk = pts[np.argsort(curves.hilbert_keys(pts, 3))]
    assert sorted(curves.hilbert_keys(pts, 3).tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = curves.op8_nearest_neighbours(spark, sf).collect()
    got = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").fetchnumpy()
    ids, x = got["vec_id"], np.stack(got["embedding"]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    by = collections.defaultdict(dict)
    for r in rows:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    for q, found in by.items():
        c = x @ x[np.searchsorted(ids, q)]
        c[np.searchsorted(ids, q)] = -9
        assert sorted(found) == [1, 2, 3, 4, 5] and q % 50 == 0
        assert all(abs(c[np.searchsorted(ids, v)] - s) < 1e-12 for v, s in found.values())
        hits += len({ids[k] for k in np.argsort(-c)[:5]} & {v for v, _ in found.values()})
    assert len(by) == (ids % 50 == 0).sum() and hits / (5 * len(by)) >= 0.9


def test_neighbours_of_copies(spark):
    v = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    w = [0.0, 1.0] + [0.0] * 6
    rows = [(i, v) for i in range(0, 120)] + [(200, w), (201, None), (None, v)]
    got = curves.nearest(_vectors(spark, rows), _vectors(spark, [r for r in rows if r[0] in (0, 50, 200, 201)])).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.vec_id)
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4] and by[200] == [0, 1, 2, 3, 4] and 201 not in by


def test_neighbours_of_many_ties(spark):
    base = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(i, [x * 2.0 ** ((i * 37) % 100 - 50) for x in base]) for i in range(100)]
    got = curves.nearest(_vectors(spark, rows), _vectors(spark, rows[50:51] + rows[2:3])).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.vec_id)
    assert by == {50: [0, 1, 2, 3, 4], 2: [0, 1, 3, 4, 5]}


def test_neighbours_of_scaled_copies_and_other_dimensions(spark):
    v = [3.0, 1.0, 2.0, 5.0, 1.0, 1.0, 2.0, 4.0]
    rows = [(i, [x * i for x in v]) for i in range(1, 31)] + [(50, v), (50, v), (40, [1.0, 2.0]), (41, [2.0, 1.0]), (100, [1.0, 2.0])]
    got = curves.nearest(_vectors(spark, rows), _vectors(spark, [r for r in rows if r[0] % 50 == 0]), rows=8, asked_rows=1).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert by[50] == [(i, 1.0) for i in range(1, 6)] and by[100] == [(40, 1.0), (41, pytest.approx(0.8))] and len(by) == 2


def test_neighbours_in_small_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    want = {tuple(r) for r in curves.nearest(_vectors(spark, rows), _vectors(spark, rows[::10])).collect()}
    assert {tuple(r) for r in curves.nearest(_vectors(spark, rows), _vectors(spark, rows[::10]), rows=16, asked_rows=3).collect()} == want and len(want) == 200


# ---- 9 WARC


def test_warc_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(c.sql(warc.ORACLE_OP9).fetchall(), key=str)  # page_id, bytes, digest, type, refers_to
    got = warc.op9_warc(spark, SF).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want


def test_warc_round_trip_over_any_split(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "é" * 70_000, "<p>" + "x y z " * 30_000, "two"]
    p = spark.createDataFrame([(i, f"http://h/{i} ü" if i else None, h, "x") for i, h in enumerate(html)] + [(1, "http://h/1", html[1], "x"), (None, None, "two", "x")], "page_id long, url string, html string, digest string")
    files = warc.write_warc(warc.with_revisits(p), new_path(spark, "warc-test"), file_bytes=3000)
    seen = []
    for split in (100, 5000, 1 << 20):
        rows = warc.read_warc(files, split).collect()
        assert len(rows) == 9
        seen.append(sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows), key=str))
        own = {r.page_id: r.payload.decode() for r in rows if r.record_type == "response"}
        assert own[1] == html[1] and own[4] == html[4] and own[5] == html[5] and own[3] == ""
    assert seen[0] == seen[1] == seen[2]
    by = {r[0]: r for r in seen[0]}
    assert by[0][1:3] == ("revisit", 1) and by[2][1:3] == ("revisit", 3) and by[6][1] == "response" and by[None][1:3] == ("revisit", 6)
    assert warc.read_warc(warc.write_warc(warc.with_revisits(p.limit(0)), new_path(spark, "warc-test"))).count() == 0


def test_magic_inside_a_record_is_no_record():
    fake = warc._member("response", {"WARC-Record-ID": "<urn:page:1>"}, b"HTTP/1.1 200 OK\r\n\r\n" + warc.MAGIC * 50, 0)
    data = fake * 3
    starts = [at for lo in range(0, len(data), 64) for at, _ in warc.records_in_range(io.BytesIO(data), lo, lo + 64)]
    assert starts == [0, len(fake), 2 * len(fake)]


# ---- 10 HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><style>p{}</style></head><body class='has-sidebar'><header>Site</header><nav><ul><li>m</ul></nav><div class=\"ad\">buy</div><article><h1>T &amp; x</h1><p><b>One  two<br>three<p>Four<div class='comments'><p>bad</div><p>Five &lt;b&gt;<script>var t='</p>';</script></article><footer>f</footer>", "T & x\nOne two three\nFour\nFive <b>"),
        ("<p>a<p>b<ul><li>c<li>d</ul><div id=cookie-notice>zz</div>tail", "a\nb\nc\nd\ntail"), ("", ""), ("plain &copy; text", "plain © text"), ("<!-- <p>no</p> --><p>yes", "yes"),
        ("<main><p>in</p><aside>no</aside><form><input>no</form></main><p>out", "in"),
    ],
)
def test_text_of_pages(page, want):
    assert "\n".join(pages.text_lines(page)[0]) == want


def test_differencing_deletes_the_template(spark):
    t = "<div>Top menu</div>{}<div>Bottom line</div>"
    rows = [(1, "http://h/a/1", t.format("<p>one")), (2, "http://h/a/2", t.format("<p>two<p>three")), (3, "http://h/a/2", t.format("<p>two<p>three")), (4, "http://g/x", "<p>alone"), (5, None, None), (None, "http://h/a/3", t.format("<article><p>Top menu<p>body</article>"))]
    got = {r.page_id: (r.text, r.n_chars) for r in pages.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").coalesce(1)).collect()}
    assert got == {1: ("one", 3), 2: ("two\nthree", 9), 3: ("two\nthree", 9), 4: ("alone", 5), 5: ("", 0), None: ("Top menu\nbody", 13)}
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, rows, parts=1):
    return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}


def test_differencing_decides_on_declared_pages(spark):
    t = "<nav>m</nav><article><p>Our newsletter line<p>{}</article>"
    rows = [(i, f"http://h/a/{i}", t.format("<p>".join(f"own {i} {k}" for k in range(4)))) for i in range(3)]
    quoted = [(10 + i, f"http://q/{i}", f"<main><p>one quotation<p>text {i}<p>more {i}</main>") for i in range(2)]
    copies = [(20 + i, f"http://c/{i}", "<main><p>a<p>b<p>c<p>d" + f"<p>edit {i}</main>") for i in range(4)]
    got = _texts(spark, rows + quoted + copies)
    assert all(got[i] == "\n".join(f"own {i} {k}" for k in range(4)) for i in range(3))
    assert got[10] == "one quotation\ntext 0\nmore 0" and got[22] == "a\nb\nc\nd\nedit 2"


def test_pages_equal_brute_force(spark):
    """Whole pages, undeclared and declared, on three hosts, against a plain restatement of the rule with a table of lengths."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        host, kind = rng.choice("abc"), rng.random() < 0.5
        own = [f"own {i} {k}" for k in range(rng.randint(0, 4))] + [f"quotation {rng.randrange(6)}" for _ in range(rng.randint(0, 2))]
        lines = [f"top of {host}", *own, f"end of {host}", f"made by {host}"]
        body = "".join(f"<p>{x}</p>" for x in lines)
        rows.append((i, f"http://{host}/p/{rng.randrange(40):02}", f"<nav>menu {i}</nav>" + (f"<main>{body}</main>" if kind else body)))
    rows += [(200 + i, *rows[i][1:]) for i in range(0, 120, 7)]

    distinct = {}
    for _, url, page in rows:
        host, path = url.split("/")[2], url[8:]
        lines = tuple(pages.marked_lines(page))
        same = (host, lines)
        distinct[same] = min(distinct.get(same, path), path)
    order = collections.defaultdict(list)
    key = spark.createDataFrame([(h, [x for x in pages.line_hashes([t for t, _ in ls])], [m for _, m in ls]) for h, ls in distinct], "host string, hashes array<long>, marks array<boolean>")
    same = {(r.host, tuple(r.hashes), tuple(r.marks)): r.same for r in key.withColumn("same", F.xxhash64("hashes", "marks")).collect()}
    for (h, ls), path in distinct.items():
        order[h].append((path, same[h, tuple(pages.line_hashes([t for t, _ in ls])), tuple(m for _, m in ls)], ls))
    marked = lambda ls: [t for t, m in ls if m]
    want = {}
    for h, own in order.items():
        own.sort()
        n = collections.Counter(t for _, _, ls in own for t in set(marked(ls)))
        for i, (_, _, ls) in enumerate(own):
            lines, declared = (marked(ls), True) if marked(ls) else ([t for t, _ in ls], False)
            kept = lines
            for j in [j for d in range(1, 5) for j in (i - d, i + d) if 0 <= j < len(own)]:
                other = marked(own[j][2]) if declared else [t for t, _ in own[j][2]]
                if not other:
                    continue
                common = pages.shared_lines(lines, other)
                if 2 * len(common) <= len(lines) if declared else len(common) < len(lines):
                    gone = {k for k in common if not declared or n[lines[k]] >= max(3, len(own) / 2)}
                    kept = [t for k, t in enumerate(lines) if k not in gone]
                    break
            want[h, ls] = "\n".join(kept)
    got = _texts(spark, rows, 3)
    assert got == {i: want[url.split("/")[2], tuple(pages.marked_lines(page))] for i, url, page in rows}
    assert any(t and "top of" not in t for t in got.values())


@pytest.mark.parametrize("page", ['<a "' * 2_500_000, "<a '>' " * 300_000, "<!" * 1_000_000, "</script" * 500_000, "<div>" * 300_000 + "</p>" * 300_000, "<p>x" * 200_000])
def test_broken_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    pages.marked_lines(page)
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize("parts", [1, 5])
def test_copies_and_borders_hide_no_neighbour(spark, parts):
    t = "<div>Top menu</div><p>{}<div>Bottom line</div>"
    rows = [(i, f"http://h/a/{i // 20}?copy={i}", t.format(f"page {i // 20}")) for i in range(400)] + [(1000 + i, f"http://g/{i:03}", t.format(f"own {i}")) for i in range(200)]
    got = _texts(spark, rows, parts)
    assert got == {i: f"page {i // 20}" for i in range(400)} | {1000 + i: f"own {i}" for i in range(200)}


def test_common_subsequence_is_longest():
    rng = random.Random(0)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        for most_bits in (1 << 28, 8):
            got = sorted(pages.shared_lines(a, b, most_bits))
            rest = iter(b)
            assert len(got) == table[-1][-1] and all(a[i] in rest for i in got)
    began = time.perf_counter()
    assert len(pages.shared_lines([1] * 5000 + [2], [2] + [1] * 5000)) == 5000 and time.perf_counter() - began < 5


# ---- pipeline


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = d.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.doc_id for r in d.select("doc_id").collect()}
        d = spark.createDataFrame(stage(spark, d, SF).toPandas(), d.schema)
        assert d.columns == names
        after = {r.doc_id for r in d.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before)
        if k == 1:
            assert simhash.near_duplicates(d).groupBy("component_id").count().filter("count > 1").count() == 0
        if k == 2:
            assert suffixes.removal(d).agg({"n_removed": "sum"}).first()[0] == 0
        if k == 3:
            assert after == before
    check_packing(corpus_pipeline.STAGES[4][1](spark, d, SF).collect())
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, SF).columns == odd.columns


def test_pipeline_run(spark, odd, empty, tmp_path):
    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet")
    for name, d in (("real", real), ("odd", odd.unionByName(docs(spark, ["more text of a fine document here"] * 3, [50, 51, 52]))), ("none", empty)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").limit(0 if name == "none" else 10**6).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        check_packing(rows)
        assert bool(rows) == (name != "none")
        assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)


def test_packed_ids_give_the_texts_back_in_order(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(1).orderBy(F.desc("doc_id"))
    d.write.parquet(f"{tmp_path}/d")
    rows = packing.pack_documents(spark, spark.read.parquet(f"{tmp_path}/d"), SF).collect()
    of = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        of[r.doc_id] += r.ids
    assert dict(of) == {r.doc_id: [*tokens.encode(r.text or ""), 2] for r in d.collect()}
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.position, r.piece)) if r.piece == 0] == sorted(of, reverse=True)
    full = sorted((r for r in rows if r.length == 1024 and r.offset == 0), key=lambda r: r.sequence_id)
    assert [r.position for r in full] == sorted(r.position for r in full)


def test_no_usable_vectors(spark):
    assert vectors.usable(_vectors(spark, [(1, None)])).count() == 0
