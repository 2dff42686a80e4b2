"""The pipeline's stages: columns named like the stages' own, runs of words that repeat, and buckets of one key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import mixing, packing, quality, simhash, suffixes

SF = "/root/testdata/sf0.01"
NAMES = "_id _th _spans _suffix_id id th row own_id own_th spans suffix_id suffix_th c0 c1 whole mix_slot mix_block mix_epoch quality_score bucket node".split()


@pytest.mark.parametrize("stage", [quality.keep_good, simhash.keep_one, suffixes.remove_repeats, mixing.mix_documents])
def test_stages_pass_columns_of_any_name_through(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == k for r in rows for k, n in enumerate(NAMES))


def test_packing_takes_columns_of_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})
    assert packing.pack_documents(spark, docs, "/root/testdata/sf0.001").count()


def _runs(texts: dict[int, str], words: int = 51):
    """Of each run of words the first document and all others that hold it."""
    first, later = {}, set()
    for i in sorted(texts):
        own = texts[i].split()
        for k in range(len(own) - words + 1):
            run = tuple(own[k : k + words])
            if first.setdefault(run, (i, k)) != (i, k):
                later.add(i)
    return later


def test_only_runs_of_over_fifty_words_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null")
    docs = simhash.keep_one(spark, quality.keep_good(spark, docs, SF), SF)
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in suffixes.remove_repeats(spark, docs, SF).collect()}
    held = _runs(before)
    assert held and not _runs(after)
    changed = {i for i in before if after.get(i) != before[i]}
    clean = before.keys() - held
    assert len(changed - held) <= 0.01 * len(clean)
    for i in changed & after.keys():
        assert not set(after[i].split()) - set(before[i].split())  # no word is cut


def test_runs_of_fifty_words_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9)))
    fifty, more = ([word() for _ in range(n)] for n in (50, 51))
    texts = [" ".join([word() for _ in range(30)] + own + [word() for _ in range(30)]) for own in (fifty, fifty, more, more)]
    rows = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark, rows, SF).collect()}
    assert [got[k].text for k in range(3)] == texts[:3]
    assert got[3].text.split() == texts[3].split()[:30] + texts[3].split()[-30:] and got[3].n_chars == len(got[3].text)


def test_one_bucket_of_fifty_thousand(spark):
    rng = np.random.default_rng(9)
    node = np.arange(50_000, dtype=np.int64)
    fp = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    pairs = rng.permutation(50_000)[:2_000].reshape(-1, 2)
    fp[pairs[:, 1]] = fp[pairs[:, 0]] ^ np.uint64(0b1011)
    hub = rng.permutation(50_000)[:300]
    fp[hub] = fp[hub[0]]
    want = {tuple(sorted(p)) for p in pairs.tolist() if not set(p) & set(hub.tolist())}
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"bucket": np.int64(7), "node": node, "fp": fp.view(np.int64), "n": np.int32(100)}), "bucket long, node long, fp long, n int")
    found = simhash._walk_buckets(rows, 4, 0.8).distinct().collect()
    close = {(r.a, r.b) for r in found if not r.over and not {r.a, r.b} & set(hub.tolist())}
    assert want <= close and all(int(fp[a] ^ fp[b]).bit_count() <= 4 for a, b in close)
    root = {int(h): int(h) for h in hub}
    for r in found:
        if r.a in root and r.b in root:
            x, y = root[r.a], root[r.b]
            root = {k: x if v == y else v for k, v in root.items()}
    assert len(set(root.values())) == 1
