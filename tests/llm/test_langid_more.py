"""Many languages, and very long training texts."""

import random

from pyspark.sql import functions as F

from wardline.llm import langid


def test_five_hundred_languages(spark):
    rng = random.Random(1)
    rows, k = [], 0
    for n in range(500):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçß", 12)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(15)]
        for _ in range(4):
            rows.append((k, " ".join(rng.choice(words) for _ in range(25)), f"l{n:03}"))
            k += 1
    rows += [(k, "z" * 3_000_000, "l000"), (k + 1, None, "l001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 4 <> 3"), train_bytes=1 << 20)
    assert len(model.langs) == 500 and max(len(t.langs) for t in model.trees) <= langid.BLOCK
    cells = sum(t.rows.size for tree in model.trees for t in [*tree.costs, *tree.escapes])
    assert cells <= 2 * langid.BLOCK * (langid.ORDER + 1) * (1 << 20)
    got = langid.predict(docs.filter("doc_id % 4 = 3 and doc_id < 2000"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * 500


def test_training_bytes_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"{'word ' * (50 + i)}", "ab"[i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    texts = langid.sample_texts(docs, "lang", 100, 20_000)
    assert set(texts) == {"a", "b"} and all(5000 < sum(len(t) for t in v) <= 10_000 for v in texts.values())
    assert langid.sample_texts(docs.limit(0), "lang", 100) == {}
