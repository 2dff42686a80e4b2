"""Quality rules: counts of every text, and a log-likelihood ratio of its hashed word n-grams.

Two multinomials over ``buckets`` hashed words and word pairs are counted: one over all documents, one over documents that are
trusted (labelled good). A text's score is the sum of ``log(trusted / all)`` over its n-grams, by its number of
n-grams; it is kept if that reaches a fixed threshold. A bucket's weight is a whole number of millionths, so that sums are
exact and the verdict of a document doesn't depend on the order or place of its computation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.batches import runs_of

BUCKETS, THRESHOLD = 1 << 16, -100_000  # n-gram buckets; least mean, in millionths
PRIOR = 16  # trusted n-grams a bucket that are taken to be spread as the corpus is
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8  # words; percent of words in repeated windows; words of a window
SYMBOLS = "#*$%&|<>"
PRIME, BASE, ONE, FIRST, SECOND = (1 << 31) - 1, 257, 1_103_515_245, 69_069, 1_664_525  # of the n-gram hash
RUN_BYTES, BLOCK = 4 << 20, 1 << 20  # bytes of texts, and of words, that are worked on at once
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*COUNTS, "n_grams", "llr_micro"]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_ODD = np.random.default_rng(12).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.r_[out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases: tuple[int, ...]) -> list[np.ndarray]:
    """Of each non-empty span of bytes the polynomial hashes mod PRIME to the given bases, in blocks of bounded bytes."""
    out = [np.zeros(len(starts), dtype=np.uint64) for _ in bases]
    size = ends - starts
    table = [_powers(b, int(size.max(initial=1))) for b in bases]
    edges = np.cumsum(size)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(edges, (edges[i - 1] if i else 0) + BLOCK, side="right")))
        n = size[i:j]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        own = data[np.repeat(starts[i:j], n) + at].astype(np.uint64)
        place = np.repeat(n, n) - 1 - at
        for h, powers in zip(out, table):
            h[i:j] = np.add.reduceat(own * powers[place], first) % np.uint64(PRIME)
        i = j
    return out


def _identity(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-grams, 62-bit identity) of each span."""
    a, b = span_hashes(data, starts, ends, bases)
    return a, a << np.uint64(31) | b


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.r_[False, k[1:] == k[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same | np.r_[same[1:], False]
    return out


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(the counts COUNTS of every text, the bucket of every n-gram before the modulus, its text's place).

    Words, windows and lines are compared by hashes of 62 bits or more.
    """
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    borders = np.cumsum([len(t) + 1 for t in texts])  # a text's separator is its own
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    doc = np.searchsorted(borders, starts, side="right")
    per = lambda at, w=None: np.bincount(at, w, n).astype(np.int64)
    inside = lambda mask: np.add.reduceat(mask, np.r_[0, borders[:-1]], dtype=np.int64)
    out = {"n_words": per(doc), "word_chars": inside(~space & ((data & 0xC0) != 0x80)), "n_symbols": inside(_SYMBOL[data])}

    h, word = _identity(data, starts, ends, (BASE, 263))
    feeds = np.flatnonzero(data == 10)
    of = np.unique(np.searchsorted(feeds, starts, side="left"))  # lines with a word
    begin = np.r_[0, feeds[:-1] + 1][of]
    line_doc = np.searchsorted(borders, begin, side="right")
    _, line = _identity(data, begin, feeds[of], (BASE, 263))
    keys = np.unique(np.stack([line_doc.astype(np.uint64), line]), axis=1) if len(line) else np.zeros((2, 0), dtype=np.uint64)
    out["n_dup_lines"] = per(line_doc) - per(keys[0].astype(np.int64))

    spread = _mixed(word)
    m = max(0, len(spread) - WINDOW + 1)
    window = np.zeros(m, dtype=np.uint64)
    for k in range(WINDOW):
        window += spread[k : k + m] * _ODD[k]
    whole = doc[:m] == doc[WINDOW - 1 :][:m]
    first = np.flatnonzero(whole)
    again = first[_repeated(_mixed(window[first]) ^ _mixed(doc[first].astype(np.uint64) + np.uint64(1)))]
    step = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    out["n_repeat_words"] = per(doc[np.cumsum(step[:-1]) > 0])

    pair = np.flatnonzero(doc[1:] == doc[:-1])
    grams = np.r_[h * np.uint64(ONE), h[pair] * np.uint64(FIRST) + h[pair + 1] * np.uint64(SECOND)] % np.uint64(PRIME)
    return out, grams, np.r_[doc, doc[pair]]


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows of a binary column, of bounded bytes, and their texts."""
    for i, j in runs_of([len(x.as_buffer()) for x in column], RUN_BYTES):
        yield i, j, column.slice(i, j - i).to_pylist()


def _binary() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): every document labelled good."""
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, good) of every document: its text as bytes, and whether it is trusted.

    A shuffle of the texts at any size, so that disk grows in proportion and no broadcast grows with the labels. The ids are hashed and the
    texts not sorted, so that none are spilled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _binary())
    trusted = trusted_ids(labels).withColumn("good", F.lit(True)).hint("shuffle_hash")
    return rows.join(trusted, "doc_id", "left").select("t", F.coalesce("good", F.lit(False)).alias("good"))


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(trusted / all) of each bucket in millionths, from the n-grams of all documents.

    The ratio is (trusted + PRIOR) / (expected + PRIOR), where a bucket's expected count is its share of the corpus: what is
    too rare to be expected weighs little. Each task sums its own documents; what is shuffled then is a row a bucket and task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, own = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            good = b.column("good").to_numpy(zero_copy_only=False)
            for i, j, texts in _texts(b.column("t")):
                _, grams, doc = measure(texts)
                at = (grams % np.uint64(buckets)).astype(np.int64)
                every += np.bincount(at, minlength=buckets)
                own += np.bincount(at[good[i:j][doc]], minlength=buckets)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(every[at]), pa.array(own[at])], ["bucket", "n", "good"])

    sums = marked(docs, labels).mapInArrow(each, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    weights, found = np.zeros(buckets, dtype=np.int64), sums.collect()  # a row a bucket
    total, good = sum(r["n"] for r in found), sum(r["good"] for r in found)
    for r in found:
        if good:
            weights[r["bucket"]] = round(1e6 * math.log((r["good"] + PRIOR) * total / (r["n"] * good + PRIOR * total)))
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with the columns ADDED: the counts of every whole text, its number of n-grams and the sum of their weights.

    A null text has no words. Columns named like the new ones are replaced; repeated rows and null ids pass through;
    an empty table gives an empty table. No shuffle.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED]
    names = [f"c{k}" for k in range(len(own))]
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(own, names)), _binary())
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in ADDED)])
    table = weights.astype(np.int32)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in _texts(b.column(len(names))):
                counts, grams, doc = measure(texts)
                value = table[(grams % np.uint64(len(table))).astype(np.int64)]
                total = np.zeros(len(texts), dtype=np.int64)
                np.add.at(total, doc, value)
                cols = [*(counts[c] for c in COUNTS), np.bincount(doc, minlength=len(texts)), total]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), *(pa.array(c, pa.int64()) for c in cols)], [*names, *ADDED])

    return rows.mapInArrow(each, schema).toDF(*own, *ADDED)


def judged(scored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to scored documents."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr_micro") >= threshold * F.col("n_grams")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, bucket_weights(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(scored).select("doc_id", *COUNTS[:4], "n_repeat_words", "base_failed", "kept", "n_grams", "llr_micro")


# words hash by Horner's rule, once for each distinct word
ORACLE_OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good
  FROM documents
), w AS (SELECT row, good, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d
), u AS (SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w, hex(w) AS x FROM w)
), h AS (SELECT w, list_reduce(b, lambda a, c: (a * {BASE} + c) % {PRIME}) AS h FROM u
), g AS (
  SELECT row, good, unnest(CASE WHEN p IS NULL THEN [h * {ONE} % {PRIME} % {BUCKETS}] ELSE [h * {ONE} % {PRIME} % {BUCKETS}, (p * {FIRST} + h * {SECOND}) % {PRIME} % {BUCKETS}] END) AS bucket
  FROM (SELECT row, good, h, lag(h) OVER (PARTITION BY row ORDER BY i) AS p FROM w JOIN h USING (w))
), c AS (SELECT bucket, count(*) AS n, count(*) FILTER (good) AS t FROM g GROUP BY bucket
), v AS (
  SELECT bucket, CASE WHEN sum(t) OVER () = 0 THEN 0
         ELSE cast(round(1e6 * ln((t + {PRIOR}) * sum(n) OVER () / cast(n * sum(t) OVER () + {PRIOR} * sum(n) OVER () AS DOUBLE))) AS BIGINT) END AS weight
  FROM c
), s AS (SELECT row, count(*) AS n_grams, cast(sum(weight) AS BIGINT) AS llr_micro FROM g JOIN v USING (bucket) GROUP BY row
), e AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, x) AS n
  FROM (SELECT row, unnest(range(1, len(words) - {WINDOW} + 2)) AS i, array_to_string(words[i:i + {WINDOW} - 1], ' ') AS x FROM d WHERE len(words) >= {WINDOW})
), r AS (
  SELECT row, count(*) FILTER (again) AS n_repeat_words
  FROM (SELECT w.row, coalesce(max(e.n) OVER (PARTITION BY w.row ORDER BY w.i ROWS BETWEEN {WINDOW} - 1 PRECEDING AND CURRENT ROW), 0) > 1 AS again FROM w LEFT JOIN e ON e.row = w.row AND e.i = w.i)
  GROUP BY row
), l AS (
  SELECT row, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY row
), o AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_grams, 0) AS n_grams, coalesce(llr_micro, 0) AS llr_micro
  FROM d LEFT JOIN s USING (row) LEFT JOIN r USING (row) LEFT JOIN l USING (row)
)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND llr_micro >= {THRESHOLD} * n_grams AS kept
FROM o
"""
