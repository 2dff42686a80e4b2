"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is a linear function of its own features (shares of letter cases,
digits and every punctuation mark, repeated words, word and line length) and of those of the lines before and after it; a
2 x 2 table scores neighbouring labels. In training a line takes its document's label; some further chains are spliced, the
first half of a good document's lines with the second half of a bad one's or the other way round, so that the table also
learns where labels change. A document's
score is the mean of its lines' forward-backward marginals, weighted by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.batches import in_fold, in_sample, runs, runs_of, text_bytes

TRAIN_DOCS, TRAIN_BYTES = 3000, 16 << 20  # bounds of the sample the field is fitted on
RUN_BYTES = 1 << 18  # texts whose features are made at once: these are a hundred times as large
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_KIND = np.full(256, 4, dtype=np.int32)  # 0 lower, 1 upper, 2 digit, 3 white space, 4 other, then each mark
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[list(_MARKS)] = 5 + np.arange(len(_MARKS))
_KINDS = 5 + len(_MARKS)
_OWN = _KINDS + 6
_CODE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(6).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = 3 * _OWN + 1


def _repeats(data: np.ndarray, space: np.ndarray, begins: np.ndarray, of: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: words that repeat the word before, and distinct words; words are compared by hash."""
    if not len(begins):
        return np.zeros(lines), np.zeros(lines)
    at = np.arange(len(data), dtype=np.int32)
    place = at - np.maximum.accumulate(np.where(np.r_[True, space[:-1]] & ~space, at, 0))
    mixed = np.where(space, np.uint64(0), _CODE[data] * _PLACE[np.minimum(place, 63)])
    word = np.add.reduceat(mixed, begins)
    again = np.bincount(of[1:], (word[1:] == word[:-1]) & (of[1:] == of[:-1]), lines)
    order = np.lexsort((word, of))
    w, o = word[order], of[order]
    return again, np.bincount(o, np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])], lines)


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes + 1, its text's place); an empty text is one empty line."""
    raw = [text_bytes(t) for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    line = np.repeat(np.arange(len(ends), dtype=np.int32), length + 1)
    kind = _KIND[data]
    counts = np.bincount(line * _KINDS + kind, minlength=len(ends) * _KINDS).reshape(-1, _KINDS).astype(np.float32)
    counts[:, 3] -= 1  # the line feed
    space = kind == 3
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    of = line[begins]
    words = np.bincount(of, minlength=len(ends))
    again, kinds = _repeats(data, space, begins, of, len(ends))
    own = np.empty((len(ends), _OWN), dtype=np.float32)
    own[:, :_KINDS] = counts / np.maximum(length, 1)[:, None]
    letters = counts[:, 0] + counts[:, 1]
    own[:, _KINDS] = counts[:, 1] / np.maximum(letters, 1)
    own[:, _KINDS + 1] = np.minimum(length / np.maximum(words, 1), 40) / 10
    own[:, _KINDS + 2] = np.log1p(length) / 5
    own[:, _KINDS + 3] = counts[:, 5:].sum(axis=1) / np.maximum(words, 1)
    own[:, _KINDS + 4] = again / np.maximum(words, 1)
    own[:, _KINDS + 5] = kinds / np.maximum(words, 1)
    out = np.zeros((len(ends), FEATURES), dtype=np.float32)
    out[:, :_OWN], out[:, -1] = own, 1
    same = np.flatnonzero(doc[1:] == doc[:-1])
    out[same + 1, _OWN : 2 * _OWN] = own[same]
    out[same, 2 * _OWN : 3 * _OWN] = own[same + 1]
    return out, (length + 1).astype(np.float64), doc


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text, most lines first."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[first, len(doc)])
    order = np.argsort(-n, kind="stable")
    return first[order], n[order]


def forward_backward(evidence: np.ndarray, doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected label pairs, log partition); ``evidence``: score of good against bad."""
    first, n = _chains(doc)
    unary = np.stack([np.zeros_like(evidence), evidence], axis=1)
    ahead, behind = unary.copy(), np.zeros_like(unary)
    steps = int(n[0]) if len(n) else 0
    live = [first[: np.searchsorted(-n, -t, side="left")] + t for t in range(steps)]  # lines t of texts with more than t
    for t in range(1, steps):
        at = live[t]
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + pair[0], ahead[at - 1, 1:] + pair[1])
        at = live[steps - t]
        now = unary[at] + behind[at]
        behind[at - 1] = np.logaddexp(pair[:, 0] + now[:, :1], pair[:, 1] + now[:, 1:])
    both = ahead + behind
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]]) if len(doc) else np.zeros(0, int)
    joint = np.exp(ahead[inner - 1][:, :, None] + pair[None] + (unary[inner] + behind[inner])[:, None, :] - z[inner][:, None, None])
    return good, joint.sum(axis=0), float(z[first].sum())


class LineField:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    @classmethod
    def fit(cls, texts: list, good: list[int], rounds: int = 300, spliced: float = 1 / 8, rate: float = 0.08, ridge: float = 1e-5) -> LineField:
        """Adam on the conditional log-likelihood per line; without both labels a field of zeros (score 0.5).

        ``spliced``: how many chains are spliced of two documents, as a share of the documents.
        """
        weights, pair = np.zeros(FEATURES), np.zeros((2, 2))
        if len(set(good)) < 2:
            return cls(weights, pair)
        chains, labels = cls._spliced(texts, good, int(len(texts) * spliced))
        y = np.concatenate(labels)
        x, doc, at = np.empty((len(y), FEATURES), dtype=np.float32), np.empty(len(y), dtype=np.int64), 0
        for i, j in runs(chains, RUN_BYTES):
            features, _, own = line_features(chains[i:j])
            x[at : at + len(own)], doc[at : at + len(own)] = features, own + i
            at += len(own)
        inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        told = np.array([[np.sum((y[inner] == b) & (y[inner - 1] == a)) for b in (0, 1)] for a in (0, 1)], dtype=float)
        theta, m, v = np.zeros(FEATURES + 4), 0.0, 0.0
        for k in range(1, rounds + 1):
            p, joint, _ = forward_backward((x @ theta[:FEATURES].astype(np.float32)).astype(float), doc, theta[FEATURES:].reshape(2, 2))
            g = np.r_[x.T @ (y - p).astype(np.float32), (told - joint).ravel()] / len(y) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))

    @staticmethod
    def _spliced(texts: list, good: list[int], n: int) -> tuple[list, list[np.ndarray]]:
        """The texts and ``n`` spliced ones, and the labels of their lines."""
        texts = [t if isinstance(t, str) else "" for t in texts]
        chains, labels = list(texts), [np.full(t.count("\n") + 1, float(g)) for t, g in zip(texts, good)]
        rng, of = np.random.default_rng(11), [np.flatnonzero(np.array(good) == g) for g in (0, 1)]
        for k in range(n):
            a, b = (texts[rng.choice(of[g])].split("\n") for g in (k % 2, 1 - k % 2))
            a, b = a[: (len(a) + 1) // 2], b[len(b) // 2 :]
            chains.append("\n".join([*a, *b]))
            labels.append(np.r_[np.full(len(a), float(k % 2)), np.full(len(b), float(1 - k % 2))])
        return chains, labels

    def scores(self, texts: list) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        x, length, doc = line_features(texts)
        good, _, _ = forward_backward(x @ self.weights, doc, self.pair)
        n = len(texts)
        return np.clip(np.bincount(doc, good * length, n) / np.bincount(doc, length, n), 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> LineField:
    """Fit on a bounded sample: about ``train_docs`` labelled documents chosen by a hash of doc_id (all if there are fewer).

    Their whole texts have at most ``train_bytes`` in all; a document of more than a sixteenth of that isn't learned from.
    """
    known = labels.filter(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("good"))
    n = known.count()
    some = known.filter(in_sample("doc_id", min(1.0, train_docs / max(n, 1)))).limit(2 * train_docs)
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size")
    sizes = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(size, F.max("good").alias("good")).collect()
    chosen, room = {}, train_bytes
    for r in sorted(sizes, key=lambda r: zlib.crc32(str(r["doc_id"]).encode())):
        if r["size"] <= min(room, train_bytes // 16):
            chosen[r["doc_id"]] = int(r["good"])
            room -= r["size"]
    if not chosen:
        return LineField(np.zeros(FEATURES), np.zeros((2, 2)))
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()  # what the sizes above allow
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return LineField.fit([r["text"] for r in rows], [chosen[r["doc_id"]] for r in rows])


def score(docs: DataFrame, model: LineField, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of every whole text.

    Null and empty texts are one empty line and get its score. Null ids and repeated rows pass through; an empty
    table gives an empty table; further columns are ignored.
    """
    names = [f"c{k}" for k in range(len(keep))]
    cut = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            parts = [model.scores(texts.slice(i, j - i).to_pylist()) for i, j in runs_of(sizes, RUN_BYTES)]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*names, "score"])

    out = cut.mapInArrow(each, T.StructType([*cut.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    return out.toDF(*keep, "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels.filter(~in_fold("doc_id", 3, 1))))
    return out.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose score is at least ``threshold``; learns from the labels of ``sf_dir``."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~in_fold("doc_id", 3, 1)))
    own = next(c for c in ("quality_score", *(f"quality_score_{k}" for k in range(len(docs.columns)))) if c not in {x.lower() for x in docs.columns})
    scored = score(docs, model, tuple(docs.columns)).toDF(*docs.columns, own)
    return scored.filter(F.col(own) >= threshold).drop(own)
