"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 .. K: how often each byte followed each context. A byte costs
-log2 of its share in the longest context that knows it; a context that was seen without it charges its escape
(method C: distinct / (total + distinct)) and passes on to the next shorter one; below order 0 a byte costs 8 bits.
Statistics are frozen after training. A text's code length is the exact sum over its bytes, and the shortest wins.

The trees are flattened once: every (context, byte) seen in any language gets a row with its final cost in each,
every context a row of escapes, in open-addressing tables, so that scoring is table look-ups in NumPy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.batches import in_fold, in_sample, runs, text_bytes
from wardline.storage import materialise

ORDER, TRAIN_DOCS, UNKNOWN = 4, 300, "und"
TRAIN_BYTES, BLOCK = 8 << 20, 8  # bytes of all training texts; languages whose trees share their tables
_LETTER = re.compile(r"[^\W\d_]")


class Table:
    """Rows of floats by 64-bit key: open addressing with linear probing, all in arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys = np.full(size, 2**64 - 1, dtype=np.uint64)
        self.at = np.full(size, len(rows), dtype=np.int32)
        self.rows = np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.at[slot] == len(rows)
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.at[slot[put]] = keys[todo[put]], todo[put]
            todo, slot = todo[~put], (slot[~put] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; the last row (zeros) stands for missing keys."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], len(self.rows) - 1)
        todo = np.flatnonzero((held != keys) & (self.at[slot] != len(self.rows) - 1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.keys)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (self.at[slot[todo]] != len(self.rows) - 1)]
        return out


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n bytes that end at each place (n - 1 zero bytes stand before the first)."""
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(n):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def prepare(text) -> bytes:
    return text_bytes(text.lower() if isinstance(text, str) else text)


class ContextTrees:
    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for lang in self.langs:
            own: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
            for t in texts[lang]:
                data = np.frombuffer(b"\0" * order + prepare(t), dtype=np.uint8)
                for k in range(order + 1):
                    own[k].append(grams(data, k + 1)[order:])
            for k in range(order + 1):
                counts[k].append(np.unique(np.concatenate(own[k] or [np.zeros(0, np.uint64)]), return_counts=True))
        n = len(self.langs)
        self.costs, self.escapes, shorter = [], [], None
        for k in range(order + 1):
            every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(u for u, _ in counts[k])]))
            contexts = np.unique(every >> np.uint64(8))
            cost, escape = np.zeros((len(every), n)), np.zeros((len(contexts), n))
            of = np.searchsorted(contexts, every >> np.uint64(8))
            lower = shorter(every) if shorter else np.full((len(every), n), 8.0)
            for j, (codes, c) in enumerate(counts[k]):
                at = np.searchsorted(every, codes)
                seen = np.zeros(len(every))
                seen[at] = c
                total = np.bincount(of, seen, len(contexts))
                kinds = np.bincount(of, seen > 0, len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                cost[:, j] = escape[of, j] + lower[:, j]
                cost[at, j] = -np.log2(c / (total[of[at]] + kinds[of[at]]))
            self.costs.append(Table(every, cost))
            self.escapes.append(Table(contexts, escape))
            shorter = lambda e, u=every, c=cost, k=k: c[np.searchsorted(u, e & np.uint64(256 ** (k + 1) - 1))]

    def position_costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte of ``data`` (behind ``order`` bytes of context) in each language."""
        out = np.zeros((len(data) - self.order, len(self.langs)), dtype=np.float32)
        code = grams(data, self.order + 1)[self.order :]
        todo = np.arange(len(out))
        for k in range(self.order, -1, -1):
            key = code[todo] & np.uint64(256 ** (k + 1) - 1)
            row = self.costs[k].find(key)
            out[todo] += self.costs[k].rows[row]
            miss = row == len(self.costs[k].rows) - 1
            todo = todo[miss]
            if not len(todo):
                return out
            out[todo] += self.escapes[k].rows[self.escapes[k].find(key[miss] >> np.uint64(8))]
        out[todo] += 8
        return out

    def code_lengths(self, texts: list, step: int = 1 << 20) -> np.ndarray:
        """Bits of each text in each language of the block; long texts are walked in steps that carry their context along."""
        pad, total = b"\0" * self.order, np.zeros((len(texts), len(self.langs)))
        raw = [prepare(t) for t in texts]
        data = np.frombuffer(pad + pad.join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) + self.order for r in raw]) if raw else np.zeros(0, int)
        owner = np.repeat(np.arange(len(raw)), [len(r) + self.order for r in raw])
        for a in range(0, int(ends[-1]) if raw else 0, step):
            b = min(a + step, int(ends[-1]))
            cost = self.position_costs(data[a : min(b + self.order, len(data))])
            who = owner[a : a + len(cost)]
            first = np.r_[0, ends[:-1]]
            cost[np.arange(a, a + len(cost)) - first[who] >= np.array([len(r) for r in raw])[who]] = 0  # the padding
            at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            total[who[at]] += np.add.reduceat(cost, at, axis=0, dtype=np.float64)
        return total


class Model:
    """Context trees of blocks of BLOCK languages each: what is held grows with the training bytes, not with their product with the languages."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, block: int = BLOCK):
        self.langs = sorted(texts)
        self.trees = [ContextTrees({x: texts[x] for x in self.langs[i : i + block]}, order) for i in range(0, len(self.langs), block)]

    def code_lengths(self, texts: list) -> np.ndarray:
        return np.hstack([t.code_lengths(texts) for t in self.trees])


def sample_texts(docs: DataFrame, label: str, per_label: int, most_bytes: int = TRAIN_BYTES) -> dict[str, list[str]]:
    """At most ``per_label`` whole texts of each label, chosen by a hash of doc_id, of ``most_bytes`` UTF-8 bytes in all labels together.

    Each label has an equal room; texts of more than a quarter of it are not chosen. Labels are counted and joined, not
    listed in the plan, and only the chosen texts reach the driver.
    """
    n = materialise(docs.groupBy(label).count(), "language-counts")
    labels = n.count()
    if not labels:
        return {}
    room = most_bytes // labels
    rows = docs.select("doc_id", label, "text", F.octet_length("text").alias("size")).filter(F.col("size") <= room // 4)
    share = F.least(F.lit(1.0), (per_label + 3 * per_label**0.5) / F.col("count"))
    rows = rows.join(n, label).filter(in_sample("doc_id", share)).withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy(label).orderBy("h", "text")
    some = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_label)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("bytes", F.sum("size").over(upto)).filter(F.col("bytes") <= room)
    out: dict[str, list[str]] = {}
    for r in sorted(some.select(label, "text", "h").collect(), key=lambda r: (r["h"], r["text"])):
        out.setdefault(r[0], []).append(r["text"])
    return out


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a bounded sample: ``train_docs`` documents a language, with non-null text and lang, of ``train_bytes`` in all."""
    return Model(sample_texts(docs.filter("text is not null and lang is not null"), "lang", train_docs, train_bytes), order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; score: the best language's probability given equal priors.

    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with score 0; ties go to
    the first language by name. Null ids and repeated rows pass through; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for i, j in runs(b["text"]):
                texts = b["text"].iloc[i:j].tolist()
                lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                known = [k for k, t in enumerate(texts) if m.langs and isinstance(t, str) and _LETTER.search(t)]
                if known:
                    bits = m.code_lengths([texts[k] for k in known])
                    best = bits.argmin(axis=1)
                    lang[known] = np.array(m.langs, dtype=object)[best]
                    score[known] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].astype("Int64"), "lang_pred": lang, "score": score})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(each, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs.filter(~in_fold("doc_id", 4, 2))))
    return out.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
