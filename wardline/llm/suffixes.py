"""Removal of repeated byte strings through sparse suffix arrays in a logarithmic index family.

Every string of ``length`` bytes holds ``length - k + 1`` places where a k-byte gram starts; the place with the
least gram hash (leftmost on ties) is its anchor. Equal strings have the same anchor at the same offset, so only the
suffixes at anchors are indexed, about one in ``(length - k) / 2`` bytes. A suffix stands for the run of strings it
anchors: one *segment* of text, with a hash of its gram (the suffix's sort key) and one of the whole segment.

1. Suffixes come in batches (by a hash of their text). Within a range of keys each batch is a sorted suffix array;
   it is merge-scanned against the levels that the index family holds, its matches are noted, and it becomes a
   level; equal-sized levels merge, so that each key is rewritten a logarithmic number of times. Suffixes are
   ordered by hashes of their first k bytes: any order that puts equal prefixes together serves an exact search.
2. A gram that only ever stands in one and the same segment repeats the whole segment. Where its segments differ,
   segments that occur twice are repeated, and one of each (a repeated passage's edges, mostly) is taken apart into
   blocks of strings counted from the anchor, whose key is what a block's strings share; blocks that match in part
   are taken apart into single strings. Each level goes through the index family in the same way.
3. A document's repeated segments and strings make intervals; their union is removed. With ``keep_first`` the first of
   a class of equal segments (least doc_id, then place) is no repeat, and as the one that is taken apart it stands
   for its class on the next level, so that of every string just the first occurrence stays.

All counts are pre-aggregated before they are gathered by key, and the joins end in shuffles on both sides, so that
a passage shared by a third of all documents is spread. Keys are compared as pairs of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.batches import text_bytes
from wardline.storage import drop_table, materialise, unclustered

LENGTH, GRAM, BATCHES, CHUNK = 400, 128, 8, 1 << 22
STAGE_LENGTH, STAGE_GRAM, STAGE_WORDS = 200, 64, 50  # of the pipeline's stage: strings that runs of more words are made of
_rng = np.random.default_rng(20_240_601)
_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hashes:
    """Hash of any substring of ``data`` from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODE[data] * _power(_BASE, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        back = _power(_BACK, len(self.sums))
        return _mix((self.sums[start + length] - self.sums[start]) * back[start] + np.uint64(0x632BE59BD9B4E019) * np.asarray(length, dtype=np.uint64))

    def ranks(self, length: int) -> np.ndarray:
        """An unmixed hash of every substring of a length: its high bits order grams."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * _power(_BACK, n)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, 2**64 - 1, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _ranked(h: Hashes, k: int) -> np.ndarray:
    """Gram ranks with the place in the low bits, so that the least of a range is its leftmost least gram."""
    raw = h.ranks(k)
    return raw & np.uint64(2**64 - 2**24) | np.arange(len(raw), dtype=np.uint64)


def segments(data: bytes, length: int = LENGTH, k: int = GRAM, chunk: int = CHUNK) -> np.ndarray:
    """Rows (first string, further strings, gram hash, segment hash) that cover all strings of ``length`` bytes once."""
    out = [np.zeros((0, 4), dtype=np.int64)]
    for base in range(0, len(data) - length + 1, chunk):
        h = Hashes(np.frombuffer(data, dtype=np.uint8)[base : base + chunk + length - 1])
        anchor = (_sliding_min(_ranked(h, k), length - k + 1) & np.uint64(2**24 - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        more = np.diff(np.r_[first, len(anchor)]) - 1
        out.append(np.stack([first + base, more, h.of(anchor[first], k).view(np.int64), h.of(first, more + length).view(np.int64)], axis=1))
    return np.concatenate(out)


def blocks(data: bytes, lo: int, more: int, size: int, length: int = LENGTH, k: int = GRAM, parent: int = 16) -> np.ndarray:
    """Rows like those of ``segments`` for a segment's strings, in blocks of ``size``.

    Blocks are counted from the anchor, so that equal strings of different segments fall in blocks of one number.
    The key is the hash of what all strings of a whole block share (for single strings: of their parent block).
    """
    h = Hashes(np.frombuffer(data, dtype=np.uint8)[lo : lo + more + length])
    a = int(_ranked(h, k)[: more + length - k + 1].argmin())
    j = np.arange((a - more) // size, a // size + 1)
    first, last = np.maximum(0, a - size * j - size + 1), np.minimum(more, a - size * j)
    up = j * size // parent * parent if size < parent else j * size
    wide = max(size, parent) - 1
    return np.stack([lo + first, last - first, h.of(a - up, length - wide).view(np.int64), h.of(first, last - first + length).view(np.int64)], axis=1)


class IndexFamily:
    """Levels of sorted suffix arrays: rows of (key, least and greatest segment hash); no two levels of one size class."""

    def __init__(self):
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.matches: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _fold(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, low, high = key[order], low[order], high[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        return (key[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(key) else (key, low, high)

    def add(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> None:
        """Take in a batch sorted by distinct keys; ``many``: the key occurs more than once in the batch itself."""
        self.matches.append((key[many], low[many], high[many]))
        for k, lo, hi in self.levels.values():
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            hit = k[at] == key
            self.matches.append((key[hit], np.minimum(low[hit], lo[at[hit]]), np.maximum(high[hit], hi[at[hit]])))
        size = len(key).bit_length()
        if not size:
            return
        while size in self.levels:
            key, low, high = self._fold(*(np.concatenate(x) for x in zip(self.levels.pop(size), (key, low, high))))
            size = max(size, len(key).bit_length())
        self.levels[size] = (key, low, high)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys that occur at least twice, and whether they do so in segments that differ."""
        key, low, high = self._fold(*(np.concatenate(x) for x in zip(*self.matches))) if self.matches else (np.zeros(0, np.int64),) * 3
        return key, low != high


ROWS = "doc_id long, th long, lo long, more int, gram long, seg long"


def _rows(docs: DataFrame, cut, *also: str) -> DataFrame:
    """Rows of ``cut(text bytes, *values of the columns also)`` for every document."""

    def frame(held: list) -> pd.DataFrame:
        rows, n = np.concatenate([r for _, _, r in held]), [len(r) for _, _, r in held]
        ids = pd.array(np.repeat(pd.array([d for d, _, _ in held], dtype="Int64"), n), dtype="Int64")
        th = np.repeat(np.array([t for _, t, _ in held], dtype=np.int64), n)
        return pd.DataFrame({"doc_id": ids, "th": th, "lo": rows[:, 0], "more": rows[:, 1].astype(np.int32), "gram": rows[:, 2], "seg": rows[:, 3]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for doc_id, th, text, *values in zip(b["doc_id"].astype("Int64"), b["th"], b["text"], *(b[c] for c in also)):
                rows = cut(text_bytes(text), *values)
                if len(rows):
                    held.append((doc_id, th, rows))
                    n += len(rows)
                if n > 50_000:
                    yield frame(held)
                    held, n = [], 0
        if held:
            yield frame(held)

    return docs.select("doc_id", "th", "text", *also).mapInPandas(each, ROWS)


def _repeated_grams(suffixes: DataFrame, batches: int) -> DataFrame:
    """(gram, differ): grams that start at two places or more."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, held, last = IndexFamily(), [], None
        take = lambda: family.add(*(np.concatenate(x) for x in zip(*held))) if held else None
        for b in parts:
            batch = b["batch"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else []
            for i, j in zip(cuts, [*cuts[1:], len(batch)]):
                if batch[i] != last:
                    take()
                    held, last = [], batch[i]
                held.append(tuple(b[c].to_numpy()[i:j] for c in ("gram", "low", "high", "many")))
        take()
        key, differ = family.repeated()
        for i in range(0, len(key), 100_000):
            yield pd.DataFrame({"gram": key[i : i + 100_000], "differ": differ[i : i + 100_000]})

    arrays = suffixes.groupBy("gram", F.pmod("th", F.lit(batches)).cast("int").alias("batch")).agg(
        F.min("seg").alias("low"), F.max("seg").alias("high"), (F.count(F.lit(1)) > 1).alias("many")
    )
    return arrays.repartition("gram").sortWithinPartitions("batch", "gram").mapInPandas(scan, "gram long, differ boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = GRAM, batches: int = BATCHES, steps: tuple[int, ...] = (16, 1), keep_first: bool = False) -> DataFrame:
    """(doc_id, th, start, end): byte intervals whose union holds just the bytes in repeated strings of ``length`` bytes.

    ``docs``: doc_id, text and ``th``, a hash of the text. Rows alike in all three share their intervals. With
    ``keep_first`` a string's occurrence with the least (doc_id, th, start), null ids first, is no repeat.
    """
    spark, key = docs.sparkSession, ["doc_id", "th"]
    span = lambda df: df.select(*key, F.col("lo").alias("start"), (F.col("lo") + F.col("more") + length).alias("end"))
    place = F.struct("doc_id", "th", "lo", "more")
    rows = materialise(_rows(docs, lambda data: segments(data, length, k)), "suffixes")
    found = None
    for level, size in enumerate((0, *steps)):
        if level:
            todo = classes.filter("differ").select("one.*").groupBy(*key).agg(F.collect_list(F.struct("lo", "more")).alias("todo"))  # noqa: F821
            same = [docs[c].eqNullSafe(todo[c]) for c in key]
            some = docs.join(todo, same).select(docs["doc_id"], docs["th"], "text", "todo").dropDuplicates(key)
            cut = lambda data, todo, n=size: np.concatenate([blocks(data, int(x["lo"]), int(x["more"]), n, length, k, steps[0]) for x in todo])
            rows = materialise(_rows(some, cut, "todo"), "suffix-blocks")
        hits = materialise(rows.join(_repeated_grams(rows, batches), "gram"), "suffix-matches")
        drop_table(spark, rows.inputFiles()[0].rsplit("/", 1)[0]) if rows.inputFiles() else None
        classed = hits if keep_first else hits.filter("differ")
        classes = classed.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.first("differ").alias("differ"))
        many = classes.filter("n > 1").select(unclustered("gram"), "seg", "one")
        if keep_first:
            here = span(hits.join(many, ["gram", "seg"]).filter(~place.eqNullSafe(F.col("one"))))
        else:
            here = span(hits.filter("not differ")).union(span(hits.filter("differ").join(many, ["gram", "seg"])))
        found = here if found is None else found.union(here)
    return found


def union_spans(spans) -> list[tuple[int, int]]:
    """Maximal intervals of a union of intervals; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(x["start"]), int(x["end"])) for x in spans) if spans is not None else []:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH, k: int = GRAM, batches: int = BATCHES, keep_first: bool = False) -> DataFrame:
    """The columns of ``docs`` under the names c0, c1, ..., so that none can clash, with ``suffix_id`` and ``spans``: the intervals of ``repeated_spans`` (null if there are none)."""
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*names, F.col("doc_id").cast("long").alias("suffix_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("suffix_th"), F.coalesce("text", F.lit("")).alias("suffix_text"))
    base = keyed.select(F.col("suffix_id").alias("doc_id"), F.col("suffix_th").alias("th"), F.col("suffix_text").alias("text"))
    spans = repeated_spans(base, length, k, batches, keep_first=keep_first).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = materialise(spans, "suffix-spans").withColumnsRenamed({"doc_id": "sid", "th": "sth"})
    same = F.col("suffix_id").eqNullSafe(F.col("sid")) & (F.col("suffix_th") == F.col("sth"))
    return keyed.drop("suffix_text").join(spans, same, "left").drop("sid", "sth", "suffix_th")


def removal(docs: DataFrame, length: int = LENGTH, k: int = GRAM, batches: int = BATCHES, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every text; ``kept``: the remaining bytes.

    A null text is empty; texts shorter than ``length`` lose nothing; rows that repeat each other lose all they
    share; a null doc_id is a document like any other; an empty table gives an empty table.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, spans in zip(b["c1"], b["spans"]):
                data, gone = text_bytes(text), union_spans(spans)
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            out.insert(0, "doc_id", b["suffix_id"].astype("Int64").to_numpy())
            yield out

    cut = with_spans(docs.select("doc_id", "text"), length, k, batches, keep_first).select("suffix_id", "c1", "spans")
    return cut.mapInPandas(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and the remaining ``text`` (a character cut in two shows as a replacement character)."""
    out = removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def long_runs(data: bytes, spans, words: int = STAGE_WORDS) -> list[tuple[int, int]]:
    """The intervals of the union of ``spans`` that hold more than ``words`` whole words, from the first one's start to the last one's end."""
    out = []
    for a, b in union_spans(spans):
        a += 0 if a == 0 or data[a - 1 : a].isspace() or data[a : a + 1].isspace() else len(data[a:b].split(None, 1)[0])
        while a < b and b < len(data) and not data[b : b + 1].isspace() and not data[b - 1 : b].isspace():
            b -= 1  # to the end of the word before
        part = data[a:b]
        if len(part.split()) > words:
            out.append((a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())))
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without runs of more than STAGE_WORDS words that also occur earlier; texts that are blank then go.

    A run is made of strings of STAGE_LENGTH bytes that start earlier, too, and is cut at whole words. First occurrences
    stay. Null texts, ids and repeated rows are documents like any other; columns of any name pass through.
    """
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, whole = [], []
            for text, spans in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                data = text_bytes(text) if spans else b""
                gone = long_runs(data, spans) if spans else []
                edges = [0, *(x for s in gone for x in s), len(data)]
                texts.append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore") if gone else text)
                whole.append(texts[-1] is None or bool(texts[-1].strip()))
            columns = b.columns[: len(names)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(whole, pa.bool_()))

    cut = with_spans(docs, STAGE_LENGTH, STAGE_GRAM, keep_first=True).select(*names, "spans")
    out = cut.mapInArrow(each, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
