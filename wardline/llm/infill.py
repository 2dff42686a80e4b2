"""Fill-in-the-middle: cut a text into prefix, middle and suffix, and put the middle last.

Texts stay UTF-8 bytes. What differs between code points and bytes is kept as a sparse index of exceptions: the places of
the characters of more than one byte, and how many bytes they are in excess. Between two of them code points and
bytes run in step, so a cut is converted by one binary search and an addition, and an ASCII text has no index at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.batches import runs_of

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20  # h3 % 100 from which a text stays plain, h4 % 100 below which the suffix goes first
ADDED = ["fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
RUN_BYTES = 8 << 20  # texts that are put out at once
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Exceptions:
    """The characters of one text that take more than one byte."""

    def __init__(self, data: np.ndarray):
        """``data``: the text's bytes. Bytes that continue a character are in excess; their leads are the exceptions."""
        beyond = np.flatnonzero((data & 0xC0) == 0x80)
        first = np.flatnonzero(np.r_[True, np.diff(beyond) > 1]) if len(beyond) else np.zeros(0, dtype=np.int64)
        self.size = len(data)
        self.lead = beyond[first] - 1  # byte places of the characters
        self.excess = np.r_[0, first[1:], len(beyond)] if len(first) else np.zeros(1, dtype=np.int64)  # bytes in excess before the k-th
        self.point = self.lead - self.excess[:-1]  # the same places in code points

    def __len__(self) -> int:
        """Code points of the text."""
        return int(self.size - self.excess[-1])

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before the byte places ``at``, each the start of a character or the text's end."""
        at = np.asarray(at, dtype=np.int64)
        return at - self.excess[np.searchsorted(self.lead, at, side="left")]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before the code points ``at``."""
        at = np.asarray(at, dtype=np.int64)
        return at + self.excess[np.searchsorted(self.point, at, side="left")]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte places where tokens start: each run of ASCII letters is a token, and each other character."""
    letter = _LETTER[data]
    return np.flatnonzero(((data & 0xC0) != 0x80) & ~(letter & np.r_[False, letter[:-1]]))


def cut(data: np.ndarray, h1: int, h2: int, unit: str = "token") -> tuple[int, np.ndarray, np.ndarray]:
    """(number of units, byte places and code-point places of both cuts); units are tokens or code points (``char``)."""
    index = Exceptions(data)
    starts = token_starts(data) if unit == "token" else None
    n = len(index) if starts is None else len(starts)
    cuts = np.sort([h1 % (n + 1), h2 % (n + 1)])
    if starts is None:
        return n, index.to_bytes(cuts), cuts
    places = np.array([starts[k] if k < n else len(data) for k in cuts], dtype=np.int64)
    return n, places, index.to_points(places)


def _draw(k: int, doc_id: str, seed: str) -> Column:
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexes, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, unit: str = "token") -> DataFrame:
    """``docs`` (doc_id, text and more) with the columns ADDED: units, form, lengths of prefix and middle, and the text in its new order.

    The form is ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part
    after its mark. Null and empty texts, and texts that spell a mark, are plain; a plain row's lengths are null. A null
    doc_id draws as an empty one; repeated rows get equal results; columns named like the new ones are replaced; an empty
    table gives an empty table. No shuffle; a task holds one batch of rows and one text's arrays.
    """
    lower = {c.lower() for c in ADDED}
    own = [c for c in docs.columns if c.lower() not in lower]
    names = [f"c{k}" for k in range(len(own))]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(own, names)), text, *(_draw(k, "doc_id", seed).alias(f"h{k + 1}") for k in range(4)))
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*rows.schema.fields[: len(own)], *(T.StructField(n, k) for n, k in zip(ADDED, kinds))])
    marks = {k: v.encode() for k, v in MARKS.items()}

    def one(raw: bytes, h: list[int]) -> tuple:
        data = np.frombuffer(raw, dtype=np.uint8)
        n, (a, b), (p, q) = cut(data, h[0], h[1], unit)
        if not raw or any(m in raw for m in marks.values()) or h[2] % 100 >= plain_from:
            return n, "plain", None, None, raw
        prefix, middle, suffix = marks["prefix"] + raw[:a], marks["middle"] + raw[a:b], marks["suffix"] + raw[b:]
        form, parts = ("spm", (suffix, prefix, middle)) if h[3] % 100 < spm_below else ("psm", (prefix, suffix, middle))
        return n, form, int(p), int(q - p), b"".join(parts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(names)
            texts, draws = b.column(k), [b.column(k + 1 + j).to_pylist() for j in range(4)]
            for i, j in runs_of([len(texts[r].as_buffer()) for r in range(len(texts))], RUN_BYTES):
                out = [one(texts[r].as_py(), [d[r] for d in draws]) for r in range(i, j)]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                cols[-1] = pa.StringArray.from_buffers(len(cols[-1]), *cols[-1].buffers()[1:]) if len(cols[-1]) else pa.array([], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:k]), *cols], [*names, *ADDED])

    return rows.mapInArrow(each, schema).toDF(*own, *ADDED)


def restore(output: str = "fim_output", form: str = "fim_form") -> Column:
    """The text that an output was made of. A mark's first character is in no other place of a mark, so its first occurrence is the mark."""
    p, s, m = (F.lit(MARKS[k]) for k in ("prefix", "suffix", "middle"))
    x = F.col(output)
    last = lambda t, mark: F.substring(t, F.instr(t, mark) + F.length(mark), F.length(t))
    head = lambda t, mark: F.substring(t, F.lit(1), F.instr(t, mark) - 1)
    psm = F.concat(head(last(x, p), s), last(x, m), head(last(x, s), m))
    spm = F.concat(head(last(x, p), m), last(x, m), head(last(x, s), p))
    return F.when(F.col(form) == "plain", x).when(F.col(form) == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"),
    )


ORACLE_OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         list_transform(range(4), lambda k: ('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id AS VARCHAR), '')), 8 * k + 1, 8))::BIGINT) AS h
  FROM documents
), c AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {PLAIN_FROM} THEN 'plain'
              WHEN h[4] % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
