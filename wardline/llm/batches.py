"""Small helpers for functions that work on batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT, CHUNK = 256, 2048


def text_bytes(text) -> bytes:
    """UTF-8 of a text; nulls are empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def runs(texts: pd.Series | list, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``most`` characters, a row at least."""
    yield from runs_of([len(t) if isinstance(t, str) else 0 for t in texts], most)


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows of the given sizes into runs of about ``most``, a row at least."""
    start = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > most:
            yield start, k
            start, size = k, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """True if crc32 of the id's text falls in the fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def in_sample(key: str, share: Column | float) -> Column:
    """A deterministic share of rows by a hash of ``key``."""
    return F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)


def chunk_count(rows: Column, split: int = SPLIT, chunk: int = CHUNK) -> Column:
    """Into how many chunks a group of so many rows goes.

    More than ``split`` rows make two chunks or more, so that a middling group doesn't stay in one task; very large groups have
    chunks of ``chunk`` rows, since each row is copied once for every chunk.
    """
    return F.greatest(F.least(F.ceil(rows / split), F.lit(max(1, chunk // split))), F.ceil(rows / chunk), F.lit(1)).cast("int")


def chunk_pairs(rows: DataFrame, chunks: Column, node: str = "node") -> DataFrame:
    """Send each row to the pairs (a <= b) of its group's ``chunks`` that hold it; ``part``: 0 in a, 1 in b, 2 if a = b."""
    rows = rows.withColumn("_n", chunks).withColumn("_c", F.pmod(F.xxhash64(node), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    part = F.when(F.col("_c") == F.col("_o"), 2).when(F.col("_c") < F.col("_o"), 0).otherwise(1)
    return rows.withColumns({"a": F.least("_c", "_o"), "b": F.greatest("_c", "_o"), "part": part}).drop("_n", "_c", "_o")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys of a sorted stream, one at a time."""
    held, last = [], None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        for i, j in zip(cuts, [*cuts[1:], len(b)]):
            this = tuple(k[i])
            if held and this != last:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(b.iloc[i:j])
            last = this
    if held:
        yield pd.concat(held)
