"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the packing problem is a histogram of at most ``capacity``
counts, whatever the number of documents. The driver solves that histogram: large lengths are cut into groups of
equal cardinality and rounded up to the group's longest; a cutting-stock linear program over the few group
sizes picks configurations; actual lengths take their places; small pieces are best-fitted into what is left.
Rounding up leaves room that no piece may fit, so sequences with more than a few tokens of it are given up again and
their pieces best-fitted, too; of several such limits the one with the fewest sequences is taken.
The solution is a table of runs ("the pieces of length L with ranks r .. r+n go to sequences q .. q+n at offset
o"), whose size depends on the capacity and the number of groups, not on the rows. Spark ranks the pieces of each length in two
levels (hash bucket, then row in the bucket), so that a length held by a third of all rows is still spread.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.tokens import encode
from wardline.storage import materialise

CAPACITY, END_ID, GROUPS, SMALL, BUCKETS = 1024, 2, 96, 1 / 8, 256
SLACKS = (0, 1, 2, 4, 8, 16, 32, 64)  # tokens a sequence may leave to stay as its configuration made it
_FILE_BITS = 44
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: a document's ids and ``end_id``, cut to ``capacity``; only the first piece may be shorter.

    ``with_ids`` adds the piece's ``ids`` and, if ``docs`` has one, its document's ``position``.
    """
    also = ["position"] if with_ids and "position" in docs.columns else []

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, *place in zip(b["doc_id"], b["text"], *(b[c] for c in also)):
                ids = np.array([*encode(text if isinstance(text, str) else ""), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e].view(np.int32), *place) for k, (s, e) in enumerate(zip(edges, edges[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", *also])
            yield out.assign(doc_id=out["doc_id"].astype("Int64")) if with_ids else out.assign(doc_id=out["doc_id"].astype("Int64")).drop(columns="ids")

    more = ", ids array<int>" * with_ids + "".join(f", {c} long" for c in also)
    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInPandas(cut, PIECES + more)


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Cutting stock over few sizes by column generation: [(how many of each size, how many sequences)], rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ demand, 0)
        price = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), []
        for g in range(k):
            s = sizes[g]
            if price[g] <= 1e-12:
                continue
            for _copy in range(capacity // s):
                other = best[:-s] + price[g]
                better = other > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:][better] = other[better]
                took.append((g, s, better))
        if best[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(k), capacity
        for g, s, better in reversed(took):
            if left >= s and better[left - s]:
                column[g] += 1
                left -= s
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return [(basis[:, j].astype(int), n) for j in range(k) if (n := int(np.floor(x[j] + 1e-7))) > 0]


def _grouped(counts: dict[int, int], capacity: int, groups: int, small: float) -> tuple[list[list[list[int]]], list[tuple[np.ndarray, int]]]:
    """(members of each group as [length, how many], longest first; configurations of the groups and how often each is used)."""
    large = sorted((s for s in counts if s > capacity * small), reverse=True)
    total = sum(counts[s] for s in large)
    per = -(-total // groups) if total else 1
    members: list[list[list[int]]] = []
    room = 0
    for s in large:
        n = counts[s]
        while n:
            if not room:
                members.append([])
                room = per
            m = min(n, room)
            members[-1].append([s, m])
            n, room = n - m, room - m
    merged: dict[int, list[list[int]]] = {}
    for g in members:  # groups that round up to one length are one group
        merged.setdefault(g[0][0], []).extend(g)
    sizes = np.array(list(merged), dtype=int)
    demand = np.array([sum(m for _, m in g) for g in merged.values()], dtype=float)
    used = sorted(_configurations(sizes, demand, capacity), key=lambda c: tuple(c[0])) if len(sizes) else []
    return list(merged.values()), used


class _Plan:
    """Runs of placed pieces, and the room left in the sequences opened so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)  # ranks given away, by length
        self.left: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> [(first sequence, how many)]

    def place(self, size: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((size, self.used[size], n, sequence, offset))
        self.used[size] += n

    def open(self, sizes: list[int], n: int) -> None:
        """``n`` new sequences that hold ``sizes`` each."""
        offset = 0
        for size in sizes:
            self.place(size, n, self.sequences, offset)
            offset += size
        self.left[self.capacity - offset].append((self.sequences, n))
        self.sequences += n

    def fit(self, size: int, n: int) -> None:
        """Put ``n`` pieces in the tightest rooms; what is placed moves to a smaller room, which a lower round may reuse."""
        left = self.left
        for r in sorted(r for r in left if r >= size and left[r]):
            todo = [r]
            while todo and n:
                now = todo.pop()
                while left[now] and n:
                    first, m = left[now].pop()
                    take = min(m, n)
                    if m > take:
                        left[now].append((first + take, m - take))
                    self.place(size, take, first, self.capacity - now)
                    left[now - size].append((first, take))
                    n -= take
                    if now - size >= size:
                        todo.append(now - size)
                        break
                if now != r and left[r] and n:
                    todo.insert(0, r) if r not in todo else None
            if not n:
                break
        full, some = divmod(n, self.capacity // size)
        for nb, q in ((full, self.capacity // size), (1, some)):
            if nb and q:
                self.open([size] * q, nb)


def _assembled(counts: dict[int, int], members: list[list[list[int]]], used: list[tuple[np.ndarray, int]], capacity: int, slack: int) -> _Plan:
    """Configurations with actual lengths, given up where more than ``slack`` stays free; then all other pieces, longest first."""
    plan, stock, rest = _Plan(capacity), [[list(x) for x in g] for g in members], defaultdict(int, counts)
    for column, n in used:
        slots = []
        for g in np.flatnonzero(column):
            for _ in range(column[g]):
                need, slot = n, []
                while need and stock[g]:
                    size, m = stock[g][0]
                    m = min(m, need)
                    slot.append((size, m))
                    need -= m
                    stock[g][0][1] -= m
                    if not stock[g][0][1]:
                        stock[g].pop(0)
                if slot:
                    slots.append(slot)
        ends = [np.cumsum([m for _, m in slot]) for slot in slots]
        cuts = sorted({0, *(int(c) for e in ends for c in e)})
        for a, b in zip(cuts, cuts[1:]):
            sizes = [slot[int(np.searchsorted(e, a, side="right"))][0] for slot, e in zip(slots, ends) if e[-1] > a]
            if capacity - sum(sizes) <= slack:
                plan.open(sizes, b - a)
                for size in sizes:
                    rest[size] -= b - a
    for size in sorted(rest, reverse=True):
        if rest[size]:
            plan.fit(size, rest[size])
    return plan


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL, slacks: tuple[int, ...] = SLACKS) -> np.ndarray:
    """Runs (length, first rank, how many, first sequence, offset) that place ``counts[length]`` pieces of each length."""
    counts = {s: n for s, n in counts.items() if n > 0}
    members, used = _grouped(counts, capacity, groups, small)
    plans = (_assembled(counts, members, used, capacity, slack) for slack in (*slacks, capacity))
    best = min(plans, key=lambda p: p.sequences)
    return np.array(sorted(best.runs), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, buckets: int = BUCKETS, ordered: bool = False) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (1 <= length <= capacity).

    The driver sees at most ``capacity * buckets`` counts. Repeated rows are separate pieces; ties are placed in
    the order of (hash, doc_id, piece); if ``ordered``, pieces of one length take their places in the order of their column
    ``position`` (not null). No pieces give an empty table.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    if ordered:
        # the file's number and the share of the longest file that stands before the row
        file, row = F.shiftright("position", _FILE_BITS), F.col("position").bitwiseAND((1 << _FILE_BITS) - 1)
        files, rows = (int(x or 0) + 1 for x in pieces.agg(F.max(file), F.max(row)).first())
        bucket = F.least(F.floor((file + row / rows) * buckets / files), F.lit(buckets - 1))
    keyed = pieces.withColumn("_bucket", bucket.cast("int"))
    seen = keyed.groupBy("length", "_bucket").count().toPandas()
    table = np.zeros((capacity + 1, buckets), dtype=np.int64)
    table[seen["length"], seen["_bucket"]] = seen["count"]
    before = np.cumsum(table, axis=1) - table
    runs = plan_runs(dict(enumerate(table.sum(axis=1).tolist())), capacity, groups)
    starts = runs[:, 0] << 44 | runs[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, at, row = (b.column(c).to_numpy() for c in ("length", "_bucket", "_row"))
            rank = before[size, at] + row - 1
            run = np.searchsorted(starts, size << 44 | rank, side="right") - 1
            where = [pa.array(runs[run, 3] + rank - runs[run, 1]), pa.array(runs[run, 4])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *where], [*b.schema.names[:-2], "sequence_id", "offset"])

    order = Window.partitionBy("length", "_bucket").orderBy(*["position"] * ordered, "doc_id", "piece", "start", "ids_crc32")
    more = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    return keyed.withColumn("_row", F.row_number().over(order)).mapInArrow(assign, T.StructType([*pieces.schema.fields, *more]))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pack ``docs`` (doc_id, text; further columns are ignored) into sequences of at most ``capacity`` tokens.

    Null and empty texts are a lone end id; a null doc_id stays null; equal rows are packed as often as they
    occur; an empty table gives an empty table.
    """
    return pack(materialise(token_pieces(docs, capacity), "pieces"), capacity, groups)


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, position): the place of a row in the order in which the files of the table were written.

    A DataFrame that isn't a plain table of files has no such order; its rows are placed by a hash.
    """
    name, rows = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    place = F.shiftleft(number(r"^part-(\d+)"), _FILE_BITS) + F.shiftleft(number(r"-c(\d+)\."), 36) + rows
    try:
        return docs.select("doc_id", "text", place.alias("position"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 24).alias("position"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces with their token ids, placed in the order of the files that hold ``docs``.

    ``ids`` of a document's pieces in the order of ``piece`` are its text's ids and the end id; the pieces of a
    ``sequence_id`` in the order of ``offset`` are a sequence. ``position`` grows in the order of the mix, so a reader
    who wants that order sorts sequences by their least position; pieces of one length are placed by it.
    """
    return pack(materialise(token_pieces(_positions(docs), with_ids=True), "pieces"), ordered=True)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
