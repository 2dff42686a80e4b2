"""SimHash near-duplicates by covering locality-sensitive hashing.

A random code gives every fingerprint bit a non-zero vector of radius + 1 bits; table v keeps the bits whose
vector has an odd product with v. Any set of at most ``radius`` differing bits is orthogonal to some v != 0, so
every pair within the radius agrees in all bits that some table keeps: no pair is lost, and 31 tables serve radius 4.

Copies of a fingerprint are one node. A bucket's links are searched exhaustively in NumPy and only a spanning
forest leaves it; a bucket of more than ``bucket_rows`` fingerprints is covered again on the bits its key leaves
open, which about halves them each time; a bucket with ten open bits has 1,024 members at most, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import chunk_count, chunk_pairs, groups
from wardline.operators.components import connected_components
from wardline.storage import materialise, unclustered

RADIUS, SEED, BUCKET_ROWS = 4, 42, 4096
NEAR_WORDS, NEAR_JACCARD, PARTS, CLUSTER_ROWS, SPREAD, CHUNK_BYTES = 5, 0.8, 3, 32, 16, 8 << 20


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words; of all if there are fewer."""
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=max(1, len(w) - words + 1))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash: bit set if it is set in over half the shingles' XXH64 (seed 42); no words: zero."""
    w = _words(text)
    return _majority(_shingles(w, words)) if w else 0


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, th): the fingerprint as a signed long, and a hash of the text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t if isinstance(t, str) else None, words) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.view(np.int64), "th": b["th"]})

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("th"))
    return cut.mapInPandas(each, "doc_id long, fp long, th long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit places; any set of at most ``radius`` of them misses some mask.

    The first codes are a basis, so every mask keeps some bit and a bucket's open bits shrink at each level.
    """
    basis = [1 << k for k in range(radius + 1)]
    codes = basis + [c for c in range(1, 2 << radius) if c not in basis]
    code = {bit: codes[k % len(codes)] for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit, m in code.items() if (m & v).bit_count() % 2) for v in range(1, 2 << radius)]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    if len(fps) == 2:
        a, b = fps.tolist()
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    edges, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
                left = left[~near]
    return edges


def _bucket_links(tables: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """Walk buckets (sorted by key) one at a time; at most ``bucket_rows`` fingerprints are held.

    Returns links (a, b); for a bucket that is too large its rows instead, as (kept, fp) in (a, b) with over = true.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, kept, over = None, [], 0, False

        def flush() -> list[tuple[int, int, bool]]:
            if over or len(held) < 2:
                return []
            pairs = np.array(_forest(np.unique(np.array(held, dtype=np.int64).view(np.uint64)), radius), dtype=np.uint64).reshape(-1, 2)
            return [(a, b, False) for a, b in pairs.view(np.int64).tolist()]

        for batch in batches:
            rows: list[tuple[int, int, bool]] = []
            key, fp, mask = (batch[c].to_numpy() for c in ("key", "fp", "kept"))
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]) if len(key) else []
            for i, j in zip(cuts, [*cuts[1:], len(key)]):
                this = (int(key[i]), int(mask[i]))
                if this != last:
                    rows += flush()
                    last, held, over = this, [], False
                held = [*held, *fp[i:j].tolist()] if held else fp[i:j].tolist()
                if over or len(held) > bucket_rows:
                    rows += [(this[1], x, True) for x in held]
                    held, over = [], True
            yield pd.DataFrame(rows, columns=["a", "b", "over"]).astype({"a": "int64", "b": "int64", "over": bool})
        yield pd.DataFrame(flush(), columns=["a", "b", "over"]).astype({"a": "int64", "b": "int64", "over": bool})

    return tables.mapInPandas(walk, "a long, b long, over boolean")


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect just what all pairs within ``radius`` connect; ``distinct``: a column fp without repeats."""
    if bucket_rows < 2 << radius:
        raise ValueError(f"bucket_rows must be {2 << radius} or more")
    spark = distinct.sparkSession
    todo, found, kept = distinct.select(F.lit(0).cast("long").alias("kept"), "fp"), None, {0}
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    while kept:
        masks = []
        for k in kept:
            free = [i for i in range(64) if not k >> i & 1]
            masks += [(signed(k), signed(k | m)) for m in covering_masks(free, radius)]
        by = spark.createDataFrame(masks, "kept long, next long").groupBy("kept").agg(F.collect_list("next").alias("masks"))
        rows = todo.join(F.broadcast(by), "kept").select("fp", F.explode("masks").alias("kept"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("kept"))).repartition("key", "kept").sortWithinPartitions("kept", "key", "fp")
        out = materialise(_bucket_links(rows, radius, bucket_rows), "simhash-links")
        level = out.filter("not over").select("a", "b").distinct()
        found = level if found is None else found.union(level)
        todo = out.filter("over").select(F.col("a").alias("kept"), F.col("b").alias("fp")).distinct()
        kept = {r["kept"] & (1 << 64) - 1 for r in todo.select("kept").distinct().collect()}  # at most the masks of one level
    return found


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, th, component_id): documents whose fingerprints are linked, directly or through others, share the least doc_id.

    Null and empty texts have the fingerprint zero and are linked like any other. A null doc_id is kept and takes
    its component's least known id (null if there is none). Repeated rows stay; an empty table gives an empty table.
    """
    fps = materialise(fingerprints(docs, words), "simhash-fp")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    comp = connected_components(links(distinct.select("fp"), radius, bucket_rows))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id")).select(unclustered("root"), "component_id")
    named = materialise(named.join(roots, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(named, "fp").select("doc_id", "fp", "th", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _near(fp: np.ndarray, n: np.ndarray, radius: int, jaccard: float) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first row, matrix) of which members of a bucket are within the radius and near enough in size."""
    step = max(1, (1 << 22) // len(fp))
    for i in range(0, len(fp), step):
        near = np.bitwise_count(fp[i : i + step, None] ^ fp) <= radius
        r, c = near.nonzero()
        near[r, c] = (r + i != c) & (np.minimum(n[r + i], n[c]) >= jaccard * np.maximum(n[r + i], n[c]) - 1e-9)
        yield i, near


def _clusters(fp: np.ndarray, n: np.ndarray, radius: int, jaccard: float) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """(members, tree edges) of each group of a bucket's linked members."""
    linked = np.zeros(len(fp), dtype=bool)
    for i, near in _near(fp, n, radius, jaccard):
        linked[i : i + len(near)] = near.any(axis=1)
    left = np.flatnonzero(linked)
    while len(left):
        members, edges, front, left = [int(left[0])], [], [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop(0)
            near = (np.bitwise_count(fp[left] ^ fp[x]) <= radius) & (np.minimum(n[left], n[x]) >= jaccard * np.maximum(n[left], n[x]) - 1e-9)
            found = left[near].tolist()
            edges += [(x, y) for y in found]
            front += found
            members += found
            left = left[~near]
        yield members, edges


def _search(node: np.ndarray, fp: np.ndarray, n: np.ndarray, radius: int, jaccard: float) -> list[tuple[int, int, bool]]:
    """Candidates (a, b, over) among nodes: all pairs of groups of CLUSTER_ROWS or fewer; of a larger group a spanning tree from its least node (over = true)."""
    out, order = [], np.argsort(node)
    node, fp, n = node[order], fp[order], n[order]
    for members, edges in _clusters(fp, n, radius, jaccard):
        if len(members) > CLUSTER_ROWS:
            out += [(int(node[x]), int(node[y]), True) for x, y in edges]
            continue
        own = node[members]
        for i, near in _near(fp[members], n[members], radius, jaccard):
            r, c = near.nonzero()
            out += [(a, b, False) for a, b in zip(own[r + i].tolist(), own[c].tolist()) if a < b]
    return out


_FOUND = "a long, b long, over boolean, bucket long, fp long, n int"


def _found(pairs: list[tuple[int, int, bool]]) -> pd.DataFrame:
    out = pd.DataFrame(pairs, columns=["a", "b", "over"]).astype({"a": "int64", "b": "int64", "over": bool})
    return out.assign(bucket=pd.array([None] * len(out), dtype="Int64"), fp=np.int64(0), n=np.int32(0))


def _walk_buckets(rows: DataFrame, radius: int, jaccard: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Candidates (a, b, over) of each bucket of ``rows`` (bucket, node, fp, n).

    A bucket of more than ``bucket_rows`` nodes is not searched where it lies: its chunks meet in pairs, in tasks of their own.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, size, out = None, [], 0, []

        def searched() -> list[tuple[int, int, bool]]:
            if size < 2 or size > bucket_rows:
                return []
            g = pd.concat(held) if len(held) > 1 else held[0]
            return _search(g["node"].to_numpy(), g["fp"].to_numpy().view(np.uint64), g["n"].to_numpy(), radius, jaccard)

        for b in batches:
            key = b["bucket"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            for i, j in zip(cuts, [*cuts[1:], len(key)]):
                if key[i] != last:
                    out += searched()
                    last, held, size = key[i], [], 0
                held.append(b.iloc[i:j])
                size += j - i
                if size > bucket_rows:
                    over = pd.concat(held)
                    held = []
                    yield pd.DataFrame({"a": over["node"], "b": 0, "over": False, "bucket": over["bucket"].astype("Int64"), "fp": over["fp"], "n": over["n"]})
            if len(out) > 50_000:
                yield _found(out)
                out = []
        yield _found(out + searched())

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["bucket", "a", "b"]):
            yield _found(_search(g["node"].to_numpy(), g["fp"].to_numpy().view(np.uint64), g["n"].to_numpy(), radius, jaccard))

    rows = rows.select("bucket", "node", "fp", "n").repartition("bucket").sortWithinPartitions("bucket")
    first = materialise(rows.mapInPandas(walk, _FOUND), "near-buckets")
    large = first.filter("bucket is not null").select("bucket", F.col("a").alias("node"), "fp", "n")
    sizes = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).select(unclustered("bucket"), "rows")
    keys = ["bucket", "a", "b"]
    met = chunk_pairs(large.join(sizes, "bucket"), F.ceil(2 * F.col("rows") / bucket_rows).cast("int")).select(*keys, "node", "fp", "n")
    met = met.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(meet, _FOUND)
    return first.filter("bucket is null").union(met).select("a", "b", "over")


def _links_between(rows: DataFrame, radius: int, words: int, jaccard: float) -> DataFrame:
    """Links (a, b) that connect the components inside each group of ``rows`` (grp, node, fp, n, component, text) which similar members connect.

    Chunks of a group meet in pairs, in tasks of their own. A task holds two chunks, compares the fingerprints of all
    their pairs of different components, verifies texts only where those are near, and returns a forest, so that what leaves it
    is no more than what came in.
    """
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).select(unclustered("grp"), "rows", "bytes")
    chunks = F.greatest(chunk_count(F.col("rows")), F.ceil(F.col("bytes") / CHUNK_BYTES).cast("int"))
    keys = ["grp", "a", "b"]
    met = chunk_pairs(rows.join(size, "grp"), chunks).select(*keys, "part", "node", "fp", "n", "component", "text").repartition(*keys).sortWithinPartitions(*keys, "node")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, keys):
            node, fp, n, part, text = g["node"].to_numpy(), g["fp"].to_numpy().view(np.uint64), g["n"].to_numpy(), g["part"].to_numpy(), g["text"].to_numpy()
            _, own = np.unique(g["component"].to_numpy(), return_inverse=True)
            root = np.arange(own.max() + 1)
            left, right = (np.arange(len(node)),) * 2 if part[0] == 2 else (np.flatnonzero(part == 0), np.flatnonzero(part == 1))
            known: dict[int, np.ndarray] = {}
            out = []
            for i in left:
                near = right[(np.bitwise_count(fp[right] ^ fp[i]) <= radius) & (root[own[right]] != root[own[i]])]
                near = near[np.minimum(n[near], n[i]) >= jaccard * np.maximum(n[near], n[i]) - 1e-9]
                for j in near.tolist():
                    if root[own[j]] == root[own[i]]:
                        continue
                    for k in (i, j):
                        if k not in known:
                            known[k] = np.unique(_shingles(_words(text[k]), words))
                    if _similar(known[i], known[j], jaccard):
                        out.append((int(node[i]), int(node[j])))
                        root[root == root[own[j]]] = root[own[i]]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.mapInPandas(walk, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, jaccard: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= jaccard * (len(x) + len(y) - both) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, words: int, jaccard: float) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets have that Jaccard similarity; ``texts``: node, text. A hub a is spread by salts."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, c, ta, tb in zip(b["a"], b["b"], b["ta"], b["tb"]):
                if a not in known:
                    known[a] = np.unique(_shingles(_words(ta), words))
                x, y = known[a], np.unique(_shingles(_words(tb), words))
                keep.append(_similar(x, y, jaccard))
            yield b[["a", "b"]][np.array(keep, dtype=bool)]

    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    hubs = pairs.select("a", "s").distinct().join(texts.toDF("a", "ta"), "a")
    return pairs.join(hubs, ["a", "s"]).join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def _contracted(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) as edges of the components ``comp`` that they join: those of a dense group soon lie inside one, and go."""
    to = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    e = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    return e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, words: int = NEAR_WORDS, jaccard: float = NEAR_JACCARD, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """(root, first): groups of documents linked by Jaccard similarity of their sets of ``words``-word shingles, and each one's first row.

    Found are pairs whose fingerprints differ in at most parts (radius + 1) - 1 bits. ``first`` is (unknown, doc_id, th): the least
    doc_id (null ids last), th the text's hash. Texts of equal words are one node; texts without words are linked to each other.
    """
    spark = docs.sparkSession

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                w = _words(t if isinstance(t, str) else None)
                h = _shingles(w, words)
                rows.append((xxhash.xxh3_64_intdigest(b" ".join(w)), _majority(h) if w else 0, len(np.unique(h))))
            node, fp, n = (np.array(x, dtype=np.uint64) for x in zip(*rows)) if rows else [np.zeros(0, dtype=np.uint64)] * 3
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "th": b["th"], "node": node.view(np.int64), "fp": fp.view(np.int64), "n": n.astype(np.int32)})

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("th")).mapInPandas(each, "doc_id long, th long, node long, fp long, n int")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")).alias("first")
    nodes = materialise(cut.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), first), "near-nodes")

    reach, bits = parts * (radius + 1) - 1, [list(range(64))[k::parts] for k in range(parts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.lit(signed(m)).cast("long") for own in bits for m in covering_masks(own, radius)])
    rows = nodes.select("node", "fp", "n", F.posexplode(masks).alias("table", "mask"))
    rows = rows.withColumn("bucket", F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))))
    found = _walk_buckets(rows, reach, jaccard).groupBy("a", "b").agg(F.bool_or("over").alias("over"))
    pairs = materialise(found, "near-pairs")

    def texts_of(used: DataFrame) -> DataFrame:
        used = used.join(nodes, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (_text_hash() == F.col("_th"))
        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(used, same).groupBy("node").agg(F.first("text").alias("text"))

    texts = materialise(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "near-texts")
    edges = materialise(_verified(pairs.select("a", "b"), texts, words, jaccard), "near-links")
    comp = materialise(connected_components(edges), "near-components")
    over = pairs.filter("over").select("a", "b")
    named = nodes.select("node", "first").join(comp, "node", "left").select(F.coalesce("component", "node").alias("root"), "first")
    if not over.isEmpty():
        # pairs of a large group outside its tree may be similar where the tree's are not; groups of one component have no more to tell
        group = connected_components(_contracted(over, comp)).select(F.col("node").alias("component"), F.col("component").alias("grp"))
        inside = over.select(F.col("a").alias("node")).union(over.select("b")).distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        group = materialise(inside.join(group, "component"), "near-groups")
        rows = group.join(nodes.select("node", "fp", "n"), "node").join(texts, "node")
        more = materialise(_links_between(rows, reach, words, jaccard), "near-links")
        merged = connected_components(_contracted(more, comp)).select(F.col("node").alias("root"), F.col("component").alias("to"))
        named = named.join(merged, "root", "left").select(F.coalesce("to", "root").alias("root"), "first")
    return named.groupBy("root").agg(F.min("first").alias("first"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of similar documents (5-word shingles, Jaccard 0.8) the row with the least doc_id (null ids last) stays.

    Columns of any name pass through.
    """
    kept = materialise(similar_groups(docs.select("doc_id", "text")).select(F.col("first.doc_id").alias("id"), F.col("first.th").alias("th")), "simhash-kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), _text_hash().alias("own_th"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th"))).dropDuplicates(["id", "th"]).select("row.*")
