"""Retrieval over knowledge vectors, layered typing, prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.patterns import ATTACK_TYPES
from wardline.functions.scalars import contains_any, fill_template, when_chain
from wardline.operators.neighbours import PivotIndex
from wardline.storage import materialise


def chunk_documents(docs: DataFrame, parts: list[str], metadata: list[str], key: str = "id") -> DataFrame:
    """(id, content, metadata): ``name: value`` lines of the given columns, blanks left out."""
    lines = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in parts]
    return docs.select(F.col(key).alias("id"), F.concat_ws("\n", *lines).alias("content"), F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in metadata)).alias("metadata"))


def index_rows(chunks: DataFrame) -> DataFrame:
    """Non-blank chunks with an id made of their content."""
    return chunks.filter(F.trim("content") != "").select(F.md5("content").alias("chunk_id"), "id", "content", "metadata").dropDuplicates(["chunk_id"])


def hashed_embedding(text: str = "content", dims: int = 64) -> Column:
    """A plain default embedding: signed counts of hashed words, of unit length; zeros for blank text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).cast("int").alias("i"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    raw = F.aggregate(slots, F.array_repeat(F.lit(0.0), dims), lambda acc, s: F.transform(acc, lambda x, i: F.when(i == s["i"], x + s["v"]).otherwise(x)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def knn_join(queries: DataFrame, base: DataFrame, k: int = 1, metric: str = "cosine", query_key: str = "query_id", base_key: str = "base_id", chunk: int = 1024, but_itself: bool = False) -> DataFrame:
    """(query_key, base_key, distance, rank): the ``k`` nearest base vectors of each query, exactly; ties go to the smaller key.

    ``cosine`` is 1 - similarity, ``l2sq`` the squared distance. With ``but_itself`` a base row with the query's key is no neighbour. Queries
    visit only the parts of the base that may hold one of their neighbours: see ``neighbours``. Vectors that are null, empty or hold a null or
    non-finite component, and for cosine zero ones, take no part; vectors of different dimensions don't meet. A query row that occurs twice is
    answered twice.
    """
    own = materialise(queries.select(query_key, "embedding").withColumn("q", F.monotonically_increasing_id()), "knn-queries")
    found, _ = PivotIndex(base, metric, base_key, chunk=chunk).rounds(own, k)
    x = own.select(query_key, "q").join(found, "q")
    x = x.filter(~F.col("b").eqNullSafe(F.col(query_key))) if but_itself else x
    w = Window.partitionBy(query_key, "q").orderBy("distance", "b")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_key, F.col("b").alias(base_key), "distance", "rank")


def knn_visits(queries: DataFrame, base: DataFrame, k: int = 1, metric: str = "cosine", query_key: str = "query_id", base_key: str = "base_id") -> DataFrame:
    """(query_key, visited, parts): how many of the base's parts each query had to search."""
    own = materialise(queries.select(query_key, "embedding").withColumn("q", F.monotonically_increasing_id()), "knn-queries")
    _, visits = PivotIndex(base, metric, base_key).rounds(own, k)
    return own.select(query_key, "q").join(visits, "q").drop("q")


def similar_events(queries: DataFrame, base: DataFrame, k: int = 3, least: float = 0.8, but_itself: bool = False) -> DataFrame:
    """(query_id, base_id, similarity, rank) with similarity 1 - distance of at least ``least``."""
    return knn_join(queries, base, k, but_itself=but_itself).withColumn("similarity", 1 - F.col("distance")).filter(F.col("similarity") >= least).select("query_id", "base_id", "similarity", "rank")


def first_hits(hits: DataFrame) -> DataFrame:
    """Each document once, from the first query (then rank) that found it."""
    w = Window.partitionBy("doc_id").orderBy("query_no", "rank")
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def semantic_candidate(path: str = "path") -> Column:
    """Which knowledge question a path raises: ``admin``, ``debug`` or null."""
    p = F.lower(path)
    return F.when(contains_any(p, ["/admin"]), "admin").when(contains_any(p, ["/debug", "/config", "/.env", "/actuator", "/internal", "/metrics"]), "debug")


def layered_type(semantic: str = "semantic_type", semantic_distance: str = "semantic_distance", pattern: str = "pattern_type", pattern_distance: str = "pattern_distance", knowledge: str = "knowledge_type", knowledge_distance: str = "knowledge_distance", regex: str = "regex_type", confidence: str = "regex_confidence") -> Column:
    """(type, layer): semantic (< .72, two classes) before fingerprint (< .20) before knowledge (< .72) before regex (>= .85)."""
    pick = lambda ok, t, layer: F.when(ok, F.struct(t.alias("type"), F.lit(layer).alias("layer")))
    s, p, k, r = (F.col(c) for c in (semantic, pattern, knowledge, regex))
    return F.coalesce(
        pick((F.col(semantic_distance) < 0.72) & s.isin("unauthorized access attack", "sensitive data leakage"), s, "semantic"),
        pick((F.col(pattern_distance) < 0.20) & p.isNotNull(), p, "pattern"),
        pick((F.col(knowledge_distance) < 0.72) & k.isNotNull(), k, "knowledge"),
        pick((F.col(confidence) >= 0.85) & (r != "unknown"), r, "regex"),
        F.struct(F.lit("unknown").alias("type"), F.lit("none").alias("layer")),
    )


def report_queries(recall: DataFrame, questions: DataFrame, crawler_found: bool, cap: int = 10, per_type: int | None = 1) -> DataFrame:
    """The first ``per_type`` questions (None: all) of the types with a recall under .9, and of those about crawlers if one was found."""
    weak = recall.filter(F.col("recall") < 0.9).select(F.col("expected").alias("attack_type"))
    asked = questions
    if per_type is not None:
        asked = questions.withColumn("_r", F.row_number().over(Window.partitionBy("attack_type").orderBy("query_no"))).filter(F.col("_r") <= per_type).drop("_r")
    x = asked.join(weak, "attack_type", "left_semi")
    if crawler_found:
        x = x.union(asked.filter("attack_type = 'crawler'").select(*x.columns))
    return x.orderBy("attack_type", "query_no").limit(cap)


def report_chunks(hits: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` first documents that a report quotes: each once, in the order of the queries and of their ranks; ``hits``: doc_id, query_no, rank."""
    return first_hits(hits).orderBy("query_no", "rank", "doc_id").limit(most)


def attack_type_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(ATTACK_TYPES)], "type_order int, attack_type string")


def prompt_table(logs: DataFrame, templates: DataFrame, events: DataFrame, history: int = 2) -> DataFrame:
    """(log_id, attack_type, prompt): each log with each type's template and its first similar events of that type.

    ``templates`` (attack_type, template) has a row per attack type: seven, so it is broadcast.
    """
    past = events.withColumn("_r", F.row_number().over(Window.partitionBy("log_id", "attack_type").orderBy("rank"))).filter(F.col("_r") <= history)
    past = past.groupBy("log_id", "attack_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "content"))), lambda x: x["content"]), "\n").alias("_past"))
    x = logs.crossJoin(F.broadcast(templates)).join(past, ["log_id", "attack_type"], "left")
    return x.select("log_id", "attack_type", fill_template("template", {"log_id": F.col("log_id"), "log": F.col("log_text"), "history": F.coalesce("_past", F.lit("none"))}).alias("prompt"))


HEADERS = ["number|type", "number|detection", "logid", "output format", "begin output", "final output", "output now"]


def parse_replies(replies: DataFrame) -> DataFrame:
    """First readable line of each reply (log_id, attack_type, content) as a stage-2 row.

    A line is ``id|verdict|type|confidence|reason``; headings and lines without a bar are skipped; the id counts if it
    is within ten of the asked one; a missing confidence is .9 and all are clamped to [0, 1]. Other lines count
    as anomalies if they name the asked type (.85) or any known one (.8).
    """
    lines = replies.select("log_id", "attack_type", F.posexplode(F.split("content", "\n")).alias("pos", "_l")).withColumn("line", F.trim("_l"))
    lines = lines.filter((F.col("line") != "") & F.contains("line", F.lit("|")) & ~contains_any(F.lower("line"), HEADERS))
    p = lines.withColumn("p", F.transform(F.split("line", r"\|"), lambda x: F.trim(x))).filter(F.size("p") >= 2)
    part = lambda i: F.try_element_at("p", F.lit(i))
    found = F.expr("try_cast(nullif(regexp_extract(p[0], '([0-9]+)', 1), '') as long)")
    low, n = F.lower("line"), F.size("p")
    verdict = F.lower(part(2))
    asked = F.contains(low, F.lower("attack_type"))
    known = when_chain((F.contains(low, F.lit(t)), F.lit(t)) for t in ATTACK_TYPES)
    said = F.when(n >= 5, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("try_cast(try_element_at(p, 4) as double)"))), F.lit(0.9))).otherwise(0.9)
    p = p.withColumns({
        "id": F.when(F.abs(found - F.col("log_id")) <= 10, found).otherwise(F.col("log_id")),
        "type": F.when(verdict == "normal", "normal").when((verdict == "anomaly") | asked | known.isNotNull(), "anomaly"),
        "anomaly_type": F.when(verdict == "normal", "").when(verdict == "anomaly", F.coalesce(part(3), "attack_type")).when(asked, F.col("attack_type")).otherwise(known),
        "confidence": F.when(verdict == "normal", 0.9).when(verdict == "anomaly", said).when(asked, 0.85).otherwise(0.8),
        "reason": F.when(verdict == "anomaly", F.coalesce(F.when(n >= 5, part(5)), part(4), F.lit(""))).otherwise(""),
    }).filter("type is not null")
    first = p.groupBy("log_id", "attack_type").agg(F.min_by(F.struct("id", "type", "anomaly_type", "confidence", "reason"), "pos").alias("x"))
    return first.select(F.col("log_id").alias("asked_id"), "attack_type", F.col("x.id").alias("log_id"), "x.type", "x.anomaly_type", "x.confidence", "x.reason")


def serial_verdict(parsed: DataFrame, types: DataFrame) -> DataFrame:
    """(log_id, verdict, anomaly_type, calls): the first anomalous type in order, else normal after all."""
    x = parsed.join(F.broadcast(types), "attack_type")
    hit = F.col("type") == "anomaly"
    g = x.groupBy("asked_id").agg(F.min(F.when(hit, F.col("type_order"))).alias("o"), F.min_by("anomaly_type", F.when(hit, F.col("type_order")).otherwise(F.lit(99))).alias("t"))
    return g.select(F.col("asked_id").alias("log_id"), F.when(F.col("o").isNotNull(), "anomaly").otherwise("normal").alias("verdict"), F.when(F.col("o").isNotNull(), F.col("t")).otherwise("").alias("anomaly_type"), (F.coalesce(F.col("o"), F.lit(len(ATTACK_TYPES) - 1)) + 1).alias("calls"))


def format_chat(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, text): turns in order as ``<role>: text`` lines."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    g = turns.groupBy(key).agg(rows.alias("r"))
    return g.select(key, F.size("r").alias("n_turns"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("<"), x["role"], F.lit(">: "), x["text"])), "\n").alias("text"))


def quota_sample(rows: DataFrame, quotas: dict[str, int], source: str = "source", key: str = "id") -> DataFrame:
    """The first rows of each source by a hash of the key, up to its quota."""
    quota = when_chain((F.col(source) == s, F.lit(n)) for s, n in quotas.items())
    w = Window.partitionBy(source).orderBy(F.md5(F.col(key).cast("string")), key)
    most = max(quotas.values())
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).filter(F.col("_r") <= quota).drop("_r")
