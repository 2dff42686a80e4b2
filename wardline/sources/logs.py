"""Log sources, their unified schema, and the sinks."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.scalars import col
from wardline.operators.ordering import with_row_number
from wardline.storage import materialise

_INTS = ("status", "latency_ms")
UNIFIED = T.StructType([T.StructField("ts", T.TimestampType())] + [
    T.StructField(c, T.IntegerType() if c in _INTS else T.StringType())
    for c in "source_ip method path status user_agent request_body response_body latency_ms severity rule_id alert_type session_id source_type raw".split()
])
API_LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("method", "request_body", "request_url", "response_body", "status", "response_time", "user_identity", "label")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = API_LOG, header: bool = True) -> DataFrame:
    """CSV with quoted line feeds; rows that don't fit are kept in ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("header", header).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected raw rows) of a permissive read, which is parsed once and written."""
    df = materialise(df, "parsed")
    bad = F.col("_corrupt_record").isNotNull()
    return df.filter(~bad).drop("_corrupt_record"), df.filter(bad).select("_corrupt_record")


def read_json_table(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON array (or lines) table; an absent path is an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_labelled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Labelled set by extension."""
    return read_json_table(spark, path, schema) if path.endswith(".json") else read_csv(spark, path, schema).drop("_corrupt_record")


def _text(c: str, otherwise: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(otherwise))


def _unified(raw: DataFrame, source: str, prefix: str, time: str, address: str, columns: dict[str, Column]) -> DataFrame:
    """Project a raw table to the unified schema; columns that the source lacks are empty."""
    session = F.concat(F.lit(prefix + "_"), F.substring(F.md5(_text(address)), 1, 8))
    own = {"ts": F.try_to_timestamp(F.col(time)) if dict(raw.dtypes)[time] == "string" else F.col(time).cast("timestamp"), "source_ip": _text(address), "session_id": session, "source_type": F.lit(source), "raw": F.to_json(F.struct("*"))} | columns
    empty = {"string": F.lit(""), "int": F.lit(0)}
    return raw.select(*(own.get(f.name, empty.get(f.dataType.simpleString())).cast(f.dataType).alias(f.name) for f in UNIFIED))


def normalise_waf(raw: DataFrame) -> DataFrame:
    return _unified(raw, "waf", "waf", "timestamp", "client_ip", {
        "method": _text("method", "GET"), "path": _text("uri"), "status": F.coalesce("status", F.lit(0)), "user_agent": _text("user_agent"), "request_body": _text("request_body"),
        "severity": _text("severity"), "rule_id": _text("rule_id"), "alert_type": _text("action"),
    })


def normalise_ids(raw: DataFrame) -> DataFrame:
    return _unified(raw, "ids", "ids", "timestamp", "src_ip", {
        "method": _text("http_method", "GET"), "path": _text("uri"), "status": F.when(F.col("severity") == "HIGH", 403).otherwise(200), "user_agent": _text("http_user_agent"),
        "severity": _text("severity"), "rule_id": _text("signature"), "alert_type": _text("alert_type"),
    })


def normalise_gateway(raw: DataFrame) -> DataFrame:
    return _unified(raw, "api_gateway", "gw", "request_time", "client_ip", {
        "method": _text("request_method", "GET"), "path": _text("request_uri"), "status": F.coalesce("status_code", F.lit(0)), "user_agent": _text("user_agent"),
        "request_body": _text("request_body"), "response_body": _text("response_body"), "latency_ms": F.coalesce("response_time_ms", F.lit(0)),
    })


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"waf": normalise_waf, "ids": normalise_ids, "api_gateway": normalise_gateway}


def collect_sources(raw: dict[str, DataFrame], since: str | None = None, limit: int | None = None, adapters: dict[str, Callable[[DataFrame], DataFrame]] = ADAPTERS) -> DataFrame:
    """Union of the given sources in the unified schema; ``since`` filters by time, ``limit`` keeps the first rows of each source.

    Time order is left to the reader: sort the output, not the union.
    """
    parts = [adapters[k](df) for k, df in raw.items() if k in adapters]
    if since is not None:
        parts = [p.filter(F.col("ts") >= F.lit(since).cast("timestamp")) for p in parts]
    if limit is not None:
        parts = [p.orderBy("ts", "source_ip", "path").limit(limit) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), parts)


def collect_tolerant(readers: dict[str, Callable[[], DataFrame]], since: str | None = None, limit: int | None = None, adapters: dict[str, Callable[[DataFrame], DataFrame]] = ADAPTERS) -> tuple[DataFrame | None, dict[str, str]]:
    """(records, failures): what ``collect_sources`` gives for the sources that can be read, and the others' errors by name.

    A source fails when its reader does, when its columns don't fit, or while its rows are read: each is written by
    itself before the union. A source without an adapter is a failure, too; no readable source gives None.
    """
    parts, failures = [], {}
    for name, read in readers.items():
        try:
            parts.append(materialise(collect_sources({name: read()}, since, limit, {name: adapters[name]}), f"source-{name}"))
        except (PySparkException, Py4JJavaError, OSError, KeyError) as e:
            failures[name] = f"{type(e).__name__}: {e}"[:500]
    return (reduce(lambda a, b: a.unionByName(b), parts) if parts else None), failures


def count_by_source(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).count()


# ---- keyed tables


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` updated by ``changes`` (nulls keep the old value), and new keys."""
    rest = [c for c in table.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") if c in changes.columns else F.lit(None).alias(f"_{c}") for c in rest), F.lit(True).alias("_there"))
    return table.withColumn("_old", F.lit(True)).join(new, key, "full_outer").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose keys it lacks."""
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti"))


def insert_with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key exists."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    return delete(parents, gone, key), children.join(gone.select(F.col(key).alias(child_key)), child_key, "left_anti")


def merge_incidents(new: DataFrame, old: DataFrame, keep: int = 1000) -> DataFrame:
    """Newest batch first, ``keep`` rows in all (a top-k, no global window)."""
    both = new.withColumn("_batch", F.lit(0)).unionByName(old.withColumn("_batch", F.lit(1)))
    return both.orderBy("_batch", F.desc("detected_at"), "id").limit(keep).drop("_batch")


# ---- sinks


def write_batches(results: DataFrame, path: str, rows: int = 50) -> None:
    results.write.mode("overwrite").option("maxRecordsPerFile", rows).option("header", True).csv(path)


def batch_tally(results: DataFrame, rows: int = 50, order: str = "log_id") -> DataFrame:
    """Verdicts per batch of ``rows`` ids."""
    return results.groupBy(F.floor(F.col(order) / rows).alias("batch_id"), "type").count()


def write_table(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """Final results (csv), metrics (json), stage results (json or parquet), appended health rows (mode append)."""
    df.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def outbox(incidents: DataFrame) -> DataFrame:
    """One message per incident that its disposition sends out; nothing is delivered from here."""
    to = F.when(F.col("disposition").isin("notify_email", "escalate"), "email").when(F.col("disposition") == "notify_slack", "slack").when(F.col("disposition") == "auto_block", "gateway").when(F.col("disposition") == "auto_log", "log")
    subject = F.format_string("[%s] %s on %s", "severity", "anomaly_type", "api_endpoint")
    body = F.concat_ws("\n", F.concat(F.lit("Incident: "), F.col("id").cast("string")), F.concat(F.lit("Disposition: "), "disposition"), F.concat(F.lit("Reason: "), "reason"))
    return incidents.withColumn("channel", to).filter("channel is not null").select("id", "channel", subject.alias("subject"), body.alias("body"))


def health_notices(changes: DataFrame, threshold: float = 0.1) -> DataFrame:
    way = F.when(F.col("health_delta") > 0, "improved").otherwise("degraded")
    return changes.filter(F.abs("health_delta") > threshold).select("incident_id", "api_endpoint", F.concat_ws(" ", F.lit("Health"), way, F.lit("on"), "api_endpoint").alias("message"))


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, ord, line): a report's tables as text lines, ordered by section and their own order."""
    parts = []
    for k, (title, df) in enumerate(sections.items()):
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
        spark = df.sparkSession
        head = spark.range(1).select(F.lit(k).alias("section"), F.lit(-1).cast("long").alias("ord"), F.lit(f"## {title}").alias("line"))
        parts.append(head.union(with_row_number(df, df.columns[:1], "_ord").select(F.lit(k), "_ord", line)))
    return reduce(lambda a, b: a.union(b), parts)


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON lines."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.union(edges.select(F.lit("edge"), F.to_json(F.struct(*edges.columns))))


def glob_to_regex(pattern: str) -> str:
    return fnmatch.translate(pattern)


def text_of(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))
