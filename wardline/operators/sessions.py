"""Sessions: stitching, per-session features, rule verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.patterns import KNOWN_CRAWLERS, SENSITIVE_WORDS, SUSPICIOUS_AGENTS
from wardline.functions.scalars import contains_any, flag, sigmoid
from wardline.operators.scans import counted, numbered_runs, recent_counts, split_keys
from wardline.storage import materialise


def parsable(records: DataFrame, time: str = "ts") -> DataFrame:
    """``records`` with ``time`` read as a timestamp; rows whose time is missing or can't be read go."""
    return records.withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))).filter(F.col(time).isNotNull())


CELL_SECONDS = 3600  # a large key's time is scanned in cells of this width: see ``scans``


def stitch(records: DataFrame, gap_seconds: float = 60, by: str = "source_ip", cell_seconds: float | None = None) -> DataFrame:
    """Add ``session_no`` and ``session_start``: a new session of an address starts after a gap longer than ``gap_seconds``.

    Rows without a time are dropped. A gap of just ``gap_seconds`` stays in the session. An address of many rows is scanned in cells of
    time, so that one that never rests is spread; with ``cell_seconds`` every address is.
    """
    rows = records.filter("ts is not null")
    if cell_seconds is None:
        few, many = split_keys(rows, [by])
        whole = _stitched(few, gap_seconds, by, None)
        return whole if many is None else whole.unionByName(_stitched(many, gap_seconds, by, CELL_SECONDS))
    return _stitched(rows, gap_seconds, by, cell_seconds)


def _stitched(rows: DataFrame, gap_seconds: float, by: str, cell_seconds: float | None) -> DataFrame:
    gap = lambda prev, row: (F.unix_micros(row["ts"]) - F.unix_micros(prev["ts"])) / 1e6 > gap_seconds
    cut = numbered_runs(rows, [by], ["ts", "log_id"], ["ts"], gap, "session_no", cell_seconds, start_of="ts")
    return cut.withColumnRenamed("session_no_start", "session_start").drop("_prev")


def with_session_id(stitched: DataFrame, by: str = "source_ip") -> DataFrame:
    """Add a short ``session_id``: a hash of address and start."""
    return stitched.withColumn("session_id", F.md5(F.concat_ws("_", by, F.unix_micros("session_start").cast("string"))))


def session_labels(stitched: DataFrame, by: str = "source_ip") -> DataFrame:
    """(by, session_no, session_label): source tags (``multi`` beyond three), size, first path's start, hash suffix."""
    tags = F.sort_array(F.collect_set(F.coalesce("source_type", F.lit("unknown"))))
    g = stitched.groupBy(by, "session_no").agg(
        tags.alias("tags"), F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct("ts", "log_id")).alias("first_path"), F.min("ts").alias("start")
    )
    tag = F.when(F.size("tags") <= 3, F.array_join("tags", "+")).otherwise("multi")
    head = F.substring(F.regexp_replace(F.replace(F.coalesce("first_path", F.lit("/")), F.lit("/"), F.lit("_")), "^_+|_+$", ""), 1, 12)
    suffix = F.substring(F.md5(F.concat_ws("_", by, F.unix_micros("start").cast("string"))), 1, 6)
    return g.select(by, "session_no", F.concat_ws("_", F.lit("stitched"), tag, F.concat(F.col("n").cast("string"), F.lit("req")), head, suffix).alias("session_label"))


def repeated_path_count(records: DataFrame, key: str = "session_id", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """Add ``repetitive_path_count``: earlier requests of the session to the same path."""
    return counted(records, [key, "path"], ["ts", "log_id"], "repetitive_path_count", cell_seconds)


def path_runs(records: DataFrame, key: str | list[str] = "session_id", cell_seconds: float | None = CELL_SECONDS) -> DataFrame:
    """Add ``_run``, the number of the run of one path that a request is in, and ``_prev``, time and path of the request before."""
    other = lambda prev, row: ~prev["path"].eqNullSafe(row["path"])
    return numbered_runs(records, [key] if isinstance(key, str) else key, ["ts", "log_id"], ["ts", "path"], other, "_run", cell_seconds)


def longest_path_runs(records: DataFrame, key: str = "session_id", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """(key, max_consecutive_same_path): repeats in the longest run of one path."""
    return path_runs(records, key, cell_seconds).groupBy(key, "_run").count().groupBy(key).agg((F.max("count") - 1).alias("max_consecutive_same_path"))


def session_features(records: DataFrame, key: str = "session_id", cell_seconds: float | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """18 features of every session of at least two requests, its category (``mixed`` if several) and validity.

    ``within``: columns that the session determines, such as the address it was stitched from: rows that lie together by these stay
    where they are. Windows go by cells of a session's time where there are many rows to it, and counts are summed by run, path and
    session in turn, so that a session of any length is spread; with ``cell_seconds`` every session is.
    """
    own = records.filter("ts is not null").select(*within, key, "log_id", "ts", "path", "status", "method", "user_agent", "category")
    if cell_seconds is None:
        few, many = split_keys(own, list(within) or [key])
        whole = _session_features(few, key, None, within)
        return whole if many is None else whole.unionByName(_session_features(many, key, CELL_SECONDS, within))
    return _session_features(own, key, cell_seconds, within)


def _session_features(own: DataFrame, key: str, cell_seconds: float | None, within: tuple[str, ...]) -> DataFrame:
    low = F.lower("user_agent")
    known = contains_any(low, KNOWN_CRAWLERS)
    odd = contains_any(low, SUSPICIOUS_AGENTS)
    if cell_seconds is not None:
        own = materialise(own, "session-rows")  # the scan reads it twice
    by = [*within, key]
    rows = path_runs(own, by, cell_seconds).withColumn("_interval", (F.unix_micros("ts") - F.unix_micros("_prev.ts")) / 1e6).drop("_prev")
    rows = recent_counts(rows, by, "ts", {"_p1": 1, "_p5": 5}, cell_seconds)
    runs = rows.groupBy(*by, "path", "_run").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("_interval").alias("gaps"), F.min("_interval").alias("gap"),
        F.max("_p1").alias("p1"), F.max("_p5").alias("p5"),
        F.sum(flag(contains_any(F.lower("path"), SENSITIVE_WORDS))).alias("sensitive"), F.sum(flag(F.contains(F.lower("path"), F.lit("/login")))).alias("logins"),
        F.sum(flag(F.col("status").between(400, 599))).alias("errors"), F.sum(flag(F.col("status").isin(401, 403))).alias("auth"),
        F.sum(flag(F.col("method") == "POST")).alias("posts"), F.sum(flag(known)).alias("known"), F.sum(flag(~known & odd)).alias("odd"), F.max(flag(odd)).alias("any_odd"),
        F.min("category").alias("c0"), F.max("category").alias("c1"),
    )
    paths = runs.groupBy(*by, "path").agg(
        F.sum("n").alias("hits"), F.max("n").alias("run"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("gap").alias("gap"),
        F.max("p1").alias("p1"), F.max("p5").alias("p5"), F.max("any_odd").alias("any_odd"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
        *(F.sum(c).alias(c) for c in ("sensitive", "logins", "errors", "auth", "posts", "known", "odd")),
    )
    s = paths.groupBy(*by).agg(
        F.sum("hits").alias("n"), F.count(F.lit(1)).alias("unique_paths"), F.max("hits").alias("top"), (F.max("run") - 1).alias("run"),
        ((F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))) / 1e6).alias("duration"), F.min("gap").alias("gap"), F.max("p1").alias("p1"), F.max("p5").alias("p5"),
        F.max("any_odd").alias("any_odd"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), *(F.sum(c).alias(c) for c in ("sensitive", "logins", "errors", "auth", "posts", "known", "odd")),
    )
    n = F.col("n")
    return s.filter("n >= 2").select(
        key, n.alias("request_count"), F.round("duration", 2).alias("duration_sec"), F.round(F.col("duration") / (n - 1), 3).alias("avg_interval_sec"),
        F.round(F.col("gap") * 1000, 1).alias("min_interval_ms"),
        F.round(F.when(F.col("duration") > 0, n / F.col("duration")).otherwise(n.cast("double")), 3).alias("requests_per_second"), "unique_paths",
        F.round(F.col("unique_paths") / n, 4).alias("path_diversity_ratio"), F.round(1 - F.col("unique_paths") / n, 4).alias("path_repetition_rate"),
        F.round(F.col("top") / n, 4).alias("path_concentration"), F.round(F.col("sensitive") / n, 4).alias("sensitive_path_ratio"),
        F.round(F.col("errors") / n, 4).alias("error_rate"), F.col("auth").alias("auth_fail_count"), F.round(F.col("posts") / n, 4).alias("post_ratio"),
        F.col("p1").cast("double").alias("peak_rps_1s"), F.round(F.col("p5") / 5, 3).alias("peak_rps_5s"), F.col("run").alias("max_consecutive_same_path"),
        F.round(F.col("known") / n, 4).alias("known_crawler_ua_ratio"), F.round(F.col("odd") / n, 4).alias("suspicious_ua_ratio"),
        F.when(F.col("c0") == F.col("c1"), F.col("c0")).otherwise("mixed").alias("true_category"),
        F.col("sensitive").alias("sensitive_count"), F.col("logins").alias("login_count"), (F.col("known") > 0).alias("has_known"), (F.col("any_odd") > 0).alias("has_suspicious"),
        F.lit(True).alias("feature_valid"),
    )


FEATURES = [
    "request_count", "duration_sec", "avg_interval_sec", "min_interval_ms", "requests_per_second", "unique_paths", "path_diversity_ratio", "path_repetition_rate",
    "path_concentration", "sensitive_path_ratio", "error_rate", "auth_fail_count", "post_ratio", "peak_rps_1s", "peak_rps_5s", "max_consecutive_same_path",
    "known_crawler_ua_ratio", "suspicious_ua_ratio",
]


def rule_verdicts(features: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, rule_score, verdict, confidence, reasons): six expert rules on ``session_features``."""
    rps, top = F.col("requests_per_second"), F.col("path_concentration")
    polite = F.col("has_known") & ~F.col("has_suspicious")
    stuffing = (F.col("login_count") > 10) & (F.col("auth_fail_count") > F.col("login_count") * 0.5)
    score = (
        F.when(polite, -1.0).otherwise(0.0)
        + F.when(F.col("has_suspicious"), 2.0).otherwise(0.0)
        + F.when(rps > 10, 2.5).when(rps > 3, 1.0).otherwise(0.0)
        + F.when(top > 0.8, 2.0).when(top > 0.5, 0.5).otherwise(0.0)
        + F.when(F.col("max_consecutive_same_path") >= 5, 1.5).otherwise(0.0)
        + F.col("sensitive_count") * 0.3
        + F.when(stuffing, 2.0).otherwise(0.0)
    )
    s = features.withColumn("_s", score)
    verdict = F.when(polite & (F.col("_s") <= 1.0), "legit_crawler").when(F.col("_s") >= 1.5, "malicious_crawler").otherwise("normal")
    reasons = F.array_compact(F.array(
        F.when(polite, F.lit("known_crawler_ua")), F.when(F.col("has_suspicious"), F.lit("suspicious_ua")), F.when(rps > 10, F.lit("high_rps")).when(rps > 3, F.lit("medium_rps")),
        F.when(top > 0.8, F.lit("path_concentration")), F.when(F.col("max_consecutive_same_path") >= 5, F.lit("consecutive_repeat")),
        F.when(F.col("sensitive_count") > 0, F.lit("sensitive_paths")), F.when(stuffing, F.lit("credential_stuffing")),
    ))
    sure = sigmoid(F.col("_s") - 1.0)
    return s.select(
        key, F.round("_s", 2).alias("rule_score"), verdict.alias("verdict"), F.when(verdict == "normal", 1 - sure).otherwise(sure).alias("confidence"),
        F.array_join(reasons, ",").alias("reasons"),
    )


def top_sessions(verdicts: DataFrame, n: int = 15, by: str = "rule_score", key: str = "session_id") -> DataFrame:
    return verdicts.orderBy(F.desc(by), key).limit(n)


def session_features_wide(features: DataFrame) -> DataFrame:
    """The numeric matrix with a binary label."""
    return features.select("session_id", *FEATURES, flag(F.col("true_category") == "malicious_crawler").alias("label"))
