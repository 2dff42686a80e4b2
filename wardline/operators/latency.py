"""Runs of slow requests along an endpoint's sequence: rising and repeated latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.requests import slow_for_class
from wardline.operators.scans import numbered_runs

CELL_SECONDS = 3600


def rising_latency(records: DataFrame, growth: float = 1.0, by: str = "endpoint", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """(by, run, first_id, last_id, steps, first_ms, last_ms): runs of ever longer response times that grow by more than ``growth`` (1: by 100 %).

    A run is a stretch of an endpoint's requests in order of time each of which took longer than the one before. Requests without a
    time or a positive response time are left out. The sequence is scanned in cells: see ``scans``.
    """
    rows = records.filter("ts is not null and response_time > 0")
    fell = lambda prev, row: row["response_time"] <= prev["response_time"]
    x = numbered_runs(rows, [by], ["ts", "log_id"], ["response_time"], fell, "run", cell_seconds)
    at = F.struct("ts", "log_id")
    g = x.groupBy(by, "run").agg(
        F.min_by("log_id", at).alias("first_id"), F.max_by("log_id", at).alias("last_id"), F.count(F.lit(1)).alias("steps"), F.min("response_time").alias("first_ms"), F.max("response_time").alias("last_ms"),
    )
    return g.filter(F.col("last_ms") > (1 + growth) * F.col("first_ms"))


def repeated_latency(records: DataFrame, least: int = 3, by: str = "endpoint", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """(by, run, first_id, last_id, steps): runs of ``least`` or more requests in a row that are too slow for their kind."""
    rows = records.filter("ts is not null").withColumn("_slow", slow_for_class())
    other = lambda prev, row: prev["_slow"] != row["_slow"]
    x = numbered_runs(rows, [by], ["ts", "log_id"], ["_slow"], other, "run", cell_seconds)
    at = F.struct("ts", "log_id")
    g = x.filter("_slow").groupBy(by, "run").agg(F.min_by("log_id", at).alias("first_id"), F.max_by("log_id", at).alias("last_id"), F.count(F.lit(1)).alias("steps"))
    return g.filter(F.col("steps") >= least)
