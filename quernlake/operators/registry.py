"""Versioned metric contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.operators.overview import STATUS_LIMITATION, TIME_LIMITATION

#: Fixed values.
VERSION = "1.0.0"
CONTRACTS = (
    ("sessions.created", "session", "count distinct session_key", False, ()),
    ("amount.requested", "session", "sum amount once per session", False, ()),
    ("sessions.failed_rate", "session", "Failed sessions / created sessions", False, ()),
    ("sessions.verified_rate", "session", "Verified or Paid sessions / created sessions", True, (STATUS_LIMITATION,)),
    ("sessions.no_attempt_rate", "session", "sessions with no PSP attempt / created sessions", False, ()),
    ("sessions.retry_rate", "session", "sessions with max try_seq > 1 / sessions with a PSP attempt", True, ()),
    ("fees.adjusted", "session", "sum adjusted_fee once per session", True, ("Charging semantics are unconfirmed.",)),
    ("benchmarks.category_equal_weighted", "merchant", "median and IQR across eligible same-category merchants, one vote each", True, ("At least 30 sessions per peer and 10 peers are required.",)),
)
#: Metrics that the metric documentation defines beside the served ones.
DOCUMENTED = (
    ("attempts.processed", "attempt", "attempts with try_seq >= 1", True, ()),
    ("sessions.settled_rate", "session", "sessions with a settled attempt / created sessions", True, ()),
    ("latency.verify", "attempt", "p50 and p95 of verify_time_ms where present", True, ()),
    ("failures.by_code", "attempt", "failed attempts by switch_response_code", True, ()),
)


def metric_registry(spark: SparkSession, documented: bool = False) -> DataFrame:
    """(version, metric_id, grain, formula, time_field, proposed, limitations) of each contract."""
    rows = [(VERSION, name, grain, formula, "created_at", proposed, [*limits, TIME_LIMITATION]) for name, grain, formula, proposed, limits in (*CONTRACTS, *(DOCUMENTED if documented else ()))]
    return spark.createDataFrame(rows, "version string, metric_id string, grain string, formula string, time_field string, proposed boolean, limitations array<string>")


def registry_in_use(spark: SparkSession, sessions: DataFrame, tries: DataFrame) -> DataFrame:
    """The documented contracts with what each rests on: rows of its grain, and the latest of its time field."""
    attempts = tries.filter(F.col("try_seq") >= 1).join(sessions.select("session_id", "created_at"), "session_id")
    facts = lambda rows, grain, n: rows.agg(n.alias("rows"), F.max("created_at").alias("latest")).select(F.lit(grain).alias("grain"), "rows", "latest")
    held = facts(sessions, "session", F.count("*")).unionByName(facts(attempts, "attempt", F.count("*"))).unionByName(facts(sessions, "merchant", F.count_distinct("merchant_id")))
    return metric_registry(spark, documented=True).join(held, "grain", "left")
