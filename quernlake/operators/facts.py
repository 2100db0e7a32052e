"""Attempts brought to the grain of sessions before any join, so that amounts never fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.schemas import SUCCESS_STATUSES


def attempt_stats(tries: DataFrame, sessions: DataFrame | None = None, last_psp: bool = False) -> DataFrame:
    """(session_id, max_try_seq, attempt_count, no_attempt) per session; ``sessions`` narrows the attempts first.

    ``no_attempt`` is 1 where any row has try_seq 0: a session may have it beside real attempts.  ``last_psp`` adds the
    provider of the last real attempt (NULL where that has none), from the same rows.
    """
    rows = tries if sessions is None else tries.join(sessions.select("session_id"), "session_id", "left_semi")
    last = [F.max_by(F.struct("psp_code"), F.when(F.col("try_seq") >= 1, F.col("try_seq")))["psp_code"].alias("last_psp")] if last_psp else []
    return rows.groupBy("session_id").agg(
        *last, F.max("try_seq").cast("int").alias("max_try_seq"), F.count_if(F.col("try_seq") >= 1).alias("attempt_count"), F.max(F.when(F.col("try_seq") == 0, 1).otherwise(0)).alias("no_attempt")
    )


def with_stats(sessions: DataFrame, tries: DataFrame) -> DataFrame:
    """Sessions left-joined with their attempt statistics (NULL where a session has no rows at all)."""
    return sessions.join(attempt_stats(tries, sessions), "session_id", "left")


def amount_if(condition: Column, column: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("long")


def session_measures() -> list[Column]:
    """The measures of a group of sessions with statistics, all from one scan."""
    status, none = F.col("session_status"), F.col("no_attempt") == 1
    failed = status == "Failed"
    return [
        F.count("*").alias("sessions"), F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("amount"), F.coalesce(F.sum("adjusted_fee"), F.lit(0)).cast("long").alias("fee"),
        F.count_if(failed).alias("failed"), F.count_if(status.isin(*SUCCESS_STATUSES)).alias("success"), F.count_if(none).alias("no_attempt"),
        F.count_if(F.col("max_try_seq") >= 1).alias("attempted"), F.count_if(F.col("max_try_seq") > 1).alias("retry"),
        F.count_if(failed & none).alias("failed_no_attempt"), amount_if(failed & none).alias("failed_no_attempt_amount"),
    ]


MEASURES = ("sessions", "amount", "fee", "failed", "success", "no_attempt", "attempted", "retry", "failed_no_attempt", "failed_no_attempt_amount")
