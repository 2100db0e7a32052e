"""Peer benchmarks of a category: one vote per merchant, suppressed for small cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.functions.rates import safe_rate
from quernlake.operators.facts import session_measures, with_stats
from quernlake.operators.ordered import percentiles, same
from quernlake.plans.scope import Range, Scope
from quernlake.sources.scratch import written

#: Sessions of a peer and peers of a cohort at least; the direction in which a metric is better.
PEER_SESSIONS, PEERS = 30, 10
DIRECTIONS = {"sessions.failed_rate": "lower", "sessions.no_attempt_rate": "lower", "sessions.retry_rate": "lower", "sessions.verified_rate": "higher", "latency.init_p95": "lower"}


@dataclass(frozen=True)
class Benchmark:
    suppressed: bool
    reason: str | None
    signal: str | None
    metrics: DataFrame | None


def cohort(sessions: DataFrame, tries: DataFrame, category_id: str, period: Range) -> DataFrame:
    """(merchant_id, sessions, one column per metric) of merchants with enough sessions in the category and range.

    The retry rate of a merchant without attempts is 0 here; latency is NULL where there is none.
    """
    rows = sessions.filter((F.col("category_id") == category_id) & period.holds("created_at"))
    sums = with_stats(rows, tries).groupBy("merchant_id").agg(*session_measures()).filter(F.col("sessions") >= PEER_SESSIONS)
    timed = tries.filter((F.col("try_seq") >= 1) & F.col("init_time_ms").isNotNull()).join(rows.select("session_id", "merchant_id"), "session_id")
    slow = percentiles(timed, ["merchant_id"], "init_time_ms", {"p95": 0.95}).withColumnRenamed("p95", "latency.init_p95")
    return sums.join(slow, "merchant_id", "left").select(
        "merchant_id", "sessions", safe_rate(F.col("failed"), F.col("sessions")).alias("sessions.failed_rate"), safe_rate(F.col("no_attempt"), F.col("sessions")).alias("sessions.no_attempt_rate"),
        F.coalesce(safe_rate(F.col("retry"), F.col("attempted")), F.lit(0.0)).alias("sessions.retry_rate"), safe_rate(F.col("success"), F.col("sessions")).alias("sessions.verified_rate"), F.col("`latency.init_p95`"),
    )


def long_values(rows: DataFrame) -> DataFrame:
    """(merchant_id, metric_id, value, direction), missing values left out."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(f"`{m}`").alias("value"), F.lit(d).alias("direction")) for m, d in DIRECTIONS.items()])
    return rows.select("merchant_id", F.inline(entries)).filter(F.col("value").isNotNull())


def summary(rows: DataFrame, merchant_id: int) -> DataFrame:
    """Quartiles of the peers, the selected merchant's value, the share of peers it does not beat, and the IQR signal by metric."""
    values = long_values(rows)
    own = values.filter(F.col("merchant_id") == merchant_id).select("metric_id", F.col("value").alias("selected_value"))
    peers = values.filter(F.col("merchant_id") != merchant_id).join(own, "metric_id")
    lower = F.col("direction") == "lower"
    good = F.when(lower, F.col("value") >= F.col("selected_value")).otherwise(F.col("value") <= F.col("selected_value"))
    keys = ["metric_id", "direction", "selected_value"]
    grouped = peers.groupBy(*keys).agg(F.avg(good.cast("double")).alias("percentile"), F.count("*").alias("cohort_size"))
    grouped = same(grouped, percentiles(peers, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys)
    outside = F.when(lower, F.col("selected_value") > F.col("q3")).otherwise(F.col("selected_value") < F.col("q1"))
    return grouped.filter(F.col("cohort_size") >= PEERS).withColumn("outside_iqr", outside).withColumn("gap", F.abs(F.col("selected_value") - F.col("median")))


def suppression(metrics: DataFrame) -> DataFrame:
    """One row (suppressed, reason, signal) for the summary() of a merchant.

    Every peer has a failed rate, so that its row tells whether the merchant is in the cohort and has peers enough.
    """
    seen = metrics.agg(F.count_if(F.col("metric_id") == "sessions.failed_rate").alias("enough"), F.max(F.col("outside_iqr").cast("int")).alias("outside"))
    none = F.col("enough") == 0
    return seen.select(none.alias("suppressed"), F.when(none, "insufficient_cohort").alias("reason"), F.when(~none, F.when(F.col("outside") == 1, "unfavorable_outside_iqr").otherwise("neutral")).alias("signal"))


def own_summary(scope: Scope, period: Range) -> DataFrame:
    """The summary of the scope's merchant in its category, the smallest it has."""
    category = scope.own_sessions.agg(F.min("category_id")).first()[0]
    return summary(cohort(scope.sessions, scope.tries, category, period), scope.merchant_id)


def benchmarks(scope: Scope, period: Range, terminal_id: int | None = None) -> Benchmark:
    """The benchmark of the scope's merchant, or why it is suppressed.  The few rows of its summary are computed once, and written."""
    if terminal_id is not None:
        return Benchmark(True, "terminal_filter", None, None)
    metrics = written(own_summary(scope, period), "benchmark-summary")
    found = suppression(metrics).first()
    return Benchmark(found.suppressed, found.reason, found.signal, None if found.suppressed else metrics)
