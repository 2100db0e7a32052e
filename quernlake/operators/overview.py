"""Dashboard overview: measures of two periods, metrics, daily statuses, provider outcomes, latency and the insight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.functions.rates import no_attempt_signal, safe_rate
from quernlake.operators.facts import MEASURES, session_measures, with_stats
from quernlake.operators.ordered import percentiles, same
from quernlake.plans.scope import Range, Scope, scope_metadata
from quernlake.schemas import SESSION_STATUSES
from quernlake.sources.scratch import written

#: Limitations that metrics carry.
STATUS_LIMITATION = "Verified and Paid are combined until their business distinction is confirmed."
TIME_LIMITATION = "Timestamps have no zone; the declared zone is Asia/Tehran."


@dataclass(frozen=True)
class Overview:
    """All of a dashboard: what metrics, chart, providers, latency and insight show of one scope and range."""

    metrics: DataFrame
    daily: DataFrame
    providers: DataFrame
    latency: DataFrame
    insight: DataFrame
    scope: DataFrame


def overview(scope: Scope, period: Range, terminal_id: int | None = None, imports: DataFrame | None = None, terminal_key: str | None = None) -> Overview:
    """The whole overview from two passes: sessions to sums by day, which metrics, chart and insight share, and attempts by provider.

    Sums add up over days, so the written table has a row for each day and period at most.
    """
    statuses = [F.count_if(F.col("session_status") == s).alias(s.lower()) for s in SESSION_STATUSES]
    facts = with_stats(scope.in_both(period, terminal_id), scope.tries).groupBy("period", F.to_date("created_at").alias("day"))
    # a status may have the name of a measure
    days = written(facts.agg(F.struct(*session_measures()).alias("sums"), F.struct(*statuses).alias("statuses")), "overview-days")
    sums = days.groupBy("period").agg(*[F.sum(f"sums.{m}").alias(m) for m in MEASURES])
    both = _with_both_periods(sums)
    providers = written(performance(scope, period, terminal_id), "overview-providers")
    daily = days.filter(F.col("period") == "current").select("day", "statuses.*")
    return Overview(overview_metrics(both), daily, psp_outcomes(providers), latency(providers), insight(both), scope_metadata(scope.sessions, period, imports, terminal_key))


def _with_both_periods(rows: DataFrame) -> DataFrame:
    periods = rows.sparkSession.range(2).select(F.when(F.col("id") == 0, "current").otherwise("previous").alias("period"))
    return periods.join(rows, "period", "left").fillna(0, list(MEASURES))


def aggregates(scope: Scope, period: Range, terminal_id: int | None = None) -> DataFrame:
    """One row per period, ``current`` and ``previous``; a period without sessions is a row of zeros."""
    return _with_both_periods(with_stats(scope.in_both(period, terminal_id), scope.tries).groupBy("period").agg(*session_measures()))


def two_periods(rows: DataFrame) -> DataFrame:
    """aggregates() as one row: each measure as c_<name> and p_<name>."""
    pick = lambda name, period: F.max(F.when(F.col("period") == period, F.col(name))).alias(f"{period[0]}_{name}")
    return rows.agg(*[pick(m, p) for m in MEASURES for p in ("current", "previous")])


def overview_metrics(rows: DataFrame) -> DataFrame:
    """(metric_id, grain, value, previous, change, numerator, denominator, sample_size) of the seven metrics."""
    c, p = (lambda n: F.col(f"c_{n}")), (lambda n: F.col(f"p_{n}"))

    def entry(name: str, value: Column, previous: Column, sample: Column, numerator: Column | None = None, denominator: Column | None = None) -> Column:
        none = F.lit(None).cast("long")
        value, previous = value.cast("double"), previous.cast("double")
        return F.struct(
            F.lit(name).alias("metric_id"), F.lit("session").alias("grain"), value.alias("value"), previous.alias("previous"), (value - previous).alias("change"),
            (none if numerator is None else numerator).alias("numerator"), (none if denominator is None else denominator).alias("denominator"), sample.alias("sample_size"),
        )

    rate = lambda name, part, whole: entry(name, safe_rate(c(part), c(whole)), safe_rate(p(part), p(whole)), c(whole), c(part), c(whole))
    metrics = [
        entry("sessions.created", c("sessions"), p("sessions"), c("sessions")), entry("amount.requested", c("amount"), p("amount"), c("sessions")),
        rate("sessions.failed_rate", "failed", "sessions"), rate("sessions.verified_rate", "success", "sessions"), rate("sessions.no_attempt_rate", "no_attempt", "sessions"),
        rate("sessions.retry_rate", "retry", "attempted"), entry("fees.adjusted", c("fee"), p("fee"), c("sessions")),
    ]
    return two_periods(rows).select(F.inline(F.array(*metrics)))


def daily_status(scope: Scope, period: Range, terminal_id: int | None = None) -> DataFrame:
    """(day, one count per status); days without sessions have no row."""
    days = scope.in_range(period, terminal_id).groupBy(F.to_date("created_at").alias("day"))
    return days.pivot("session_status", list(SESSION_STATUSES)).count().fillna(0).select("day", *[F.col(s).alias(s.lower()) for s in SESSION_STATUSES])


def status_shares(daily: DataFrame) -> DataFrame:
    """Chart rows: the day's total, and each status' share of it."""
    names = [s.lower() for s in SESSION_STATUSES]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return daily.select("day", total.alias("total"), *[(F.col(n) / F.greatest(total, F.lit(1))).alias(f"{n}_share") for n in names])


def _attempts(scope: Scope, period: Range, terminal_id: int | None) -> DataFrame:
    """Real attempts of sessions created in either period, by the session's time."""
    own = scope.in_both(period, terminal_id).select("session_id", "period")
    return scope.tries.filter(F.col("try_seq") >= 1).join(own, "session_id")


def performance(scope: Scope, period: Range, terminal_id: int | None = None) -> DataFrame:
    """Outcomes and latency of attempts by (period, provider); a NULL provider is one."""
    outcome = [F.count_if(F.col("try_status") == s).alias(n) for s, n in (("Failed", "failed"), ("Verified", "verified"), ("Paid", "paid"), ("Reversed", "reversed"), ("InBank", "in_bank"))]
    keys, rows = ["period", "psp_code"], _attempts(scope, period, terminal_id)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("sample_size"), *outcome, F.count("init_time_ms").alias("with_latency"))
    return same(counts, percentiles(rows, keys, "init_time_ms", {"p50": 0.5, "p95": 0.95}), keys)


def psp_outcomes(rows: DataFrame) -> DataFrame:
    """Current outcomes of performance(), the largest provider first when ordered by sample size."""
    return rows.filter(F.col("period") == "current").select("psp_code", "sample_size", "failed", "verified", "paid", "reversed", "in_bank")


def latency(rows: DataFrame) -> DataFrame:
    """Current latency by provider beside the previous one; providers pair null-safely."""
    now = rows.filter(F.col("period") == "current").select("psp_code", "sample_size", (F.col("sample_size") - F.col("with_latency")).alias("missing"), "p50", "p95")
    before = rows.filter(F.col("period") == "previous").select(F.col("psp_code").alias("before_code"), F.col("p50").alias("previous_p50"), F.col("p95").alias("previous_p95"))
    return now.join(before, F.col("psp_code").eqNullSafe(F.col("before_code")), "left").drop("before_code")


def failure_contribution(rows: DataFrame) -> DataFrame:
    """(no_attempt, attempted, total_failed) of the current period."""
    one = rows.filter(F.col("period") == "current")
    return one.select(F.col("failed_no_attempt").alias("no_attempt"), F.greatest(F.lit(0).cast("long"), F.col("failed") - F.col("failed_no_attempt")).alias("attempted"), F.col("failed").alias("total_failed"))


def insight(rows: DataFrame) -> DataFrame:
    """The no-attempt signal of two periods with its evidence."""
    one = two_periods(rows).withColumn("s", no_attempt_signal(F.col("c_no_attempt"), F.col("c_sessions"), F.col("p_no_attempt"), F.col("p_sessions")))
    return one.select(
        F.when(F.col("s.alert"), "no_attempt_increase").otherwise("no_attempt_summary").alias("kind"), F.when(F.col("s.alert"), "warning").otherwise("neutral").alias("severity"),
        F.col("s.rate").alias("current_rate"), F.col("s.previous_rate").alias("previous_rate"), F.col("s.change_pp").alias("change_pp"), F.col("s.excess").alias("excess_sessions"),
        F.col("c_failed_no_attempt_amount").alias("affected_amount"), F.lit("no_attempt=true&status=Failed").alias("drilldown_query"),
    )


def extra_metrics(scope: Scope, period: Range) -> DataFrame:
    """Documented metrics of attempts: processed attempts, settled rate, failures by code are counted beside this by failures_by_code()."""
    own = scope.in_range(period).select("session_id")
    attempts = scope.tries.filter(F.col("try_seq") >= 1).join(own, "session_id")
    settled = attempts.filter(F.col("settled_at").isNotNull()).select("session_id").distinct().withColumn("settled", F.lit(1))
    return own.join(settled, "session_id", "left").agg(F.count("*").alias("sessions"), F.count("settled").alias("settled"), safe_rate(F.count("settled"), F.count("*")).alias("settled_rate"))


def failures_by_code(scope: Scope, period: Range, code: str = "switch_response_code") -> DataFrame:
    """Failed attempts by response code; a missing code is its own group."""
    own = scope.in_range(period).select("session_id")
    failed = scope.tries.filter((F.col("try_seq") >= 1) & (F.col("try_status") == "Failed")).join(own, "session_id")
    return failed.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("attempts"), F.count_distinct("session_id").alias("sessions"))
