"""Tenant scope and half-open time ranges of every metric query."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
DEFAULT_DAYS, MAX_DAYS = 30, 366
TIMEZONE = "Asia/Tehran"
INTERVAL = "[start, end)"


class ScopeError(ValueError):
    """The requested range or object is not available."""


@dataclass(frozen=True)
class Range:
    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ScopeError("start must be before end")
        if self.end - self.start > timedelta(days=MAX_DAYS):
            raise ScopeError(f"a range covers {MAX_DAYS} days at most")

    @property
    def previous_start(self) -> datetime:
        return self.start - (self.end - self.start)

    def _at(self, moment: datetime) -> Column:
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")

    def holds(self, column: str) -> Column:
        return (F.col(column) >= self._at(self.start)) & (F.col(column) < self._at(self.end))

    def holds_both(self, column: str) -> Column:
        """The range or the equal one before it."""
        return (F.col(column) >= self._at(self.previous_start)) & (F.col(column) < self._at(self.end))

    def period(self, column: str) -> Column:
        return F.when(F.col(column) >= self._at(self.start), "current").otherwise("previous")


def default_range(sessions: DataFrame) -> DataFrame:
    """One row (since, until): the dates of the range when neither end is given; nulls without sessions."""
    until = F.date_add(F.max(F.to_date("created_at")), 1)
    return sessions.agg(F.date_sub(until, DEFAULT_DAYS).alias("since"), until.alias("until"))


def resolve_range(sessions: DataFrame, start: date | None, end: date | None) -> Range:
    """The range of two dates (the end exclusive); open ends follow the latest session, by default 30 days."""
    if end is None:
        end = default_range(sessions).first()["until"]
        if end is None:
            raise ScopeError("there are no sessions")
    if start is None:
        start = end - timedelta(days=DEFAULT_DAYS)
    return Range(datetime.combine(start, time.min), datetime.combine(end, time.min))


@dataclass(frozen=True)
class Scope:
    """Sessions and attempts of one merchant: the tenant filter stands before anything else."""

    sessions: DataFrame
    tries: DataFrame
    merchant_id: int

    @classmethod
    def for_merchant(cls, merchants: DataFrame, sessions: DataFrame, tries: DataFrame, merchant_key: str | None) -> Scope:
        """The scope of the merchant with that key; without one, or for a key that is not there, it fails."""
        found = merchants.filter(F.col("merchant_key") == merchant_key).select("merchant_id").first() if merchant_key else None
        if found is None:
            raise ScopeError("no merchant is selected" if not merchant_key else "the selected merchant is not available")
        return cls(sessions, tries, found["merchant_id"])

    @property
    def own_sessions(self) -> DataFrame:
        return self.sessions.filter(F.col("merchant_id") == self.merchant_id)

    def in_range(self, period: Range, terminal_id: int | None = None) -> DataFrame:
        rows = self.own_sessions.filter(period.holds("created_at"))
        return rows if terminal_id is None else rows.filter(F.col("terminal_id") == terminal_id)

    def in_both(self, period: Range, terminal_id: int | None = None) -> DataFrame:
        """Sessions of the range and the one before, with their ``period``."""
        rows = self.own_sessions.filter(period.holds_both("created_at")).withColumn("period", period.period("created_at"))
        return rows if terminal_id is None else rows.filter(F.col("terminal_id") == terminal_id)


def scope_metadata(sessions: DataFrame, period: Range, imports: DataFrame | None = None, terminal_key: str | None = None) -> DataFrame:
    """One row: the range and the one before as dates, how it is to be read, the terminal, and how fresh the data are."""
    day = lambda moment: F.lit(moment.date())
    row = sessions.agg(F.max("created_at").alias("latest_data_at")).select(
        day(period.start).alias("start"), day(period.end).alias("end"), day(period.previous_start).alias("previous_start"), day(period.start).alias("previous_end"),
        F.lit(TIMEZONE).alias("timezone"), F.lit(INTERVAL).alias("interval"), F.lit(terminal_key).cast("string").alias("terminal_key"), "latest_data_at",
    )
    fresh = sessions.sparkSession.range(1).select(F.lit(None).cast("timestamp").alias("refreshed_at")) if imports is None else imports.agg(F.max("imported_at").alias("refreshed_at"))
    return row.withColumn("one", F.lit(1)).join(fresh.withColumn("one", F.lit(1)), "one").drop("one")
