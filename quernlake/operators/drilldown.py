"""Filtered, sorted and paged sessions, and the detail of one."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum
from functools import reduce
from operator import and_
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.operators.facts import attempt_stats
from quernlake.plans.scope import Range, Scope, ScopeError

#: Fixed values.
PAGE_SIZE, MAX_PAGE_SIZE = 25, 100


class Sort(StrEnum):
    CREATED_AT = "created_at"
    AMOUNT = "amount"
    SESSION_STATUS = "session_status"


class Direction(StrEnum):
    ASC = "asc"
    DESC = "desc"


@dataclass(frozen=True)
class Filters:
    status: str | None = None
    terminal_id: int | None = None
    psp: str | None = None
    attempt_status: str | None = None
    no_attempt: bool | None = None
    sort: Sort = Sort.CREATED_AT
    direction: Direction = Direction.DESC
    page: int = 1
    page_size: int = PAGE_SIZE

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.page_size <= MAX_PAGE_SIZE:
            raise ScopeError(f"pages count from 1 and hold 1 to {MAX_PAGE_SIZE} rows")


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def matching(scope: Scope, period: Range, filters: Filters) -> DataFrame:
    """All sessions that the filters let through, with attempt count, last provider and the no-attempt flag.

    no_attempt=True wants an attempt row 0 of status NoAttempt and takes that row alone; False wants a real attempt;
    unset flags any row 0.  Provider and attempt status are independent: different attempts may satisfy them.
    """
    conditions = [F.col("session_status") == filters.status] if filters.status else []
    rows = scope.in_range(period, filters.terminal_id).filter(_all(conditions))
    for column, value in (("psp_code", filters.psp), ("try_status", filters.attempt_status)):
        if value:
            rows = rows.join(scope.tries.filter(F.col(column) == value).select("session_id"), "session_id", "left_semi")
    base = ["session_key", "created_at", "terminal_id", "amount", "session_status"]
    if filters.no_attempt is True:
        zero = scope.tries.filter((F.col("try_seq") == 0) & (F.col("try_status") == "NoAttempt")).select("session_id")
        return rows.join(zero, "session_id").select(*base, F.lit(0).cast("long").alias("attempt_count"), F.lit(None).cast("string").alias("last_psp"), F.lit(True).alias("no_attempt"))
    rows = rows.join(attempt_stats(scope.tries, rows, last_psp=True), "session_id", "left")
    if filters.no_attempt is False:
        rows = rows.filter(F.col("max_try_seq") >= 1)
    return rows.select(*base, F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "last_psp", (F.coalesce("no_attempt", F.lit(0)) == 1).alias("no_attempt"))


def page(rows: DataFrame, filters: Filters) -> DataFrame:
    """One page in the chosen order, ties by session key."""
    column = F.col(filters.sort.value)
    order = column.asc_nulls_last() if filters.direction is Direction.ASC else column.desc_nulls_first()
    return rows.orderBy(order, "session_key").offset((filters.page - 1) * filters.page_size).limit(filters.page_size)


def transactions(scope: Scope, period: Range, filters: Filters, strict_total: bool = False) -> tuple[DataFrame, int]:
    """A page and the total; the total of a page past the end is 0, or the true one with ``strict_total``.

    The total counts sessions without their attempts, unless filters ask for these.
    """
    rows = matching(scope, period, filters)
    total = rows.select("session_key").count()
    past = (filters.page - 1) * filters.page_size >= total
    return page(rows, filters), 0 if past and not strict_total else total


def query_string(scope_query: str, extra: str) -> str:
    """The query string of a drill-down: the parameters of the scope, those in ``extra`` taking their place."""
    pairs = dict(parse_qsl(scope_query.removeprefix("?"), keep_blank_values=True))
    return urlencode({**pairs, **dict(parse_qsl(extra, keep_blank_values=True))})


def transaction(scope: Scope, session_key: str) -> DataFrame:
    """One row: the session, and its attempts in order.  Here no attempt means no row of try_seq 1 or more."""
    one = scope.own_sessions.filter(F.col("session_key") == session_key)
    if one.isEmpty():
        raise ScopeError("the session is not there")
    return details(one, scope.tries)


def details(sessions: DataFrame, tries: DataFrame) -> DataFrame:
    """Sessions with ``attempts`` (an ordered array), attempt count, last provider and the no-attempt flag."""
    columns = ["try_seq", *[c for c in tries.columns if c not in ("session_id", "merchant_id", "try_seq")]]
    attempts = tries.join(sessions.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("attempts"))
    real = F.filter("attempts", lambda a: a["try_seq"] >= 1)
    joined = sessions.join(attempts, "session_id", "left").withColumn("attempts", F.coalesce("attempts", F.array()))
    return joined.withColumn("attempt_count", F.size(real)).withColumn("last_psp", F.try_element_at(real, F.lit(-1))["psp_code"]).withColumn("no_attempt", F.size(real) == 0)
