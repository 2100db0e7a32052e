"""Data-quality rules over staging rows; each reports the first offending row and never a value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.schemas import SESSION_STATUSES, TRY_STATUSES

ROW = "source_row_number"
#: What must not be blank, what must be whole numbers of which width, what must be times.
REQUIRED = ("session_key", "try_seq", "terminal_key", "merchant_key", "category_id", "category_title", "amount", "adjusted_fee", "session_status", "try_status", "verify_type", "created_at", "expire_in")
INTEGERS = {"try_seq": "smallint", "amount": "bigint", "adjusted_fee": "bigint", "init_time_ms": "int", "verify_time_ms": "int"}
TIMES = {"created_at": True, "expire_in": True, "try_created_at": False, "verified_at": False, "settled_at": False}
VERIFY_TYPES = ("Automated", "Manual")
SESSION_LEVEL = ("terminal_key", "merchant_key", "category_id", "category_title", "amount", "adjusted_fee", "session_status", "verify_type", "created_at", "expire_in")


class QualityError(ValueError):
    """A staging row breaks a rule; the message has the CSV row (the header is row 1) and the reason."""


@dataclass(frozen=True)
class RowRule:
    name: str
    reason: str
    broken: Column


def blank(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit("")).isNull()


def bad_integer(column: str, kind: str, required: bool) -> Column:
    value = F.expr(f"try_cast(`{column}` AS {kind})")
    return (F.col(column).isNotNull() if not required else F.lit(True)) & (value.isNull() | (value < 0))


def bad_time(column: str, required: bool) -> Column:
    value = F.expr(f"try_cast(`{column}` AS timestamp_ntz)")
    return value.isNull() if required else F.col(column).isNotNull() & value.isNull()


def row_rules() -> list[RowRule]:
    """The rules that a row breaks by itself, in order."""
    ints = reduce(or_, [bad_integer(c, kind, c in REQUIRED) for c, kind in INTEGERS.items()])
    times = reduce(or_, [bad_time(c, need) for c, need in TIMES.items()])
    return [
        RowRule("required", "a required value is blank", reduce(or_, map(blank, REQUIRED))),
        RowRule("integers", "a whole number is invalid, out of range or negative", ints),
        RowRule("times", "a timestamp is invalid", times),
        RowRule("session_status", "the session status is unknown", ~F.col("session_status").isin(*SESSION_STATUSES)),
        RowRule("try_status", "the attempt status is unknown", ~F.col("try_status").isin(*TRY_STATUSES)),
        RowRule("verify_type", "the verify type is unknown", ~F.col("verify_type").isin(*VERIFY_TYPES)),
    ]


def first_violations(rows: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """(rule, first_row, broken_rows) of each row-level rule, from one pass over the rows."""
    wide = rows.agg(*[F.min(F.when(r.broken, F.col(ROW))).alias(f"{r.name}_first") for r in rules], *[F.count_if(r.broken).alias(f"{r.name}_n") for r in rules])
    entries = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"{r.name}_first").cast("long").alias("first_row"), F.col(f"{r.name}_n").alias("broken_rows")) for r in rules])
    return wide.select(F.inline(entries))


def duplicate_attempts(rows: DataFrame) -> DataFrame:
    """(session_key, try_seq, first_row, n) of attempts that stand more than once."""
    seq = F.expr("try_cast(try_seq AS smallint)")
    return rows.groupBy("session_key", seq.alias("try_seq")).agg(F.min(ROW).alias("first_row"), F.count("*").alias("n")).filter("n > 1")


def varying_sessions(rows: DataFrame, columns: Sequence[str] = SESSION_LEVEL) -> DataFrame:
    """(session_key, first_row) of sessions whose session-level values vary between attempts; NULLs count as values."""
    kinds = F.count_distinct(F.struct(*columns))
    return rows.groupBy("session_key").agg(F.min(ROW).alias("first_row"), kinds.alias("kinds")).filter("kinds > 1").drop("kinds")


def varying_titles(rows: DataFrame) -> DataFrame:
    """(category_id, first_row) of categories with more than one title."""
    return rows.groupBy("category_id").agg(F.min(ROW).alias("first_row"), F.count_distinct("category_title").alias("kinds")).filter("kinds > 1").drop("kinds")


def validate(rows: DataFrame) -> DataFrame:
    """The rows, if they keep all rules; else QualityError for the first broken rule in order."""
    rules = row_rules()
    found = {r["rule"]: r["first_row"] for r in first_violations(rows, rules).collect()}
    for rule in rules:
        if found[rule.name] is not None:
            raise QualityError(f"CSV row {found[rule.name] + 1}: {rule.reason}")
    for broken, reason in ((duplicate_attempts(rows), "the attempt is a duplicate"), (varying_sessions(rows), "session values vary between attempts"), (varying_titles(rows), "the category has several titles")):
        first = broken.agg(F.min("first_row")).first()[0]
        if first is not None:
            raise QualityError(f"CSV row {first + 1}: {reason}")
    return rows


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``child`` whose key is missing in ``parent``: a broken foreign key."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once: a broken unique constraint."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
