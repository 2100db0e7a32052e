"""Merchant catalog: counts, search, sorting and paging."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
PAGE_SIZE, SMALLEST_PAGE, LARGEST_PAGE = 20, 10, 100


class CatalogSort(StrEnum):
    MERCHANT_KEY = "merchant_key"
    SESSION_COUNT = "session_count"
    ATTEMPT_COUNT = "attempt_count"
    TERMINAL_COUNT = "terminal_count"
    LAST_ACTIVITY = "last_activity"


def contains(column: str, search: str | None) -> Column:
    """Case-blind substring search; wildcard characters stand for themselves, a blank search finds all."""
    wanted = (search or "").strip()
    return F.lower(F.col(column)).contains(wanted.lower()) if wanted else F.lit(True)


def merchant_catalog(merchants: DataFrame, sessions: DataFrame, tries: DataFrame, search: str | None = None, category_id: str | None = None) -> DataFrame:
    """Each merchant with its counts of sessions, real attempts and terminals, and first and last activity.

    Each count is aggregated to merchants before it joins.
    """
    rows = merchants.filter(contains("merchant_key", search))
    if category_id:
        rows = rows.join(sessions.filter(F.col("category_id") == category_id).select("merchant_id"), "merchant_id", "left_semi")
    by_session = sessions.groupBy("merchant_id").agg(F.count("*").alias("session_count"), F.min("created_at").alias("first_activity"), F.max("created_at").alias("last_activity"), F.count_distinct("terminal_id").alias("terminal_count"))
    attempts = tries.filter(F.col("try_seq") >= 1).groupBy("session_id").agg(F.count("*").alias("n"))
    by_attempt = attempts.join(sessions.select("session_id", "merchant_id"), "session_id").groupBy("merchant_id").agg(F.sum("n").alias("attempt_count"))
    return rows.join(by_session, "merchant_id", "left").join(by_attempt, "merchant_id", "left").fillna(0, ["session_count", "terminal_count", "attempt_count"])


def catalog_page(rows: DataFrame, sort: CatalogSort = CatalogSort.MERCHANT_KEY, descending: bool = False, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page; missing values stand last in both directions, ties go by merchant key."""
    if page < 1 or not SMALLEST_PAGE <= page_size <= LARGEST_PAGE:
        raise ValueError(f"pages count from 1 and hold {SMALLEST_PAGE} to {LARGEST_PAGE} rows")
    column = F.col(sort.value)
    return rows.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), "merchant_key").offset((page - 1) * page_size).limit(page_size)


def merchant_categories(sessions: DataFrame, categories: DataFrame) -> DataFrame:
    """(merchant_id, categories): the sorted (id, title) pairs of each merchant."""
    pairs = sessions.select("merchant_id", "category_id").distinct().join(categories, "category_id")
    return pairs.groupBy("merchant_id").agg(F.array_sort(F.collect_set(F.struct("category_id", "category_title"))).alias("categories"))


def with_labels(rows: DataFrame, labels: dict[str, str], column: str = "category_id") -> DataFrame:
    """Adds ``label``: the text for a category id, or the id itself."""
    if not labels:
        return rows.withColumn("label", F.col(column))
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.withColumn("label", F.coalesce(F.try_element_at(known, F.col(column)), F.col(column)))
