"""Staging rows to the star schema; natural keys carry stable surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surrogate(*keys: str) -> Column:
    """A deterministic id of a natural key, alike in every load."""
    return F.xxhash64(*keys)


def merchants(rows: DataFrame) -> DataFrame:
    return rows.select("merchant_key").distinct().select(surrogate("merchant_key").alias("merchant_id"), "merchant_key")


def categories(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category_id").agg(F.min("category_title").alias("category_title"))


def terminals(rows: DataFrame) -> DataFrame:
    return rows.select("merchant_key", "terminal_key").distinct().select(surrogate("merchant_key", "terminal_key").alias("terminal_id"), surrogate("merchant_key").alias("merchant_id"), "terminal_key")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (ties must be broken by ``order``)."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def sessions(rows: DataFrame) -> DataFrame:
    """One row per session: values of its first staging row."""
    first = first_per_key(rows, ["session_key"], ["source_row_number"])
    return first.select(
        surrogate("session_key").alias("session_id"), "session_key", surrogate("merchant_key").alias("merchant_id"), surrogate("merchant_key", "terminal_key").alias("terminal_id"), "category_id",
        F.col("amount").cast("long").alias("amount"), F.col("adjusted_fee").cast("long").alias("adjusted_fee"), "session_status", "verify_type",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("expire_in").cast("timestamp_ntz").alias("expires_at"),
    )


def tries(rows: DataFrame) -> DataFrame:
    """One row per attempt; the session's id follows from its key, so no join is needed."""
    return rows.select(
        surrogate("session_key").alias("session_id"), surrogate("merchant_key").alias("merchant_id"), F.col("try_seq").cast("smallint").alias("try_seq"), "try_status",
        "switch_response_code", "psp_code", "issuer_bank_code", "payer_card_key", F.col("init_time_ms").cast("int").alias("init_time_ms"), F.col("verify_time_ms").cast("int").alias("verify_time_ms"),
        *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("try_created_at", "verified_at", "settled_at")),
    )


def star_schema(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables of validated staging rows."""
    return {"merchants": merchants(rows), "merchant_categories": categories(rows), "terminals": terminals(rows), "payment_sessions": sessions(rows), "payment_tries": tries(rows)}
