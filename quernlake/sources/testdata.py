"""The payment and corpus models on top of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GOODS = ("AUTOMOBILE", "BUILDING", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment session per order."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Verified").otherwise("Paid")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderkey").cast("string").alias("session_key"), F.col("c_nationkey").cast("long").alias("merchant_id"),
        (F.col("c_custkey") % 3).alias("terminal_id"), F.when(F.col("c_mktsegment").isin(*GOODS), "goods").otherwise("services").alias("category_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), F.floor("o_totalprice").cast("long").alias("adjusted_fee"),
        status.alias("session_status"), F.col("o_orderdate").alias("created_at"),
    )


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per (order, line number): the first in part, supplier and price order."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    seq = F.col("l_linenumber") - 1
    status = F.when(seq == 0, "NoAttempt").when(F.col("l_returnflag") == "A", "Failed").when(F.col("l_returnflag") == "N", "Verified").otherwise("Paid")
    return lines.select(
        F.col("l_orderkey").alias("session_id"), seq.cast("int").alias("try_seq"), status.alias("try_status"),
        F.when(seq > 0, F.concat(F.lit("PSP-0"), (F.col("l_suppkey") % 8 + 1).cast("string"))).alias("psp_code"),
        F.when((seq > 0) & (F.col("l_discount") != 0), (F.col("l_quantity") * 100).cast("int")).alias("init_time_ms"),
        F.col("l_shipdate").alias("settled_at"),
    )


#: The same two relations in DuckDB SQL.
SESSIONS_SQL = """
sessions AS (
  SELECT o_orderkey AS session_id, CAST(o_orderkey AS VARCHAR) AS session_key, CAST(c_nationkey AS BIGINT) AS merchant_id, c_custkey % 3 AS terminal_id,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'goods' ELSE 'services' END AS category_id,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CAST(floor(o_totalprice) AS BIGINT) AS adjusted_fee,
         CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Verified' ELSE 'Paid' END AS session_status, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
TRIES_SQL = """
tries AS (
  SELECT l_orderkey AS session_id, CAST(l_linenumber - 1 AS INTEGER) AS try_seq,
         CASE WHEN l_linenumber = 1 THEN 'NoAttempt' WHEN l_returnflag = 'A' THEN 'Failed' WHEN l_returnflag = 'N' THEN 'Verified' ELSE 'Paid' END AS try_status,
         CASE WHEN l_linenumber > 1 THEN 'PSP-0' || CAST(l_suppkey % 8 + 1 AS VARCHAR) END AS psp_code,
         CASE WHEN l_linenumber > 1 AND l_discount <> 0 THEN CAST(l_quantity * 100 AS INTEGER) END AS init_time_ms, l_shipdate AS settled_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1
)"""
