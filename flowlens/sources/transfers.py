"""Transfers (tx_id, src, dst, amount, t, fmt, label) from the stored star-schema tables.

``t`` counts whole seconds since the epoch: transfers within one second are
simultaneous, so neither is in the other's past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a time without zone."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers between users of the events table; accounts share one space."""
    events = read(spark, sf_dir, "events")
    users = events.agg(F.count_distinct("user_id").alias("n"))  # one row
    return events.crossJoin(F.broadcast(users)).select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id").alias("src"),
        F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.col("n")).alias("dst"),
        F.col("value").alias("amount"),
        seconds(F.col("ts")).alias("t"),
        F.col("event_type").alias("fmt"),
        (F.get_json_object("props", "$.k").cast("long") % 20 == 0).cast("int").alias("label"),
    )


#: The same in SQL, as common table expressions.
EVENT_TX = """
users AS (SELECT count(DISTINCT user_id) AS n FROM events),
tx AS (
  SELECT event_id AS tx_id, user_id AS src, (user_id * 7 + event_id) % n AS dst, value AS amount,
         epoch_us(ts) // 1000000 AS t, event_type AS fmt,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 = 0 THEN 1 ELSE 0 END AS label
  FROM events, users
)"""


def order_transfers(spark: SparkSession, sf_dir: str, accounts: int = 100) -> DataFrame:
    """Transfers from customers to suppliers, folded into ``accounts`` shared accounts; a day is one time."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    # An order may repeat a line number.
    twins = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
    items = items.withColumn("k", F.row_number().over(twins))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("k")).alias("tx_id"),
        (F.col("o_custkey") % accounts + 1).alias("src"),
        (F.col("l_suppkey") % accounts + 1).alias("dst"),
        F.col("l_extendedprice").alias("amount"),
        seconds(F.col("l_shipdate")).alias("t"),
        F.col("l_returnflag").alias("fmt"),
        (F.col("l_linenumber") == 7).cast("int").alias("label"),
    )


ORDER_TX = """
tx AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100
           + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice, l_shipdate) AS tx_id, 
         o_custkey % 100 + 1 AS src, l_suppkey % 100 + 1 AS dst,
         l_extendedprice AS amount, epoch_us(l_shipdate) // 1000000 AS t, l_returnflag AS fmt,
         CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
