"""Readers: the market tables of this library from the stand-in star schema, with explicit columns and UTC timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.shipping import ship
from tidemark.operators.resample import ticks_to_bars


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(read(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    """events, a table or a stream, as ticks: (pair, ts, mid, ask_vol, spread_pips, seq)."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mid"),
        k.alias("ask_vol"), (k % 7 + 1).alias("spread_pips"), F.col("event_id").alias("seq"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir))


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as ticks: pair = priority, one price an order."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("pair"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("mid"),
        F.lit(1.0).alias("ask_vol"), (F.col("o_custkey") % 7 + 1).cast("double").alias("spread_pips"), F.col("o_orderkey").alias("seq"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(daily_ticks(spark, sf_dir), "day")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as monthly rates: (currency, date, rate_pct) = mean discount of a return flag's month, in percent."""
    return (
        read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("currency"), F.date_trunc("month", "l_shipdate").cast("timestamp").alias("date"))
        .agg((F.avg("l_discount") * 100).alias("rate_pct"))
    )
