"""Ticks to bars, bars to longer bars, spread curves and return grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W


def ticks_to_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """OHLC of mid, summed volume, exact median / mean / p90 of the spread by (pair, unit). First and last go by (ts, seq)."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("pair", F.date_trunc(unit, "ts").alias("ts")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"),
        F.coalesce(F.sum("ask_vol"), F.lit(0.0)).alias("volume"), F.percentile("spread_pips", 0.5).alias("spread_median_pips"),
        F.avg("spread_pips").alias("spread_mean_pips"), F.percentile("spread_pips", 0.9).alias("spread_p90_pips"),
    )


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Longer bars: first open, highest high, lowest low, last close, summed volume, nulls skipped. Buckets without any price go."""
    def by(pick, col):
        return pick(F.when(F.col(col).isNotNull(), F.col(col)), F.when(F.col(col).isNotNull(), F.col("ts")))

    out = bars.groupBy("pair", F.date_trunc(unit, "ts").alias("bucket")).agg(
        by(F.min_by, "open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), by(F.max_by, "close").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    )
    return out.where("coalesce(open, high, low, close) is not null").withColumnRenamed("bucket", "ts")


def spread_by_clock(bars: DataFrame) -> DataFrame:
    """Spread of each bar with its UTC hour and weekday (Monday 0)."""
    return bars.select("pair", "ts", "spread_median_pips", F.hour("ts").alias("hour"), F.weekday("ts").alias("day_of_week"))


def hour_curve(spreads: DataFrame, q: float = 0.5, drop_days: tuple[int, ...] = (5, 6)) -> DataFrame:
    """(pair, hour, spread): quantile by hour of day without the dropped weekdays; absent hours by circular linear interpolation."""
    seen = spreads.where(~F.weekday("ts").isin(*drop_days)).groupBy("pair", F.hour("ts").alias("hour")).agg(F.percentile("spread_pips", q).alias("q"))
    # three days of hours in a row; the middle one sees its neighbours on both sides
    grid = seen.select("pair").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(71)))).withColumn("hour", F.col("slot") % 24)
    tiled = grid.join(seen, ["pair", "hour"], "left").withColumn("known", F.when(F.col("q").isNotNull(), F.struct("slot", "q")))
    w = W.partitionBy("pair").orderBy("slot")
    tiled = tiled.withColumns({
        "b": F.last("known", True).over(w), "a": F.first("known", True).over(w.rowsBetween(0, W.unboundedFollowing)),
    }).where("slot between 24 and 47")
    gap = F.col("a.slot") - F.col("b.slot")
    line = F.col("b.q") + (F.col("a.q") - F.col("b.q")) * (F.col("slot") - F.col("b.slot")) / F.when(gap != 0, gap)
    return tiled.select("pair", "hour", F.coalesce("q", line).alias("spread"))


def monthly_returns(equity: DataFrame) -> DataFrame:
    """(pair, year, m1..m12): change of the month's last close on the month before's."""
    last = equity.groupBy("pair", F.date_trunc("month", "ts").alias("month")).agg(F.max_by("close", "ts").alias("close"))
    change = F.col("close") / F.lag("close").over(W.partitionBy("pair").orderBy("month")) - 1
    last = last.withColumns({"r": F.round(change, 9), "m": F.month("month")})
    grid = last.groupBy("pair", F.year("month").alias("year")).pivot("m", list(range(1, 13))).agg(F.first("r"))
    return grid.toDF("pair", "year", *[f"m{i}" for i in range(1, 13)])


def quarter_end(rates: DataFrame) -> DataFrame:
    """(currency, quarter, rate): the last rate of each quarter, quarters without one filled forward."""
    q = rates.groupBy("currency", F.date_trunc("quarter", "ts").alias("quarter")).agg(F.max_by("rate", "ts").alias("rate"))
    span = q.groupBy("currency").agg(F.min("quarter").alias("a"), F.max("quarter").alias("b"))
    all_q = span.select("currency", F.explode(F.sequence("a", "b", F.expr("interval 3 months"))).alias("quarter"))
    filled = F.last("rate", True).over(W.partitionBy("currency").orderBy("quarter"))
    return all_q.join(q, ["currency", "quarter"], "left").select("currency", "quarter", filled.alias("rate"))
