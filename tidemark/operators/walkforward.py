"""Walk-forward windows whose indicators warm up before each test part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, Window as W

from tidemark.operators import metrics, simulate
from tidemark.operators.indicators import by_ts


def warmed(bars: DataFrame, train: int, test: int, step: int, warm: int | None = None) -> DataFrame:
    """Bars once for each window that uses them, as series `pair#window` with `window` and `is_test`: the `test` bars from train + window * step
    on, and the `warm` bars before them (by default train, 250 at least; fewer where the series starts). Only whole windows count."""
    warm = max(train, 250) if warm is None else warm
    rows = bars.withColumns({"i": F.row_number().over(by_ts()) - 1, "size": F.count("*").over(W.partitionBy("pair"))})
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (train + test - 1)) / step))
    last = F.least(F.floor((F.col("i") - train + warm) / step), F.floor((F.col("size") - train - test) / step))
    rows = rows.where((first <= last) & (F.col("size") >= train + test)).withColumn("window", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("is_test", F.col("i") >= F.col("window") * step + train)
    return rows.withColumn("pair", F.concat_ws("#", "pair", F.col("window").cast("string"))).drop("i", "size")


def run(bars: DataFrame, signal: Callable[[DataFrame], DataFrame], train: int, test: int, step: int, warm: int | None = None, **costs_and_sizer) -> DataFrame:
    """(pair, window, test_start, test_end, bars, sharpe, max_drawdown, trades) of each window. signal: adds signal and atr to series of bars; it
    sees the bars that warm up and those of the test, and starts anew in each window. Trades are made in the test part alone."""
    rows = signal(warmed(bars, train, test, step, warm)).where("is_test")
    trades = simulate.priced_trades(rows, **costs_and_sizer)
    equity = simulate.discrete_equity(rows, trades, costs_and_sizer.get("pip", 0.0001), costs_and_sizer.get("capital", 10_000.0))
    returns = equity.withColumn("ret", F.round(F.col("equity") / F.lag("equity").over(by_ts()) - 1, 12))
    s = returns.groupBy("pair").agg(F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.count("*").alias("bars"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    out = s.join(metrics.max_drawdown(equity), "pair").join(trades.groupBy("pair").agg(F.count("*").alias("trades")), "pair", "left")
    part = lambda k: F.element_at(F.split("pair", "#"), k)
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * 252**0.5).otherwise(0.0)
    return out.select(part(-2).alias("pair"), part(-1).cast("int").alias("window"), "test_start", "test_end", "bars", sharpe.alias("sharpe"), "max_drawdown", F.coalesce("trades", F.lit(0)).alias("trades"))


def verdict(windows: DataFrame) -> DataFrame:
    """(pair, windows, avg_sharpe, avg_max_drawdown, trades, consistent): means over the windows; consistent where most have a Sharpe over 0."""
    positive = F.count_if(F.col("sharpe") > 0)
    return windows.groupBy("pair").agg(
        F.count("*").alias("windows"), F.avg("sharpe").alias("avg_sharpe"), F.avg("max_drawdown").alias("avg_max_drawdown"), F.sum("trades").alias("trades"), (positive > F.count("*") / 2).alias("consistent")
    )
