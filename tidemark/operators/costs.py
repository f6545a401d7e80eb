"""Costs in pips and position sizes, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Units of a trade from (equity, price, atr, signal) at its entry; the signal is the raw one that opens it.
Sizer = Callable[[Column, Column, Column, Column], Column]


def entry_cost(spread: Column, slippage: float) -> Column:
    return spread / 2 + slippage


def exit_cost(spread: Column, slippage: float, commission: float = 0.0) -> Column:
    return spread / 2 + slippage + commission


def holding_cost(direction: Column, days: Column, swap_long: float, swap_short: float) -> Column:
    """Swap is earned when positive, so the cost is its negative."""
    return F.when(direction > 0, -swap_long * days).when(direction < 0, -swap_short * days).otherwise(0.0)


def hour_curve_cost(bars: DataFrame, curve: DataFrame, fallback: float) -> DataFrame:
    """Bars with `curve_spread` of (pair, hour) from a spread curve of at most 24 rows a series, else the fallback."""
    rows = bars.withColumn("hour", F.hour("ts")).join(curve.select("pair", "hour", F.col("spread").alias("s")), ["pair", "hour"], "left")
    return rows.withColumn("curve_spread", F.coalesce("s", F.lit(fallback))).drop("s", "hour")


def static_round_trip(leg: float = 3.75) -> Column:
    return F.lit(2 * leg)


def stressed(rows: DataFrame, cost: str, multipliers: list[float]) -> DataFrame:
    """Each row once for each multiplier, its cost scaled."""
    return rows.withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers)))).withColumn(cost, F.col(cost) * F.col("multiplier"))


def atr_size(equity: Column, atr: Column, close: Column, risk: float = 0.01, fallback: float = 0.02) -> Column:
    """Equity at risk over the ATR; without one, over a price move of `fallback`."""
    return equity * risk / F.when(atr > 0, atr).otherwise(close * fallback)


def continuous_size(signal: Column, confidence: float, ratchet: float, most: float, least: float) -> Column:
    units = F.least(F.abs(signal) * confidence * ratchet * most, F.lit(most))
    return F.when(units >= least, units).otherwise(0.0)


def vol_target_size(signal: Column, equity: float, cap: float, most: float, least: float) -> Column:
    units = F.least(F.least(F.abs(signal), F.lit(1.0)) * cap * equity, F.lit(most))
    return F.when(units >= least, units).otherwise(0.0)


def quote_units(pair: Column, nominal: Column, price: Column, suffix: str = "JPY") -> Column:
    """Units of a nominal in account currency: pairs quoted in `suffix` have it as base, others divide by price."""
    return F.when(pair.endswith(suffix), nominal).otherwise(nominal / price)


def atr_sizer(risk: float = 0.01, mult: float = 2.0, fallback: float = 0.02) -> Sizer:
    """Equity at risk over the stop distance of `mult` ATRs; without an ATR, over a price move of `fallback`."""
    return lambda equity, price, atr, signal: F.when(atr > 0, equity * risk / (atr * mult)).when(price > 0, equity * risk / (price * fallback)).otherwise(0.0)


def fraction_sizer(risk: float = 0.01, mult: float = 2.0, cap: float = 0.1) -> Sizer:
    """Equity at risk times |signal| over the stop distance, at most `cap` of the equity as notional; 0 without an ATR."""
    def size(equity: Column, price: Column, atr: Column, signal: Column) -> Column:
        units = F.least(equity * risk * F.abs(signal) / F.nullif(atr * mult, F.lit(0.0)), equity * cap / price)
        return F.when((atr > 0) & (price > 0) & (equity > 0), units).otherwise(0.0)

    return size


def continuous_sizer(risk: float = 0.01, mult: float = 2.0, confidence: float = 1.0, ratchet: float = 1.0, most: float = 500_000.0, least: float = 1000.0) -> Sizer:
    """Equity at risk over the stop distance, scaled by |signal|, confidence and ratchet; at most `most` units, none under `least`."""
    def size(equity: Column, price: Column, atr: Column, signal: Column) -> Column:
        units = F.least(equity * risk / F.nullif(atr * mult, F.lit(0.0)) * F.abs(signal) * (confidence * ratchet), F.lit(most))
        return F.when((F.abs(signal) >= 1e-9) & (atr > 0) & (price > 0) & (equity > 0) & (units >= least), units).otherwise(0.0)

    return size


def target_sizer(leverage: float = 2.0, confidence: float = 1.0, ratchet: float = 1.0, most: float = 10_000_000.0, least: float = 1000.0) -> Sizer:
    """Equity times `leverage` times a signal of 1 at most, scaled and bounded as in continuous_sizer(); no short sizes."""
    def size(equity: Column, price: Column, atr: Column, signal: Column) -> Column:
        units = F.least(F.least(signal, F.lit(1.0)) * leverage * equity * (confidence * ratchet), F.lit(most))
        return F.when((signal > 0) & (price > 0) & (equity > 0) & (units >= least), units).otherwise(0.0)

    return size
