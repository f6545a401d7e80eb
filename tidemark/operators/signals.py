"""Positions in [-1, 1] from bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import chunks
from tidemark.operators.indicators import by_ts, log_return, momentum, sma


def sign(x: Column) -> Column:
    """+1, -1 or 0; null gives 0."""
    return F.coalesce(F.signum(x), F.lit(0.0))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x held to [low, high]; null stays null, as greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sma_cross(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    return bars.withColumn("signal", sign(sma("close", fast) - sma("close", slow)))


def momentum_signal(bars: DataFrame, n: int = 20, threshold: float = 0.0) -> DataFrame:
    m = momentum("close", n)
    return bars.withColumn("signal", F.when(m > threshold, 1.0).when(m < -threshold, -1.0).otherwise(0.0))


def band_reversal(bars: DataFrame, n: int = 20, k: float = 2.0, rsi_n: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> DataFrame:
    """Buys below the lower band where the RSI is oversold too, sells above the upper where it is overbought; a position is held until the
    opposite signal."""
    from tidemark.operators.indicators import bollinger, rsi

    rows, strength = bollinger(rsi(bars, rsi_n), n, k), F.round("rsi", 6)
    hit = F.when((F.col("close") < F.col("bb_lower")) & (strength < oversold), 1.0).when((F.col("close") > F.col("bb_upper")) & (strength > overbought), -1.0)
    return rows.withColumn("hit", hit).withColumn("signal", F.coalesce(F.last("hit", True).over(by_ts()), F.lit(0.0))).drop("hit")


def carry(bars: DataFrame, diff: str, most: float, least: float) -> DataFrame:
    """Rate differential over `most`, held to [-1, 1], 0 below `least`."""
    d = F.col(diff)
    return bars.withColumn("signal", F.when(F.abs(d) >= least, clip(d / most)).otherwise(0.0))


def static_carry(bars: DataFrame, swap_long: str, swap_short: str) -> DataFrame:
    """+1 where holding long earns swap, else -1 where holding short does, else 0."""
    return bars.withColumn("signal", F.when(F.col(swap_long) > 0, 1.0).when(F.col(swap_short) > 0, -1.0).otherwise(0.0))


def cross_sectional(rows: DataFrame, x: str, least: float = 0.0, raw: float | None = None) -> DataFrame:
    """z-score of x against all series at the same time, held to [-1, 1], 0 where |x| is below `least`; an aggregate joined back, as a
    universe may be wide. raw: instead of the z-score, x over `raw`."""
    if raw is not None:
        value = F.when(F.abs(x) >= least, clip(F.col(x) / raw))
        return rows.withColumn("signal", F.coalesce(value, F.lit(0.0)))
    stats = rows.groupBy("ts").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    z = F.when(F.col("std") > 0, (F.col(x) - F.col("mean")) / F.col("std"))
    z = F.when(F.abs(x) >= least, clip(z))
    return rows.join(stats, "ts").withColumn("signal", F.coalesce(z, F.lit(0.0))).drop("mean", "std")


def lookback_signs(bars: DataFrame, lookbacks: tuple[int, ...] = (12, 24, 48, 96)) -> DataFrame:
    """(pair, ts, lookback, signal): sign of the summed log return over each lookback."""
    rows = bars.withColumn("lr", log_return())
    sums = [F.struct(F.lit(n).alias("lookback"), sign(F.round(sma("lr", n), 12)).alias("signal")) for n in lookbacks]
    return rows.withColumn("s", F.array(*sums)).select("pair", "ts", F.inline("s"))


def random_signals(bars: DataFrame, draw: int, change: float = 0.2, seed: int = 1) -> DataFrame:
    """-1, 0 or +1 drawn anew with probability `change` at each bar and held between; from md5, so any engine repeats it."""
    def u(tag: str) -> Column:
        key = F.concat_ws("|", F.lit(f"{seed}|{draw}|{tag}"), F.col("pair"), F.unix_timestamp("ts").cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    fresh = F.when(u("c") < change, F.floor(u("v") * 3) - 1)
    return bars.withColumn("fresh", fresh).withColumn("signal", F.coalesce(F.last("fresh", True).over(by_ts()), F.lit(0)).cast("double")).drop("fresh")


def session_filter(rows: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Zeroes the signal outside all [start, end) windows of UTC hours; a window may pass midnight."""
    hour, inside = F.hour("ts"), F.lit(False)
    for a, b in windows:
        inside = inside | ((hour >= a) & (hour < b) if a <= b else (hour >= a) | (hour < b))
    return rows.withColumn("signal", F.when(inside, F.col("signal")).otherwise(0.0))


def ema_cross(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    from tidemark.operators.indicators import ema_columns

    both = ema_columns(bars, {"f": ("close", 2 / (fast + 1), fast), "s": ("close", 2 / (slow + 1), slow)})
    gap = F.round(F.nanvl("f", F.lit(None)) - F.nanvl("s", F.lit(None)), 6)
    return both.withColumn("signal", sign(gap)).drop("f", "s")


def macd_cross(bars: DataFrame) -> DataFrame:
    from tidemark.operators.indicators import macd

    return macd(bars).withColumn("signal", sign(F.round(F.nanvl("macd_hist", F.lit(None)), 6)))


def carry_momentum(rows: DataFrame, carry_signal: str, n: int = 20, weight: float = 0.5, scale: float = 0.02) -> DataFrame:
    """Blend of carry and distance from the mean, 0 unless both point the same way."""
    away = clip((F.col("close") / sma("close", n) - 1) / scale)
    agree = F.signum(F.col(carry_signal)) == F.signum(away)
    return rows.withColumn("signal", F.when(agree, F.col(carry_signal) * weight + away * (1 - weight)).otherwise(0.0))


def vol_target(
    rows: DataFrame, target: float, cap: float = 2.0, n: int = 20, bars_per_year: float = 252.0, carry_diff: str | None = None, scaled: bool = True, lag: int = 0
) -> DataFrame:
    """Target over realised volatility, between 0 and cap, over cap; 0 while the volatility is unknown. carry_diff: 0 unless that column is
    over 0. scaled=False: a constant 1 in place of the size. lag: the volatility of so many bars before."""
    from tidemark.operators.indicators import realised_volatility

    rows = realised_volatility(rows, n, bars_per_year)
    vol = F.lag("vol", lag).over(by_ts()) if lag else F.col("vol")
    size = clip(target / vol, 0.0, cap) / cap if scaled else F.lit(1.0)
    on = (vol > 0) if carry_diff is None else (vol > 0) & (F.col(carry_diff) > 0)
    return rows.withColumn("signal", F.when(on, size).otherwise(0.0))


def overnight_fade(bars: DataFrame, hours: tuple[int, ...] = (2, 3, 4, 5), k: float = 2.0, n: int = 20) -> DataFrame:
    """Against moves of over k sigma of the same hours, none before a gap."""
    from tidemark.operators.indicators import hour_class_sigma, hours_to_next

    rows = hours_to_next(hour_class_sigma(bars, hours, n))
    big = ~F.col("pre_gap") & (F.abs("r") > F.col("sigma") * k)
    return rows.withColumn("signal", F.when(big, -F.signum("r")).otherwise(0.0))


FAMILIES = ["hourly_reversal", "session_open_momentum", "momentum_3", "vol_breakout", "london_drift", "spread_filtered_reversal"]


def intraday_families(bars: DataFrame, n: int = 24) -> DataFrame:
    """(pair, ts, close, spread_median_pips, family, signal) of six intraday rules:

    hourly_reversal: against the bar's own move, the last one where it is 0; session_open_momentum: the move of the 07:00 bar, there only;
    momentum_3: sign of the last three log returns; vol_breakout: the bar's move where its range is over half of the greatest of the n bars
    before; london_drift: 08:00 open against the close before, held four bars; spread_filtered_reversal: the first rule below the series'
    median spread.
    """
    w, hour = by_ts(), F.hour("ts")
    middle = bars.groupBy("pair").agg(F.percentile("spread_median_pips", 0.5).alias("middle"))
    past = w.rowsBetween(-n, -1)
    rows = bars.join(middle, "pair").withColumns({"lr": log_return(), "move": F.signum(F.col("close") - F.col("open")), "range": F.col("high") - F.col("low")})
    rows = rows.withColumns({
        "against": F.coalesce(-F.last(F.nullif("move", F.lit(0.0)), True).over(w), F.lit(0.0)),
        "three": sign(F.round(sma("lr", 3), 12)),
        "widest": F.when(F.count("range").over(past) == n, F.max("range").over(past)),
        "gap": F.when(hour == 8, sign(F.col("open") - F.lag("close").over(w))).otherwise(0.0),
    })
    rules = [
        F.col("against"), F.when(hour == 7, F.coalesce("move", F.lit(0.0))).otherwise(0.0), F.col("three"),
        F.when(F.col("range") > F.col("widest") * 0.5, F.col("move")).otherwise(0.0), clip(F.sum("gap").over(w.rowsBetween(-3, 0))),
        F.when(F.col("spread_median_pips") >= F.col("middle"), 0.0).otherwise(F.col("against")),
    ]
    cells = F.array(*(F.struct(F.lit(k).alias("family"), (v + 0.0).alias("signal")) for k, v in zip(FAMILIES, rules)))
    return rows.withColumn("cells", cells).select("pair", "ts", "close", "spread_median_pips", F.inline("cells"))


def blend(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(pair, ts, signal): weighted mean over the strategies that have a signal there, held to [-1, 1]."""
    w = F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("strategy"))
    rows = signals.withColumn("w", w).where("w is not null and signal is not null")
    mean = F.try_divide(F.sum(F.col("w") * F.col("signal")), F.sum("w"))
    return rows.groupBy("pair", "ts").agg(F.coalesce(clip(mean), F.lit(0.0)).alias("signal"))


def trend_filters(rows: DataFrame, carry_signal: str, n: int = 50, scale: float = 0.02) -> DataFrame:
    """Three long-only rules: above the mean; above it with positive carry; strength of the distance."""
    away = F.col("close") / sma("close", n) - 1
    up = F.coalesce(away > 0, F.lit(False))
    return rows.withColumns({
        "trend": up.cast("double"), "trend_carry": (up & (F.col(carry_signal) > 0)).cast("double"),
        "strength": F.coalesce(clip(away / scale, 0.0, 1.0), F.lit(0.0)),
    })


def degraded(rows: DataFrame, share: float, lag: int, seed: int = 1) -> DataFrame:
    """A share of signals replaced by -1, 0 or +1, then all delayed by `lag` bars."""
    def u(tag: str) -> Column:
        key = F.concat_ws("|", F.lit(f"{seed}|{tag}"), F.col("pair"), F.unix_timestamp("ts").cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    mixed = rows.withColumn("signal", F.when(u("d") < share, (F.floor(u("v") * 3) - 1).cast("double")).otherwise(F.col("signal")))
    return mixed.withColumn("signal", F.lag("signal", lag, 0.0).over(by_ts()))


def envelope_machine(enter: float, leave: float, scale: float, longest: int):
    """(number of states, step(state, z) -> (state, size)). States: 0 out of the market, 1 at rest, then each side with each age. Against a
    |z| over `enter`, sized by how far it is over it; given up below `leave`, after `longest` bars or at the opposite extreme, then one
    bar of rest. A null z gives 0 and leaves the state as it is."""
    ages = longest + 1

    def step(state: int, z: float | None) -> tuple[int, float]:
        if z is None or z != z:
            return state, 0.0
        if state == 1:
            return 0, 0.0
        if state == 0:
            if abs(z) <= enter:
                return 0, 0.0
            side = -1 if z > 0 else 1
            return 2 + (side > 0) * ages, side * min((abs(z) - enter) / scale, 1.0)
        side, age = (1 if state - 2 >= ages else -1), (state - 2) % ages + 1
        if abs(z) < leave or age > longest or -side * z < -enter:
            return 1, 0.0
        return 2 + (side > 0) * ages + age, max(-1.0, min(1.0, side * max(0.0, abs(z) - enter) / scale))

    return 2 + 2 * ages, step


def envelope(
    rows: DataFrame, z: str = "z", enter: float = 2.0, leave: float = 0.5, scale: float = 1.0, longest: int = 30, length: int = chunks.ROWS, span: int = chunks.SPAN
) -> DataFrame:
    """(pair, ts, z, signal) of the envelope_machine() walked along each series, in chunks of at most `length` rows within `span` seconds."""
    states, step = envelope_machine(enter, leave, scale, longest)
    return chunks.automaton(rows.select("pair", "ts", F.col(z).alias("z")), "z", states, step, "signal", length, span)
