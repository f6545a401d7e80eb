"""Indicators as columns over (pair, ts) windows. Rolling values are null until their window is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.operators import chunks


def by_ts():
    """Rows of one series in time order."""
    return W.partitionBy("pair").orderBy("ts")


def last_n(n: int):
    return by_ts().rowsBetween(-(n - 1), 0)


def full(value: Column, of: str, n: int) -> Column:
    """The value where the n-row window holds n non-null entries of `of`."""
    return F.when(F.count(of).over(last_n(n)) == n, value)


def sma(x: str, n: int) -> Column:
    return full(F.avg(x).over(last_n(n)), x, n)


def rolling_std(x: str, n: int) -> Column:
    return full(F.stddev_samp(x).over(last_n(n)), x, n)


def momentum(x: str, n: int) -> Column:
    return F.col(x) / F.lag(x, n).over(by_ts()) - 1


def true_range() -> Column:
    before = F.lag("close").over(by_ts())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def log_return(x: str = "close") -> Column:
    return F.log(F.col(x) / F.lag(x).over(by_ts()))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, std = sma("close", n), rolling_std("close", n)
    return bars.withColumns({"bb_mid": mid, "bb_upper": mid + k * std, "bb_lower": mid - k * std})


def atr_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn("atr", sma("tr", n))


def realised_volatility(bars: DataFrame, n: int = 20, bars_per_year: float = 252.0) -> DataFrame:
    return bars.withColumn("r", momentum("close", 1)).withColumn("vol", rolling_std("r", n) * F.sqrt(F.lit(bars_per_year)))


def rolling_sharpe(bars: DataFrame, n: int = 60, bars_per_year: float = 252.0) -> DataFrame:
    bars = bars.withColumn("r", momentum("close", 1))
    std = rolling_std("r", n)
    return bars.withColumn("sharpe", F.when(std > 0, sma("r", n) / std * F.sqrt(F.lit(bars_per_year))))


def ema_columns(df: DataFrame, spans: dict[str, tuple[str, float, int]], length: int = chunks.ROWS, span: int = chunks.SPAN) -> DataFrame:
    """Adds recursive means: {out: (column, alpha, least observations)}. The first non-null value seeds the mean; leading nulls wait. See
    chunks.recursive_means(): series are cut into chunks of at most `length` rows within `span` seconds."""
    return chunks.recursive_means(df, spans, length, span)


def ema(bars: DataFrame, n: int, x: str = "close", out: str = "ema") -> DataFrame:
    return ema_columns(bars, {out: (x, 2 / (n + 1), n)})


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI; the first change counts as no gain and no loss; no loss gives 100, neither 50."""
    change = F.col("close") - F.lag("close").over(by_ts())
    parts = bars.withColumns({"gain": F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0)), "loss": F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0))})
    means = ema_columns(parts, {"g": ("gain", 1 / n, n), "l": ("loss", 1 / n, n)})
    value = F.when((F.col("g") == 0) & (F.col("l") == 0), 50.0).when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("g", "l")))
    return means.withColumn("rsi", F.when(F.col("g").isNotNull() & ~F.isnan("g"), value)).drop("gain", "loss", "g", "l")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return ema_columns(bars.withColumn("tr", true_range()), {"atr": ("tr", 1 / n, n)})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal and histogram; the signal's recursion starts on the first non-null line."""
    both = ema_columns(bars, {"f": ("close", 2 / (fast + 1), fast), "s": ("close", 2 / (slow + 1), slow)})
    line = both.withColumn("macd", F.nanvl("f", F.lit(None)) - F.nanvl("s", F.lit(None)))
    out = ema_columns(line, {"macd_signal": ("macd", 2 / (signal + 1), signal)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("f", "s")


def bars_per_year(bars: DataFrame) -> DataFrame:
    """Median spacing of each series in hours, snapped to 6240 (hourly), 1560 (4 hours) or 252 (daily) bars a year."""
    gap = bars.withColumn("h", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_ts()))) / 3600)
    hours = gap.groupBy("pair").agg(F.percentile("h", 0.5).alias("bar_hours"))
    snapped = F.when(F.col("bar_hours") <= 1.5, 6240.0).when(F.col("bar_hours") <= 6, 1560.0).otherwise(252.0)
    return hours.withColumn("periods_per_year", snapped)


def relative_to_season(bars: DataFrame, x: str, out: str, floor: float = 1.0, usual: str | None = None) -> DataFrame:
    """x over the median of its weekday-hour bucket in the series, the median at least `floor`; usual: a name under which that is kept."""
    keyed = bars.withColumn("bucket", F.weekday("ts") * 24 + F.hour("ts"))
    norm = keyed.groupBy("pair", "bucket").agg(F.percentile(x, 0.5).alias("norm"))
    rows = keyed.join(norm, ["pair", "bucket"]).withColumn("norm", F.greatest("norm", F.lit(floor))).withColumn(out, F.col(x) / F.col("norm"))
    return (rows.withColumnRenamed("norm", usual) if usual else rows.drop("norm")).drop("bucket")


def session_open(bars: DataFrame) -> DataFrame:
    """Open of the first bar of each UTC date."""
    day = W.partitionBy("pair", F.to_date("ts")).orderBy("ts")
    return bars.withColumn("session_open", F.first("open").over(day))


def hours_to_next(bars: DataFrame) -> DataFrame:
    """Hours to the next bar, and whether a gap (or the end) follows."""
    hours = (F.unix_timestamp(F.lead("ts").over(by_ts())) - F.unix_timestamp("ts")) / 3600
    return bars.withColumn("hours_to_next", hours).withColumn("pre_gap", F.coalesce(F.col("hours_to_next") > 1, F.lit(True)))


def by_names(bars: DataFrame, names: list[str]) -> DataFrame:
    """Indicators by name: sma_N, mom_N, ema_N, rsi_N, atr_N, bb_N_K, macd_F_S_N. A column that is there is kept; an unknown name is an error."""
    for name in names:
        kind, *args = name.split("_")
        n = [float(a) if "." in a else int(a) for a in args]
        if name in bars.columns:
            continue
        if kind == "sma" and len(n) == 1:
            bars = bars.withColumn(name, sma("close", n[0]))
        elif kind == "mom" and len(n) == 1:
            bars = bars.withColumn(name, momentum("close", n[0]))
        elif kind == "ema" and len(n) == 1:
            bars = ema(bars, n[0], out=name)
        elif kind in ("rsi", "atr") and len(n) == 1:
            bars = {"rsi": rsi, "atr": atr}[kind](bars, n[0]).withColumnRenamed(kind, name)
        elif kind == "bb" and len(n) == 2:
            bars = bollinger(bars, *n)
        elif kind == "macd" and len(n) == 3:
            bars = macd(bars, *n)
        else:
            raise ValueError(f"unknown indicator {name}")
    return bars


def hour_class_sigma(bars: DataFrame, hours: tuple[int, ...], n: int = 20) -> DataFrame:
    """Std of the previous n returns of bars in the session hours, the current one excluded; null outside the session."""
    rows = bars.withColumn("r", momentum("close", 1)).withColumn("in_class", F.hour("ts").isin(*hours))
    w = W.partitionBy("pair", "in_class").orderBy("ts").rowsBetween(-n, -1)
    return rows.withColumn("sigma", F.when(F.col("in_class") & (F.count("r").over(w) == n), F.stddev_samp("r").over(w)))


def ols_zscore(bars: DataFrame, n: int = 120) -> DataFrame:
    """Last residual of log(close) on bar number over n bars, in residual standard deviations; 0 below 1e-12."""
    rows = bars.withColumns({"y": F.log("close"), "t": F.row_number().over(by_ts()).cast("double")})
    w = last_n(n)
    rows = rows.withColumns({"sxy": F.covar_samp("t", "y").over(w), "syy": F.var_samp("y").over(w), "ym": F.avg("y").over(w), "k": F.count("y").over(w)})
    var_t, mid = n * (n + 1) / 12, (n - 1) / 2
    std = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / var_t, F.lit(0.0)))
    z = F.when(std < 1e-12, 0.0).otherwise((F.col("y") - F.col("ym") - F.col("sxy") / var_t * mid) / std)
    return rows.withColumn("z", F.when(F.col("k") == n, z)).drop("y", "t", "sxy", "syy", "ym", "k")


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def mad_zscore(bars: DataFrame, x: str, n: int = 60, least: int = 2) -> DataFrame:
    """(x - median) / MAD of the up to n bars before; null with fewer than `least`, 0 with a MAD of 0."""
    rows = bars.withColumn("past", F.collect_list(x).over(by_ts().rowsBetween(-n, -1))).withColumn("med", _median(F.col("past")))
    rows = rows.withColumn("mad", _median(F.transform("past", lambda v: F.abs(v - F.col("med")))))
    z = F.when(F.col("mad") > 0, (F.col(x) - F.col("med")) / F.col("mad")).otherwise(0.0)
    return rows.withColumn("spread_z", F.when(F.size("past") >= least, z)).drop("past", "med", "mad")


def range_surprise(bars: DataFrame, n: int = 250, k: float = 1.5) -> DataFrame:
    """Median true range of the n bars before, and whether this bar's is over k times it."""
    w = by_ts().rowsBetween(-n, -1)
    rows = bars.withColumn("tr", true_range())
    return rows.withColumn("usual", F.when(F.count("tr").over(w) == n, F.percentile("tr", 0.5).over(w))).withColumn("surprise", F.coalesce(F.col("tr") > F.col("usual") * k, F.lit(False)))
