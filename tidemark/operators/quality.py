"""Data-quality jobs: one pass of windows by series, then conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.operators.indicators import by_ts


def in_session(ts: Column) -> Column:
    """Open except from Friday 21:00 to Sunday 22:00 UTC (weekday Monday 0)."""
    day, hour = F.weekday(ts), F.hour(ts)
    return ~((day == 5) | ((day == 4) & (hour >= 21)) | ((day == 6) & (hour < 22)))


def validation_report(bars: DataFrame, z_limit: float = 10.0, n: int = 50, gap_days: float = 4.0) -> DataFrame:
    """(pair, rows, duplicates, high_low, not_positive, outliers, gaps, first_ts, last_ts)."""
    w = by_ts().rowsBetween(-(n - 1), 0)
    std = F.stddev_samp("close").over(w)
    z = F.when((F.count("close").over(w) == n) & (std > 0), (F.col("close") - F.avg("close").over(w)) / std)
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_ts()))) / 86400
    rows = bars.withColumns({"z": z, "gap": gap, "twin": F.lag("ts").over(by_ts()) == F.col("ts")})
    low_high = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return rows.groupBy("pair").agg(
        F.count("*").alias("rows"), F.count_if("twin").alias("duplicates"), F.count_if(low_high).alias("high_low"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("not_positive"), F.count_if(F.abs("z") > z_limit).alias("outliers"),
        F.count_if(F.col("gap") > gap_days).alias("gaps"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def price_range(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    """(pair, low, high, outside): bounds (pair, least, most) is one small row a pair; unlisted pairs pass."""
    bad = F.isnan("close") | F.col("close").isin(float("inf"), float("-inf")) | (F.col("close") < F.col("least")) | (F.col("close") > F.col("most"))
    return bars.join(bounds, "pair", "left").groupBy("pair").agg(F.min("close").alias("low"), F.max("close").alias("high"), F.count_if(bad).alias("outside"))


def spread_and_spike_checks(bars: DataFrame, widest: float = 50.0, jump: float = 0.1) -> DataFrame:
    """(pair, bad_spread, bad_volume, spikes, duplicates, missing): duplicates repeat a stamp; missing have a price that is null or NaN. In
    order of arrival (a column `seq`), unordered would be bars older than the one before; without it, bars have no order of their own."""
    rows = bars.withColumn("change", F.abs(F.try_divide(F.col("close"), F.lag("close").over(by_ts())) - 1)).withColumn("twin", F.lag("ts").over(by_ts()) == F.col("ts"))
    gone = F.lit(False)
    for c in ("open", "high", "low", "close"):
        gone = gone | F.col(c).isNull() | F.isnan(c)
    order = "seq" in bars.columns
    if order:
        rows = rows.withColumn("back", F.col("ts") < F.lag("ts").over(W.partitionBy("pair").orderBy("seq")))
    s = F.col("spread_median_pips")
    return rows.groupBy("pair").agg(
        F.count_if(s.isNull() | (s <= 0) | (s > widest)).alias("bad_spread"), F.count_if(F.col("volume") <= 0).alias("bad_volume"), F.count_if(F.col("change") > jump).alias("spikes"),
        F.count_if("twin").alias("duplicates"), F.count_if(gone).alias("missing"), *([F.count_if("back").alias("unordered")] if order else []),
    )


def longest_run(rows: DataFrame, flag: Column, out: str, extra: int = 0) -> DataFrame:
    """(pair, out): longest run of consecutive rows with the flag; islands are numbered by the rows without it."""
    marked = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("__island", F.count_if(~F.col("__f")).over(by_ts()))
    runs = marked.groupBy("pair", "__island").agg(F.count_if("__f").alias("n"))
    return runs.groupBy("pair").agg(F.max("n").alias("n")).select("pair", F.when(F.col("n") > 0, F.col("n") + extra).otherwise(0).cast("long").alias(out))


def stale_run(bars: DataFrame) -> DataFrame:
    """Longest run of bars with the same four prices."""
    same = None
    for c in ("open", "high", "low", "close"):
        step = F.col(c) == F.lag(c).over(by_ts())
        same = step if same is None else same & step
    return longest_run(bars.withColumn("__same", same), F.col("__same"), "stale_run", extra=1)


def weekend_check(bars: DataFrame) -> DataFrame:
    day = F.weekday("ts")
    return bars.groupBy("pair").agg(F.count_if(day == 5).alias("saturday"), F.count_if(day == 4).alias("friday"), F.count_if((day == 4) & (F.hour("ts") >= 21)).alias("late_friday"))


def slots(bars: DataFrame) -> DataFrame:
    """(pair, ts): in-session hours from each pair's first to its last bar."""
    span = bars.groupBy("pair").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select("pair", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts")).where(in_session(F.col("ts")))


def missing_hours(bars: DataFrame) -> DataFrame:
    """(pair, expected, present, longest_gap): longest run of absent in-session hours; a weekend ends a run."""
    return missing_in(slots(bars), bars)


def missing_in(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """The same over given slots (pair, ts)."""
    have = bars.select("pair", "ts", F.lit(True).alias("have"))
    grid = grid.join(have, ["pair", "ts"], "left").withColumn("gone", F.col("have").isNull())
    broken = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_ts())) > 3600
    grid = grid.withColumn("edge", ~F.col("gone") | F.coalesce(broken, F.lit(False)))
    grid = grid.withColumn("island", F.count_if("edge").over(by_ts()))
    runs = grid.groupBy("pair", "island").agg(F.count("*").alias("n"), F.count_if("gone").alias("g"))
    return runs.groupBy("pair").agg(F.sum("n").alias("expected"), (F.sum("n") - F.sum("g")).alias("present"), F.max("g").alias("longest_gap"))


def month_manifest(bars: DataFrame, floor: int = 100) -> DataFrame:
    """(pair, month, bars, status) over a generated calendar: ZERO, LOW (under the floor), THIN (under half the upper median of the pair's full
    months with bars) or OK. The pair's last month is not over yet, so it is PARTIAL and no measure for others."""
    counts = bars.groupBy("pair", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"))
    span = counts.groupBy("pair").agg(F.min("month").alias("a"), F.max("month").alias("b"), F.sort_array(F.collect_list(F.struct("month", "n"))).alias("all"))
    whole = F.array_sort(F.transform(F.filter("all", lambda m: m["month"] < F.col("b")), lambda m: m["n"]))
    span = span.withColumn("median", F.coalesce(F.get(whole, F.floor(F.size(whole) / 2).cast("int")), F.lit(0)))
    calendar = span.select("pair", "median", "b", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("month") == F.col("b"), "PARTIAL").when(n == 0, "ZERO").when(n < floor, "LOW").when(n < F.floor(F.col("median") / 2), "THIN").otherwise("OK")
    return calendar.join(counts, ["pair", "month"], "left").select("pair", "month", n.alias("bars"), status.alias("status"))


def fill_gaps(rows: DataFrame, x: str, max_gap: int = 3) -> DataFrame:
    """Fills null runs of at most max_gap rows with the value before; longer runs stay null."""
    island = F.count(x).over(by_ts())
    rows = rows.withColumn("__island", island)
    size = F.count_if(F.col(x).isNull()).over(W.partitionBy("pair", "__island"))
    return rows.withColumn("filled", F.when(size <= max_gap, F.last(x, True).over(by_ts())).otherwise(F.col(x))).drop("__island")
