"""As-of and alignment joins without range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W


def asof(bars: DataFrame, events: DataFrame, value: str, by: str = "pair", forward: bool = False) -> DataFrame:
    """Last (or, forward, next) non-null event value at or before (after) each bar: a union, one sort by series, no range join."""
    left = bars.withColumns({"__bar": F.lit(1), "__v": F.lit(None).cast(events.schema[value].dataType)})
    right = events.select(by, "ts", F.lit(0).alias("__bar"), F.col(value).alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True)
    if forward:  # on one stamp the event counts for the bar
        found = F.first("__v", True).over(W.partitionBy(by).orderBy(F.col("ts"), F.desc("__bar")).rowsBetween(0, W.unboundedFollowing))
    else:
        found = F.last("__v", True).over(W.partitionBy(by).orderBy("ts", "__bar").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, found).where("__bar = 1").drop("__bar", "__v")


def common_times(returns: DataFrame, cells: int) -> DataFrame:
    """Rows whose time occurs in all `cells` series: one aggregate and a semi join instead of repeated intersections."""
    full = returns.groupBy("ts").agg(F.count("*").alias("n")).where(F.col("n") == cells).select("ts")
    return returns.join(full, "ts", "left_semi")


#: Names of series that one row of outer_zero()'s table holds, about.
NAMES = 1000


def outer_zero(returns: DataFrame, names: int = NAMES) -> DataFrame:
    """Every series at every time; a missing return is 0. Times are laid out against lists of some `names` series each, which lie in one row
    apiece: an equi-join on the number of the list."""
    series = returns.select("pair").distinct()
    lists = max(1, -(-series.count() // names))
    listed = series.withColumn("list", F.pmod(F.xxhash64("pair"), F.lit(lists)).cast("int")).groupBy("list").agg(F.collect_set("pair").alias("pairs"))
    times = returns.select("ts").distinct().withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
    grid = times.join(listed, "list").select(F.explode("pairs").alias("pair"), "ts")
    return grid.join(returns, ["pair", "ts"], "left").select("pair", "ts", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def differentials(rates: DataFrame, legs: DataFrame) -> DataFrame:
    """(pair, ts, diff): base less quote over 100 on business days, each currency filled forward; days with a leg missing go."""
    span = rates.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))  # one row
    days = rates.select("currency").distinct().crossJoin(F.broadcast(span)).select("currency", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("ts"))
    daily = asof(days.where(F.weekday("ts") < 5), rates, "rate", by="currency")
    base = daily.select(F.col("currency").alias("base"), "ts", F.col("rate").alias("x"))
    quote = daily.select(F.col("currency").alias("quote"), "ts", F.col("rate").alias("y"))
    rows = base.join(legs, "base").join(quote, ["quote", "ts"])
    return rows.select("pair", "ts", ((F.col("x") - F.col("y")) / 100).alias("diff")).where("diff is not null")


def compare_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, rows, mean_diff, agreement) of two signal tables at shared times."""
    rows = a.select("pair", "ts", F.col("signal").alias("x")).join(b.select("pair", "ts", F.col("signal").alias("y")), ["pair", "ts"])
    same = (F.signum("x") == F.signum("y")).cast("double")
    return rows.groupBy("pair").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_diff"), F.avg(same).alias("agreement"))
