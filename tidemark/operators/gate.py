"""Admission of series by the quality of their bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.quality import longest_run


def bar_checks(bars: DataFrame, least_volume: float = 0.0, tight: float = 0.0, share: float = 0.05) -> DataFrame:
    """(pair, bars, bad_p90, crossed, bad_volume, tight_run, excluded): a series with more than `share` of bad bars is excluded."""
    rows = bars.withColumns({
        "b1": ~F.coalesce(F.col("spread_p90_pips") > 0, F.lit(False)), "b2": F.coalesce(F.col("spread_median_pips") > F.col("spread_p90_pips"), F.lit(True)),
        "b3": F.coalesce(F.col("volume") <= least_volume, F.lit(True)), "tight": F.coalesce(F.col("spread_median_pips") <= tight, F.lit(False)),
    })
    sums = rows.groupBy("pair").agg(
        F.count("*").alias("bars"), F.count_if("b1").alias("bad_p90"), F.count_if("b2").alias("crossed"), F.count_if("b3").alias("bad_volume"),
        (F.count_if(F.expr("b1 or b2 or b3")) / F.count("*") > share).alias("excluded"),
    )
    return sums.join(longest_run(rows, F.col("tight"), "tight_run"), "pair")


def coverage_gate(
    coverage: DataFrame, spreads: DataFrame, least_bars: int, least_share: float, longest_gap: int, band: tuple[float, float], least_measured: float = 0.0
) -> DataFrame:
    """(pair, coverage, spread, measured, verdict, issues) from (pair, expected, present, longest_gap) and (pair, spread, measured: the
    share of bars with a spread over 0). Too few bars, too little coverage or too few measured spreads exclude; any other issue asks for
    review."""
    share = F.col("present") / F.col("expected")
    few, thin, gap = F.col("present") < least_bars, share < least_share, F.col("longest_gap") > longest_gap
    off = ~F.coalesce(F.col("spread").between(*band), F.lit(False))
    blind = ~F.coalesce(F.col("measured") >= least_measured, F.lit(False))
    issues = F.concat_ws(",", *(F.when(c, n) for c, n in ((few, "bars"), (thin, "coverage"), (blind, "measured"), (gap, "gap"), (off, "spread"))))
    rows = coverage.join(spreads, "pair", "left").select("pair", share.alias("coverage"), "spread", "measured", issues.alias("issues"), (few | thin | blind).alias("out"))
    return rows.select("pair", "coverage", "spread", "measured", "issues", F.when(F.col("out"), "EXCLUDE").when(F.col("issues") != "", "MANUAL_REVIEW").otherwise("ADMIT").alias("verdict"))


def cross_pair_flags(spreads: DataFrame, ratio: float, suffix: str = "JPY", least: float = 0.05, most: float = 20.0) -> DataFrame:
    """(pair, spread, wide, narrow, off): among the series without the suffix, whether another one's spread is `ratio` times smaller or
    greater; the extremes decide, so no pairs are formed. Of those with the suffix, off: the spread over the others' median is outside
    [least, most]."""
    rows = spreads.where("spread > 0").withColumn("own", F.col("pair").endswith(suffix))
    other = F.when(~F.col("own"), F.col("spread"))
    ends = rows.agg(F.min(other).alias("lo"), F.max(other).alias("hi"), F.percentile(other, 0.5).alias("mid"))  # one row
    plain, share = ~F.col("own"), F.col("spread") / F.col("mid")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.crossJoin(F.broadcast(ends)).select(
        "pair", "spread", flag(plain & (F.col("spread") > F.col("lo") * ratio)).alias("wide"), flag(plain & (F.col("hi") > F.col("spread") * ratio)).alias("narrow"),
        flag(F.col("own") & ~share.between(least, most)).alias("off"),
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("pairs"))
