"""Bootstrap and null tests at the reference's counts of draws."""

import hashlib

import numpy as np
import pytest

from tidemark.operators import statistics as stats
from tidemark.plans import decisions, market, reports, research, studies  # noqa: F401

DIR = "/root/testdata/sf0.001"


def series(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "pair string, ts long, ret double")


def test_sql_is_kept():
    assert "range(10) x(draw)" in market.SQL["bt12_null_grid"] and "range(8) x(draw)" in market.SQL["st3_stationary_bootstrap"]


def test_kernel_gives_the_windows_resamples(spark):
    x = np.random.default_rng(3).normal(size=40)
    want = {r["draw"]: r["mean"] for r in stats.stationary_bootstrap(series(spark, x), 8, 5.0).collect()}

    def u(tag, draw):
        return np.array([int(hashlib.md5(f"1|{tag}|a|{draw}|{t}".encode()).hexdigest()[:8], 16) / 2**32 for t in range(40)])

    for draw in range(8):
        assert x[stats.resampled(u("r", draw), u("i", draw), 5.0)].mean() == pytest.approx(want[draw], abs=1e-12)


def test_p_is_fine_enough_and_right(spark):
    rng = np.random.default_rng(5)
    noise, drift = rng.normal(size=300), rng.normal(size=300) + 0.3
    rows = series(spark, noise - noise.mean()).union(series(spark, drift).selectExpr("'b'", "ts", "ret")).union(series(spark, [0.5] * 30).selectExpr("'c'", "ts", "ret"))
    got = {r["pair"]: r for r in stats.zero_mean_test(rows, 2000, 10.0).collect()}
    assert all(r["draws"] == 2000 for r in got.values())
    for p in ("p", "p5", "p10", "p20"):
        assert 0.4 < got["a"][p] < 0.6 and got["b"][p] < 0.01
    assert got["c"]["sharpe"] == 0 and got["c"]["p"] == 1
    assert not got["a"]["flips"] and not got["b"]["flips"]
    # the same from the draws, one by one
    null = [r["null_sharpe"] for r in stats.bootstrap_draws(rows.where("pair = 'b'").repartition(3), 2000, [("p", 10.0)]).collect()]
    assert got["b"]["p"] == pytest.approx((1 + sum(s >= got["b"]["sharpe"] for s in null)) / 2001)


def test_registered_counts(spark):
    for name, n in (("st3_stationary_bootstrap_full", 10_000), ("bt12_null_grid_full", 1000)):
        counts = market.QUERIES[name](spark, DIR).selectExpr("split_part(pair, '#', 1) AS pair").groupBy("pair").count().collect()
        assert len(counts) == 5 and all(r["count"] == n for r in counts)
    for name, n in (("st4_zero_mean_test_full", 10_000), ("st11_null_rank_full", 1000)):
        assert [r["draws"] for r in market.QUERIES[name](spark, DIR).collect()] == [n] * 5
