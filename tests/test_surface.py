"""Plug points, numbering and sums over chunks, grids, drawdown details and fixed benchmarks on small cases."""

import math
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import strategies
from tidemark.operators import chunks, events, evidence, joins, metrics, signals

MONDAY = datetime(2024, 1, 8)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(1)
    rows = [(p, MONDAY + timedelta(hours=7 * i), float(c)) for p, n in (("a", 150), ("b", 31), ("c", 1)) for i, c in enumerate(100 + rng.normal(size=n).cumsum())]
    return spark.createDataFrame(rows, "pair string, ts timestamp, close double").repartition(4).cache()


def crossover():
    def run(frame):
        gap = frame["close"].rolling(3).mean() - frame["close"].rolling(9).mean()
        return np.sign(gap.fillna(0.0))

    return run


@pytest.mark.parametrize("length", [1, 10, 25, 4096])
def test_a_users_function_and_a_built_in_signal_give_the_same_rows(bars, length):
    own = bars.transform(strategies.pandas_signal(crossover(), 8, length=length))
    built = bars.transform(strategies.signal("sma_cross", fast=3, slow=9))
    assert own.columns == ["pair", "ts", "close", "signal"]
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, built.select(own.columns).collect()))


def test_frames_hold_the_run_and_its_look_back(bars):
    def width(frame):
        return [len(frame)] * len(frame)

    got = bars.transform(strategies.pandas_signal(width, 5, length=10)).where("pair = 'a'").orderBy("ts").toPandas()["signal"].tolist()
    assert got == [10] * 10 + [15] * 140
    needs = bars.transform(strategies.pandas_signal(lambda f: f["mom_3"], 3, needs=("mom_3",), length=10)).where("pair = 'a'").orderBy("ts").toPandas()
    assert needs["signal"].to_numpy()[3:] == pytest.approx(needs["close"].pct_change(3).to_numpy()[3:]) and needs["signal"].isna().sum() == 3


def test_names_of_signals(bars):
    assert {"sma_cross", "macd_cross", "envelope"} <= set(strategies.names())
    with pytest.raises(ValueError, match="unknown signal"):
        strategies.signal("nothing")

    if "test_flat" not in strategies.names():
        @strategies.register("test_flat")
        def flat(level=0.0):
            return lambda rows: rows.withColumn("signal", F.lit(level))

    assert {r["signal"] for r in bars.transform(strategies.signal("test_flat", level=0.5)).collect()} == {0.5}
    with pytest.raises(ValueError, match="already"):
        strategies.register("test_flat")(lambda: None)


@pytest.mark.parametrize("length, span", [(7, 86_400 * 3), (4096, 10**9)])
def test_numbers_and_sums_over_chunks(bars, length, span):
    got = chunks.running_sum(chunks.numbered(bars, "i", length, span), "close", "total", length, span).toPandas().sort_values(["pair", "ts"])
    for _, own in got.groupby("pair"):
        assert own["i"].tolist() == list(range(len(own))) and own["total"].to_numpy() == pytest.approx(own["close"].cumsum().to_numpy())


def test_portfolio_and_grid(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{p}", MONDAY + timedelta(days=d), float(v)) for p in range(7) for d, v in enumerate(rng.normal(size=60) * 0.01) if (p + d) % 4]
    df = spark.createDataFrame(rows, "pair string, ts timestamp, ret double")
    frame = pd.DataFrame(rows, columns=["pair", "ts", "ret"])
    got = metrics.portfolio(df).orderBy("ts").toPandas()
    assert got["equity"].to_numpy() == pytest.approx((1 + frame.groupby("ts")["ret"].mean()).cumprod().to_numpy())
    want = frame.pivot(index="ts", columns="pair", values="ret").fillna(0.0).stack()
    for names in (1, 3, 1000):
        grid = joins.outer_zero(df, names).toPandas()
        assert len(grid) == len(want) and grid.set_index(["ts", "pair"])["ret"].sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy())
        assert "Cartesian" not in (plan := joins.outer_zero(df, names)._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_drawdown_details(spark):
    equity = [100, 110, 99, 104, 112, 90, 60, 80, 120, 119, 100]
    rows = spark.createDataFrame([("a", MONDAY + timedelta(days=i), float(e), float(i)) for i, e in enumerate(equity)], "pair string, ts timestamp, equity double, rate double")
    details = metrics.drawdown_details(rows, 0.05, ("rate",))
    got = [(r["peak_ts"].day - 8, r["trough_ts"].day - 8, r["recovery_ts"] and r["recovery_ts"].day - 8, r["days_down"], r["days_up"], r["rate"], round(r["depth"], 4), r["rank"]) for r in details.orderBy("peak_ts").collect()]
    assert got == [(1, 2, 4, 1, 2, 1.0, 0.1, 3), (4, 6, 8, 2, 2, 4.0, 0.4643, 1), (8, 10, None, 2, None, 8.0, 0.1667, 2)]
    histogram = {(r["over"], r["upto"]): (r["drawdowns"], r["unrecovered"], r["days"]) for r in metrics.drawdown_histogram(details).collect()}
    assert histogram == {(0.07, 0.1): (1, 0, 1), (0.15, 0.2): (1, 1, 2), (0.2, 0.5): (1, 0, 2)}


def test_fixed_benchmarks(spark):
    cases = [(0.767, 4186, 0.196, 8.278), (1.5, 500, 0.2, 3.0), (-0.1, 500, 0.0, 0.0), (40.0, 50, 3.0, -1.9)]
    rows = spark.createDataFrame(cases, "sharpe double, n long, skew double, kurt double")
    for benchmark in (evidence.CELL_BENCHMARK, evidence.EVENT_BENCHMARK):
        for r in evidence.deflated_against(rows, benchmark).collect():
            s = r["sharpe"] / math.sqrt(252)
            var = 1 - r["skew"] * s + (r["kurt"] + 2) / 4 * s * s
            want = 0.0 if s <= 0 or var <= 0 else NormalDist().cdf((s - benchmark) * math.sqrt(r["n"] - 1) / math.sqrt(var))
            assert r["dsr"] == pytest.approx(want, abs=1e-9)
    first = evidence.deflated_against(rows, evidence.CELL_BENCHMARK).first()
    assert first["dsr"] == pytest.approx(0.9503, abs=2e-4)  # a published value of that case, whose Sharpe is known to three digits


def test_sample_moments_and_spacing(spark):
    x = np.random.default_rng(3).gamma(2.0, size=40)
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", 3.0), ("c", 1.0), ("c", 2.0), ("c", 9.0)], "pair string, ret double")
    got = {r["pair"]: r for r in metrics.sample_moments(rows, "pair").collect()}
    assert (got["a"]["skew"], got["a"]["kurt"]) == pytest.approx((pd.Series(x).skew(), pd.Series(x).kurt()))
    assert got["b"]["skew"] is None and got["c"]["skew"] == pytest.approx(pd.Series([1.0, 2, 9]).skew()) and got["c"]["kurt"] is None
    made = [(p, MONDAY + timedelta(hours=h * i), float(v)) for p, h in (("hourly", 1), ("four", 4), ("daily", 24)) for i, v in enumerate(x - x.mean() + 0.1)]
    spaced = {r["pair"]: r for r in metrics.summary_by_spacing(spark.createDataFrame(made, "pair string, ts timestamp, ret double")).collect()}
    assert {p: r["periods_per_year"] for p, r in spaced.items()} == {"hourly": 6240, "four": 1560, "daily": 252}
    y = x - x.mean() + 0.1
    assert spaced["four"]["sharpe"] == pytest.approx(y.mean() / y.std(ddof=1) * 1560**0.5)


def test_participation_trades(spark):
    rows = [(7, 10.0, 11.0, 1.0, 2.0), (8, 11.0, 12.0, 1.0, 1.0), (9, 12.0, 12.5, 3.0, 1.0), (13, 12.5, 12.0, 1.0, 2.0), (14, 12.0, 12.0, 0.5, 1.0), (15, 12.0, 11.0, 0.5, 1.0)]
    bars = spark.createDataFrame([("a", MONDAY + timedelta(hours=h), o, c, s, v, 1.0) for h, o, c, s, v in rows], "pair string, ts timestamp, open double, close double, spread_median_pips double, relvol double, relrng double")
    got = events.participation_trades(bars, pip=0.01).orderBy("ts").collect()
    assert [(r["direction"], round(r["gross"], 6), round(r["cost"], 6)) for r in got] == [(1.0, 150.0, 4.8), (-1.0, 100.0, 1.8)]
    assert events.participation_trades(bars.withColumn("spread_median_pips", F.lit(0.0))).count() == 0
    assert events.participation_trades(bars.withColumn("close", F.col("open"))).count() == 0


def test_registered_signals_run(bars):
    for name, params in (("momentum", {"n": 3}), ("macd_cross", {}), ("ema_cross", {"fast": 3, "slow": 9}), ("random", {"draw": 1})):
        assert {r["signal"] for r in bars.transform(strategies.signal(name, **params)).collect()} <= {-1.0, 0.0, 1.0}
    assert signals.sma_cross(bars, 3, 9).count() == 182
