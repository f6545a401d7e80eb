"""Recursions over chunks of any length give those of the whole series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import chunks, indicators as ind, signals

MONDAY = datetime(2024, 1, 8)
SIZES = [(7, 86_400 * 5), (1, 86_400), (4096, chunks.SPAN), (50, 10**9)]


def column(rng, n, holes):
    x = 100 + rng.normal(size=n).cumsum()
    x[rng.random(n) < holes] = np.nan
    return x


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    made = {"full": column(rng, 400, 0), "holes": column(rng, 400, 0.4), "late": np.concatenate([np.full(60, np.nan), column(rng, 100, 0.1)]), "one": np.array([5.0]), "none": np.full(30, np.nan)}
    made["long gap"] = np.concatenate([column(rng, 30, 0), np.full(900, np.nan), column(rng, 30, 0)])
    return made


def frame(spark, series):
    rows = [(p, MONDAY + timedelta(hours=9 * i), None if math.isnan(v) and i % 2 else float(v)) for p, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "pair string, ts timestamp, x double").repartition(5)


@pytest.mark.parametrize("length, span", SIZES)
def test_means_of_chunks_are_those_of_the_series(spark, series, length, span):
    spans = {"slow": ("x", 2 / 201, 3), "quick": ("x", 2 / 3, 1), "wilder": ("x", 1 / 14, 14), "last": ("x", 1.0, 1)}
    got = ind.ema_columns(frame(spark, series), spans, length, span)
    assert got.columns == ["pair", "ts", "x", *spans]
    got = got.toPandas().sort_values(["pair", "ts"])
    for p, x in series.items():
        own = got[got["pair"] == p]
        assert len(own) == len(x)
        for out, (_, alpha, least) in spans.items():
            want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            assert np.allclose(own[out].to_numpy(float), want.to_numpy(), rtol=1e-11, equal_nan=True), (p, out)


def test_no_python_in_the_means(spark, series):
    plan = ind.macd(frame(spark, series).withColumnRenamed("x", "close"))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


def states(z, enter, leave, scale, longest):
    """The rule, bar by bar, with a side, an age and a rest."""
    side, age, resting, out = 0, 0, False, []
    for v in z:
        size = 0.0
        if v is None or v != v:
            pass
        elif resting:
            resting = False
        elif side == 0:
            if abs(v) > enter:
                side, age = (-1 if v > 0 else 1), 0
                size = side * min((abs(v) - enter) / scale, 1.0)
        else:
            age += 1
            if abs(v) < leave or age > longest or -side * v < -enter:
                side, resting = 0, True
            else:
                size = max(-1.0, min(1.0, side * max(0.0, abs(v) - enter) / scale))
        out.append(size)
    return out


def walked(z, *rule):
    step, state, out = signals.envelope_machine(*rule)[1], 0, []
    for v in z:
        state, size = step(state, v)
        out.append(size)
    return out


def test_envelope_machine():
    z = [0.0, 2.5, 3.5, None, 0.4, 9.0, -2.2, -2.4, 2.5, 0.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0]
    assert walked(z, 2.0, 0.5, 1.0, 3) == pytest.approx([0, -0.5, -1, 0, 0, 0, 0.2, 0.4, 0, 0, -1, -1, -1, -1, 0, 0])
    rng = np.random.default_rng(5)
    for longest in (0, 1, 7):
        z = [None if v > 2.9 else float(v) for v in rng.normal(size=3000) * 1.5]
        assert walked(z, 1.5, 0.5, 1.0, longest) == states(z, 1.5, 0.5, 1.0, longest)


@pytest.mark.parametrize("length, span", SIZES)
def test_envelope_of_chunks_is_that_of_the_series(spark, length, span):
    rng = np.random.default_rng(6)
    made = {p: [None if v > 2.9 else float(v) for v in rng.normal(size=n) * 1.2 + np.sin(np.arange(n) / 9)] for p, n in (("a", 300), ("b", 1), ("c", 77))}
    rows = spark.createDataFrame([(p, MONDAY + timedelta(hours=9 * i), v) for p, z in made.items() for i, v in enumerate(z)], "pair string, ts timestamp, z double").repartition(4)
    got = signals.envelope(rows, "z", 1.5, 0.5, 1.0, 9, length, span).toPandas().sort_values(["pair", "ts"])
    for p, z in made.items():
        assert got[got["pair"] == p]["signal"].tolist() == states(z, 1.5, 0.5, 1.0, 9)
