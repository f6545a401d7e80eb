"""Plug points: signals by name, and functions on pandas frames as signals.

A signal is a function from DataFrame to DataFrame that adds a column `signal`, for DataFrame.transform. Costs and sizes plug in as
functions of columns (operators/costs.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import chunks, indicators, signals

Signal = Callable[[DataFrame], DataFrame]
_MADE: dict[str, Callable[..., Signal]] = {}


def register(name: str) -> Callable:
    """Keeps a function of parameters that makes a signal; a name that is taken is an error."""
    def keep(make: Callable[..., Signal]) -> Callable[..., Signal]:
        if name in _MADE:
            raise ValueError(f"{name} is registered already")
        _MADE[name] = make
        return make

    return keep


def names() -> list[str]:
    return sorted(_MADE)


def signal(name: str, **params) -> Signal:
    """The registered signal of that name, for DataFrame.transform; an unknown one is an error."""
    if name not in _MADE:
        raise ValueError(f"unknown signal {name}; known: {', '.join(names())}")
    return _MADE[name](**params)


def pandas_signal(function: Callable, look_back: int, columns: tuple[str, ...] = ("close",), needs: tuple[str, ...] = (), out: str = "signal", length: int = chunks.ROWS) -> Signal:
    """A user's function on a pandas frame of consecutive bars of one series (ts and `columns`, in order of time), which returns a number a row,
    as a signal. It declares its look-back: how many bars before a row its number may hang on. needs: indicators by name to add first
    (indicators.by_names()); they are columns of the frame too.

    The function gets runs of `length` bars (or the look-back, if that is longer) with the look-back before them, so a task holds no whole series
    and a series of any length is shared out."""
    size = max(length, look_back, 1)

    def made(bars: DataFrame) -> DataFrame:
        rows = indicators.by_names(bars, list(needs)) if needs else bars
        held = chunks.numbered(rows.drop(out), "__i")
        own = F.floor(F.col("__i") / size)
        # a row also warms up the run after its own
        held = held.withColumn("__run", F.explode(F.when(F.col("__i") % size >= size - look_back, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__own", F.col("__run") == own)
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(out).schema] + [f"`{out}` double"])
        kept = [c for c in rows.columns if c != out]

        def run(pdf):
            pdf = pdf.sort_values("__i")
            values = function(pdf[["ts", *columns, *needs]].reset_index(drop=True))
            pdf[out] = [None if v is None else float(v) for v in values]
            return pdf.loc[pdf["__own"], [*kept, out]]

        return held.groupBy("pair", "__run").applyInPandas(run, schema)

    return made


def _built_in(name: str, function: Callable) -> None:
    _MADE[name] = lambda **params: lambda bars: function(bars, **params)


for _name, _function in {
    "sma_cross": signals.sma_cross, "momentum": signals.momentum_signal, "band_reversal": signals.band_reversal, "macd_cross": signals.macd_cross, "ema_cross": signals.ema_cross,
    "carry": signals.carry, "static_carry": signals.static_carry, "cross_sectional": signals.cross_sectional, "carry_momentum": signals.carry_momentum, "vol_target": signals.vol_target,
    "overnight_fade": signals.overnight_fade, "envelope": signals.envelope, "random": signals.random_signals,
}.items():
    _built_in(_name, _function)
