"""Grids of trials, resampling and decision rules."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.operators.indicators import by_ts, sma
from tidemark.operators.signals import sign


def uniform(*parts: Column) -> Column:
    """[0, 1) from the md5 of the parts, so that neither partitioning nor engine changes it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def draws(rows: DataFrame, n: int) -> DataFrame:
    """Each series n times, as series `pair#draw`."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pair", F.concat_ws("#", "pair", "draw"))


def sma_grid(bars: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    """Each series once for each (fast, slow), as series `pair#fast-slow` with its signal; the means share one pass."""
    made = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("cell"), sign(sma("close", a) - sma("close", b)).alias("signal")) for a, b in cells))
    rows = bars.withColumn("made", made).select("*", F.inline("made")).drop("made")
    return rows.withColumn("pair", F.concat_ws("#", "pair", "cell"))


def sharpe(x: str = "ret", bars_per_year: float = 252.0) -> Column:
    return F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * bars_per_year**0.5).otherwise(0.0)


def best_cell(cells: DataFrame, key: list[str], score: str, name: str) -> DataFrame:
    """The best cell of each key; of equal scores the last name."""
    top = cells.groupBy(*key).agg(F.max(F.struct(score, name)).alias("t"), F.count("*").alias("cells"))
    return top.select(*key, f"t.{name}", f"t.{score}", "cells")


def null_rank(candidate: DataFrame, nulls: DataFrame) -> DataFrame:
    """(pair, sharpe, draws, rank, null_mean, null_std): share of null Sharpes below the candidate's, and their moments."""
    rows = nulls.withColumnRenamed("sharpe", "null_sharpe").join(candidate, "pair")
    return rows.groupBy("pair", "sharpe").agg(F.count("*").alias("draws"), F.avg((F.col("null_sharpe") < F.col("sharpe")).cast("double")).alias("rank"), F.avg("null_sharpe").alias("null_mean"), F.stddev_pop("null_sharpe").alias("null_std"))


def stationary_bootstrap(rows: DataFrame, n: int, length: float, seed: int = 1) -> DataFrame:
    """(pair, draw, mean): means of n circular resamples of `ret` in blocks of geometric length. A position restarts with probability
    1/length at a uniform index, else goes on from the one before."""
    num = rows.where("ret is not null").select("pair", "ret", (F.row_number().over(by_ts()) - 1).alias("t"))
    size = num.groupBy("pair").agg(F.count("*").alias("size"))
    d = num.select("pair", "t").join(size, "pair").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def u(tag: str) -> Column:
        return uniform(F.lit(f"{seed}|{tag}"), "pair", F.col("draw").cast("string"), F.col("t").cast("string"))

    start = F.when((F.col("t") == 0) | (u("r") < 1 / length), F.struct("t", F.floor(u("i") * F.col("size")).alias("i")))
    w = W.partitionBy("pair", "draw").orderBy("t")
    d = d.withColumn("s", F.last(start, True).over(w)).withColumn("at", F.pmod(F.col("s.i") + F.col("t") - F.col("s.t"), F.col("size")))
    picked = d.select("pair", "draw", F.col("at").cast("int").alias("t")).join(num, ["pair", "t"])
    return picked.groupBy("pair", "draw").agg(F.avg("ret").alias("mean"))


def bootstrap_p(rows: DataFrame, n: int, length: float) -> DataFrame:
    """(pair, mean, p): share of resampled means, recentred at zero, of at least the observed mean."""
    seen = rows.groupBy("pair").agg(F.avg("ret").alias("observed"))
    r = stationary_bootstrap(rows, n, length).join(seen, "pair")
    return r.groupBy("pair", "observed").agg(F.avg((F.round(F.col("mean") - 2 * F.col("observed"), 12) >= 0).cast("double")).alias("p")).withColumnRenamed("observed", "mean")


CHUNK = 250


def resampled(restart: np.ndarray, start: np.ndarray, length: float) -> np.ndarray:
    """Row numbers of one circular resample from two uniforms a position, in the form of stationary_bootstrap()."""
    t = np.arange(len(restart))
    new = restart < 1 / length
    new[:1] = True
    block = np.maximum.accumulate(np.where(new, t, 0))
    return (np.floor(start[block] * len(t)).astype(np.int64) + t - block) % len(t)


def block_length(x: np.ndarray) -> float:
    """Automatic block length of the stationary bootstrap: the autocovariances up to twice the last significant lag, under a flat-top
    window, give the curvature and level of the spectrum at 0, and the length goes with the cube root of their ratio. A lag is
    insignificant where it starts a run of K lags under the threshold. 1 for a constant series; capped at a share of its size."""
    n = len(x)
    e = x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(e, size)
    cov = np.fft.irfft(spectrum * np.conj(spectrum), size)[:n] / n
    if cov[0] < 1e-14:
        return 1.0
    run = max(5, math.ceil(math.log10(n)))
    small = np.abs(cov[1:]) / cov[0] < 1.959963984540054 * math.sqrt(math.log10(n) / n)
    runs = np.flatnonzero(np.convolve(small, np.ones(run), "valid") == run) if len(small) >= run else np.zeros(0, int)
    last = max(1, int(runs[0])) if len(runs) else n - 1  # the run starts at lag runs[0] + 1
    m = min(2 * last, math.ceil(math.sqrt(n)) + run, n - 1)
    lag = np.arange(1, m + 1)
    window = np.where(lag / m < 0.5, 1.0, 2 * (1 - lag / m))
    level, curve = cov[0] + 2 * (window * cov[1 : m + 1]).sum(), 2 * (window * lag * cov[1 : m + 1]).sum()
    found = 1.0 if 2 * level**2 < 1e-28 or abs(curve) < 1e-28 else (curve**2 / level**2) ** (1 / 3) * n ** (1 / 3)
    return float(min(max(found, 1.0), math.ceil(min(3 * math.sqrt(n), n / 3))))


def series_arrays(rows: DataFrame, x: str = "ret", key: str = "pair") -> DataFrame:
    """(pair, x): each series in time order as one array, its own length being all that one task holds."""
    listed = F.array_sort(F.collect_list(F.struct("ts", x)))
    return rows.where(F.col(x).isNotNull()).groupBy(key).agg(F.transform(listed, lambda r: r[x]).alias("x"))


def block_lengths(rows: DataFrame, x: str = "ret") -> DataFrame:
    """(pair, n, length) of every series with 2 values at least."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            xs = [np.asarray(v.values, float) for v in batch["x"]]
            yield pa.RecordBatch.from_arrays([batch["pair"], pa.array([len(v) for v in xs], pa.int64()), pa.array([block_length(v) for v in xs])], names=["pair", "n", "length"])

    return series_arrays(rows, x).where(F.size("x") > 1).mapInArrow(run, "pair string, n bigint, length double")


def sharpe_of(x: np.ndarray, bars_per_year: float = 252.0) -> float:
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(x.mean() / s * bars_per_year**0.5) if s > 0 else 0.0


def bootstrap_draws(rows: DataFrame, n: int, tests: list[tuple[str, float | None]], seed: int = 1) -> DataFrame:
    """(pair, test, length, draw, mean, null_sharpe) of n stationary resamples of `ret` for each (test, block length): the mean, and the Sharpe
    of the resampled series less the mean of the whole one. A length of None is each series' own automatic one, rounded up, from a
    joined table. A series travels as one array to tasks of CHUNK draws each, and only statistics leave them. Every draw has its own
    generator, seeded by series, test and draw, so that partitioning does not change it."""
    given = F.array(*(F.struct(F.lit(t).alias("test"), F.lit(None if length is None else float(length)).cast("double").alias("length")) for t, length in tests))
    chunks = -(-n // CHUNK)
    series = series_arrays(rows)
    if any(length is None for _, length in tests):
        own = block_lengths(rows).select("pair", F.greatest(F.lit(1.0), F.ceil("length").cast("double")).alias("own"))
        series = series.join(own, "pair", "left")
    else:
        series = series.withColumn("own", F.lit(1.0))
    d = series.select("pair", "x", "own", F.inline(given)).withColumn("length", F.coalesce("length", "own", F.lit(1.0))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    d = d.repartition(max(1, len(tests) * chunks), "pair", "test", "chunk")
    columns = ["pair", "test", "length", "draw", "mean", "null_sharpe"]

    def run(batches):
        for batch in batches:
            for pair, test, length, chunk, values in zip(*(batch[c].to_pylist() for c in ("pair", "test", "length", "chunk")), batch["x"]):
                x = np.asarray(values.values, float)
                mean, out = x.mean(), []
                for draw in range(chunk * CHUNK, min(n, (chunk + 1) * CHUNK)):
                    key = hashlib.md5(f"{seed}|{test}|{pair}|{draw}".encode()).digest()
                    u = np.random.Generator(np.random.PCG64(int.from_bytes(key))).random((2, len(x)))
                    y = x[resampled(u[0], u[1], length)]
                    out.append((pair, test, length, draw, float(y.mean()), sharpe_of(y - mean)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=columns)

    return d.mapInArrow(run, "pair string, test string, length double, draw bigint, mean double, null_sharpe double")


def zero_mean_test(rows: DataFrame, n: int, length: float | None = None, others: tuple[int, ...] = (5, 10, 20), alpha: float = 0.05) -> DataFrame:
    """(pair, sharpe, length, draws, p, p5, p10, p20, flips): p = (1 + null Sharpes of at least the observed one) / (n + 1) at the given block
    length (None: the series' own automatic one) and, drawn anew, at the others; `flips` where one of those gives the other verdict at
    alpha."""
    tests = [("p", length), *((f"p{k}", float(k)) for k in others)]
    seen = rows.where("ret is not null").groupBy("pair").agg(sharpe().alias("sharpe"))
    r = bootstrap_draws(rows, n, tests).join(seen, "pair")
    p = [((1 + F.count_if((F.col("test") == t) & (F.col("null_sharpe") >= F.col("sharpe")))) / (n + 1)).alias(t) for t, _ in tests]
    main = F.max(F.when(F.col("test") == "p", F.col("length"))).alias("length")
    out = r.groupBy("pair", "sharpe").agg(main, F.count_if(F.col("test") == "p").alias("draws"), *p)
    flips = F.lit(False)
    for t, _ in tests[1:]:
        flips = flips | ((F.col(t) > alpha) != (F.col("p") > alpha))
    return out.withColumn("flips", flips)


def walk_forward(rows: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(pair, window, n, sharpe): test rows of each rolling window, by bar number; only whole windows count."""
    num = rows.withColumn("i", F.row_number().over(by_ts()) - 1 - train).where("i >= 0")
    last, first = F.floor(F.col("i") / step), F.greatest(F.lit(0), F.ceil((F.col("i") - test + 1) / step))
    num = num.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    return num.groupBy("pair", "window").agg(F.count("*").alias("n"), sharpe().alias("sharpe")).where(F.col("n") == test)


def purged_folds(rows: DataFrame, groups: int, tests: int, purge: int, embargo: int) -> DataFrame:
    """(pair, fold, n_train, n_test, sharpe) of every choice of test groups. Rows up to `purge` before and `embargo` after a test group
    do not train; purge and embargo are shorter than a group."""
    num = rows.withColumn("i", F.row_number().over(by_ts()) - 1).join(rows.groupBy("pair").agg(F.count("*").alias("size")), "pair")

    def group(i: Column) -> Column:
        return F.floor(F.greatest(F.lit(0), F.least(F.col("size") - 1, i)) * groups / F.col("size")).cast("int")

    folds = F.array(*(F.struct(F.lit("-".join(map(str, c))).alias("fold"), F.array(*map(F.lit, c)).alias("held")) for c in combinations(range(groups), tests)))
    num = num.withColumn("folds", folds).select("*", F.inline("folds"))
    test = F.array_contains("held", group(F.col("i")))
    near = F.array_contains("held", group(F.col("i") + purge)) | F.array_contains("held", group(F.col("i") - embargo))
    num = num.withColumns({"test": test, "train": ~test & ~near, "x": F.when(test, F.col("ret"))})
    return num.groupBy("pair", "fold").agg(F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"), sharpe("x").alias("sharpe"))


def against_benchmark(rows: DataFrame, bench: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(pair, windows, wins, mean_delta): rolling windows of both return tables (pair, ts, ret); a win is a greater Sharpe in the window."""
    own = walk_forward(rows, train, test, step).select("pair", "window", F.round("sharpe", 9).alias("x"))
    both = own.join(walk_forward(bench, train, test, step).select("pair", "window", F.round("sharpe", 9).alias("y")), ["pair", "window"])
    return both.groupBy("pair").agg(F.count("*").alias("windows"), F.avg((F.col("x") > F.col("y")).cast("double")).alias("wins"), F.avg(F.col("x") - F.col("y")).alias("mean_delta"))


def triggers(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(label, metric, value, fired, named) of every rule (label, metric, operator, threshold[, priority]) for a metrics table in long form.
    named: the fired rule of the least priority (of equals the first label). A rule whose metric is missing fires nothing here; see
    evaluate()."""
    if "priority" not in rules.columns:
        rules = rules.withColumn("priority", F.lit(0))
    r = rules.join(metrics, "metric", "left")
    fired = F.when(F.col("operator") == ">", F.col("value") > F.col("threshold")).when(F.col("operator") == ">=", F.col("value") >= F.col("threshold"))
    fired = fired.when(F.col("operator") == "<", F.col("value") < F.col("threshold")).when(F.col("operator") == "<=", F.col("value") <= F.col("threshold"))
    r = r.withColumn("fired", fired)
    first = r.where("fired").agg(F.min(F.struct("priority", "label")).alias("f")).select("f.label")  # one row
    named = r.join(F.broadcast(first.select(F.col("label").alias("n"))), F.col("label") == F.col("n"), "left")
    return named.select("label", "metric", "value", "fired", F.col("n").isNotNull().alias("named"))


def evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """triggers(), and an error for rules whose metric is missing."""
    lacking = [r["metric"] for r in rules.join(metrics.where("value is not null"), "metric", "left_anti").select("metric").distinct().limit(5).collect()]
    if lacking:
        raise ValueError(f"metrics that rules ask for are missing: {lacking}")
    return triggers(metrics, rules)
