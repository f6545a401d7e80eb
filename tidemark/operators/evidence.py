"""Evidence that a result is not luck: block lengths, reality checks, deflated Sharpe ratios, event studies and their verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.operators.metrics import newey_west

# ---- the normal distribution as arithmetic: Spark has no erf ---------------------------------------------------------------------

# Coefficients of Hart's rational approximation of the normal distribution, highest power first.
_HART_UP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_HART_DOWN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# Coefficients of Acklam's rational approximation of the normal quantile.
_ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239]
_ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277671838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]
_EULER = 0.5772156649015329


def _polynomial(coefficients: list[float], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def cdf_sql(x: str) -> str:
    """Normal distribution function of an SQL name or number, good to about 1e-14."""
    tail = f"(CASE WHEN abs({x}) > 37 THEN 0 WHEN abs({x}) < 7.07 THEN exp(-{x} * {x} / 2) * {_polynomial(_HART_UP, f'abs({x})')} / {_polynomial(_HART_DOWN, f'abs({x})')}"
    far = f"(abs({x}) + 1 / (abs({x}) + 2 / (abs({x}) + 3 / (abs({x}) + 4 / (abs({x}) + 0.65)))))"
    tail += f" ELSE exp(-{x} * {x} / 2) / {far} / 2.506628274631 END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def quantile_sql(p: str) -> str:
    """Normal quantile of an SQL name or number in (0, 1), good to about 1e-9."""
    def low(q: str, sign: str) -> str:
        return f"{sign}{_polynomial(_ACKLAM_C, q)} / {_polynomial(_ACKLAM_D, q)}"

    middle = f"({p} - 0.5) * {_polynomial(_ACKLAM_A, f'(({p} - 0.5) * ({p} - 0.5))')} / {_polynomial(_ACKLAM_B, f'(({p} - 0.5) * ({p} - 0.5))')}"
    return f"(CASE WHEN {p} < 0.02425 THEN {low(f'sqrt(-2 * ln({p}))', '')} WHEN {p} > 0.97575 THEN {low(f'sqrt(-2 * ln(1 - {p}))', '-')} ELSE {middle} END)"


def expected_max_sql(trials: str) -> str:
    """Expected greatest of so many standard normal draws; 0 for one."""
    first = f"greatest(least(1 - 1.0 / {trials}, 1 - 1e-9), 1e-9)"
    second = f"greatest(least(1 - 1.0 / ({trials} * {math.e!r}), 1 - 1e-9), 1e-9)"
    return f"(CASE WHEN {trials} <= 1 THEN 0 ELSE greatest((1 - {_EULER!r}) * {quantile_sql(f'({first})')} + {_EULER!r} * {quantile_sql(f'({second})')}, 0) END)"


def deflated_sql(sharpe: str, n: str, skew: str, kurt: str, best: str, per_year: float) -> tuple[str, str]:
    """(z, whether it stands) of a deflated Sharpe ratio from an annual Sharpe, n returns, their skewness and excess kurtosis, and the
    expected greatest of the trials in standard deviations."""
    s = f"({sharpe} / sqrt(CAST({per_year!r} AS DOUBLE)))"
    var = f"(1 - {skew} * {s} + ({kurt} + 2) / 4 * {s} * {s})"
    return f"(({s} - {best} / sqrt({n} - 1.0)) * sqrt({n} - 1.0) / sqrt({var}))", f"({sharpe} > 0 AND {var} > 0)"


def expected_max_sharpe(rows: DataFrame, trials: str = "trials", n: str = "n", out: str = "expected_max") -> DataFrame:
    """rows with the expected greatest Sharpe per observation of so many trials of n observations; 0 for one trial or observation."""
    best = F.expr(expected_max_sql(trials))
    return rows.withColumn(out, F.when((F.col(trials) >= 1) & (F.col(n) > 1), best / F.sqrt(F.col(n) - 1.0)).otherwise(0.0))


def deflated_sharpe(rows: DataFrame, per_year: float = 252.0, out: str = "dsr") -> DataFrame:
    """rows (sharpe, n, skew, kurt, trials) with the probability that the true Sharpe is over the expected greatest of the trials: 0 for a
    Sharpe of 0 or less, or where the variance of the estimate is not positive; null with fewer than 2 observations or no trial."""
    z, stands = deflated_sql("sharpe", "n", "skew", "kurt", "__best", per_year)
    rows = rows.withColumn("__best", F.expr(expected_max_sql("trials"))).withColumn("__z", F.when(F.expr(stands) & (F.col("n") > 1), F.expr(z)))
    p = F.when((F.col("n") > 1) & (F.col("trials") >= 1), F.when(F.col("__z").isNotNull(), F.expr(cdf_sql("__z"))).otherwise(0.0))
    return rows.withColumn(out, p).drop("__best", "__z")


#: Benchmarks per observation of the best of a family of cells, and of the pooled event series.
CELL_BENCHMARK, EVENT_BENCHMARK = 0.022906, 0.026861


def deflated_against(rows: DataFrame, benchmark: float, per_year: float = 252.0, out: str = "dsr") -> DataFrame:
    """rows (sharpe, n, skew, kurt) with the probability that the true Sharpe is over a benchmark that was fixed before, per observation; 0 and
    null as in deflated_sharpe()."""
    z, stands = deflated_sql("sharpe", "n", "skew", "kurt", f"(CAST({benchmark!r} AS DOUBLE) * sqrt(n - 1.0))", per_year)
    rows = rows.withColumn("__z", F.when(F.expr(stands) & (F.col("n") > 1), F.expr(z)))
    return rows.withColumn(out, F.when(F.col("n") > 1, F.when(F.col("__z").isNotNull(), F.expr(cdf_sql("__z"))).otherwise(0.0))).drop("__z")


def moments(returns: DataFrame, key: str, x: str = "ret") -> DataFrame:
    """(key, n, skew, kurt): biased skewness and excess kurtosis."""
    return returns.where(F.col(x).isNotNull()).groupBy(key).agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def recompute_deflated(trials: DataFrame, equity: DataFrame, retained: list[str], per_year: float = 252.0) -> DataFrame:
    """(trial_id, sharpe, n, skew, kurt, dsr, state) of every retained trial (trial_id, status, sharpe, trials: how many there were) from its
    equity (trial_id, ts, equity). state: ok, or what is missing: blocked-no-sharpe, blocked-no-equity-series, or compute-error for a series
    without two returns."""
    w = W.partitionBy("trial_id").orderBy("ts")
    returns = equity.withColumn("ret", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    known = equity.select("trial_id").distinct().withColumn("has", F.lit(True))
    rows = trials.where(F.col("status").isin(*retained)).join(known, "trial_id", "left").join(moments(returns, "trial_id"), "trial_id", "left")
    state = F.when(F.col("sharpe").isNull(), "blocked-no-sharpe").when(F.col("has").isNull(), "blocked-no-equity-series").when(F.coalesce("n", F.lit(0)) < 2, "compute-error").otherwise("ok")
    rows = deflated_sharpe(rows.withColumn("state", state), per_year)
    ok = F.col("state") == "ok"
    return rows.select("trial_id", "sharpe", *[F.when(ok, F.col(c)).alias(c) for c in ("n", "skew", "kurt", "dsr")], "state")


def adjusted_null_p(nulls: DataFrame, trials: int) -> DataFrame:
    """rows (.., sharpe, null_mean, null_std) with p_adjusted: the chance of the Sharpe against the expected greatest of so many null draws."""
    best = F.expr(expected_max_sql(str(float(trials)))) if trials > 1 else F.lit(0.0)
    rows = nulls.withColumn("__z", (F.col("sharpe") - F.col("null_mean") - F.col("null_std") * best) / F.nullif("null_std", F.lit(0.0)))
    flat = F.when(F.col("sharpe") > F.col("null_mean"), 0.0).otherwise(1.0)
    return rows.withColumn("p_adjusted", F.when(F.col("null_std") < 1e-10, flat).otherwise(1 - F.expr(cdf_sql("__z")))).drop("__z")


# ---- reality check ---------------------------------------------------------------------------------------------------


def best_by_studentised_mean(rows: DataFrame, length: int, x: str = "ret", bars_per_year: float = 252.0) -> DataFrame:
    """(pair, t, sharpe): of all series, the one with the greatest root(n) * mean over its Newey-West error; of equals the first name."""
    cells = newey_west(rows, x, max(length - 1, 1)).withColumn("t", F.sqrt("n") * F.col("mean") / F.greatest("se", F.lit(1e-12)))
    std = rows.groupBy("pair").agg(F.stddev_samp(x).alias("s"))
    cells = cells.join(std, "pair").withColumn("sharpe", F.when(F.col("s") > 0, F.col("mean") / F.col("s") * bars_per_year**0.5).otherwise(0.0))
    return cells.agg(F.min(F.struct((-F.round("t", 9)).alias("o"), "pair", "t", "sharpe")).alias("b")).select("b.pair", "b.t", "b.sharpe")


def combined_verdict(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """rows (p, flips, percentile, median_sharpe, p_consistent) with a verdict for each test and `verdict`: INCONCLUSIVE if any is, else FAIL if
    any is, else PASS."""
    a = F.when(F.col("flips"), "INCONCLUSIVE").when(F.col("p") > alpha, "FAIL").otherwise("PASS")
    b = F.when(F.col("percentile") >= 0.90, "FAIL").when((F.col("percentile") <= 0.75) & (F.col("median_sharpe") >= 0.30), "PASS").otherwise("INCONCLUSIVE")
    c = F.when(F.col("p_consistent") > alpha, "FAIL").otherwise("PASS")
    rows = rows.withColumns({"zero_mean": a, "placement": b, "reality": c})
    parts = F.array("zero_mean", "placement", "reality")
    return rows.withColumn("verdict", F.when(F.array_contains(parts, "INCONCLUSIVE"), "INCONCLUSIVE").when(F.array_contains(parts, "FAIL"), "FAIL").otherwise("PASS"))


# ---- event studies -----------------------------------------------------------------------------------------------------------------


def event_bars(bars: DataFrame, events: DataFrame, x: str = "close", also: tuple[str, ...] = ()) -> DataFrame:
    """events (pair, ts, ..) with the first bar at or after them: bar_ts, and x of that bar (d0), the one before (before) and the next two (d1,
    d2), and its columns `also`; null where there is none."""
    from tidemark.operators.joins import asof

    w = W.partitionBy("pair").orderBy("ts")
    around = F.struct(F.col("ts").alias("bar_ts"), F.lag(x).over(w).alias("before"), F.col(x).alias("d0"), F.lead(x).over(w).alias("d1"), F.lead(x, 2).over(w).alias("d2"), *also)
    return asof(events, bars.select("pair", "ts", around.alias("b")), "b", forward=True).select("*", "b.*").drop("b")


def event_returns(events: DataFrame, members: DataFrame, bars: DataFrame, cost: str, suppressed: str) -> DataFrame:
    """(bank, ts, direction, mean, y) of events (bank, ts) whose bank has members (bank, pair, reference: true for one). direction: sign of the
    event bar against the bar before, on the reference; mean: over the members whose bar is not `suppressed` of the move from the event
    bar to the second after it, as a share, less `cost` of its bar as a share; y = direction * mean. Events without a move on the
    reference, or without a member that counts, are left out."""
    asked = events.join(members, "bank").select("pair", "ts", "bank", "reference")
    marked = bars.withColumns({"__cost": F.col(cost), "__off": F.col(suppressed)})
    found = event_bars(marked, asked, also=("__cost", "__off"))
    counts = ~F.coalesce("__off", F.lit(True)) & F.col("d2").isNotNull()
    grouped = found.groupBy("bank", "ts").agg(
        F.max(F.when(F.col("reference"), F.signum(F.round(F.col("d0") - F.col("before"), 9)))).alias("direction"), F.avg(F.when(counts, F.col("d2") / F.col("d0") - 1 - F.col("__cost"))).alias("mean")
    )
    return grouped.where("direction <> 0 and mean is not null").withColumn("y", F.col("direction") * F.col("mean"))


def decide(rows: DataFrame, kill: float = 0.0422, reject: float = 0.0378, least_dsr: float = 0.95) -> DataFrame:
    """rows (failure, p_late, p_all, dsr) with `rule`: the first of technical failure, late p over `kill`, whole p over `kill`, both under
    `reject` with a deflated Sharpe of `least_dsr`; else ambiguous."""
    clean = (F.col("p_late") < reject) & (F.col("p_all") < reject) & (F.col("dsr") >= least_dsr)
    rule = F.when(F.col("failure"), "RULE_0_TECHNICAL_FAILURE").when(F.col("p_late") > kill, "RULE_1_KILL_POST2015").when(F.col("p_all") > kill, "RULE_2_KILL_AGGREGATE")
    return rows.withColumn("rule", rule.when(clean, "RULE_3_PASS").otherwise("RULE_4_AMBIGUOUS"))
