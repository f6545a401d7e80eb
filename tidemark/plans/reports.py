"""Registered queries of summaries beside the first ones: annual growth, exposure, weightings, bets, verdicts and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind, metrics, signals, simulate, statistics as stats
from tidemark.plans.decisions import SEASONAL, _seasonal
from tidemark.plans.market import BY, DAILY, HOURLY, POS, RET, SIMPLE, SQL, TRADES, _net, _rate_rows, _returns, _trades, full, r, register, rounded
from tidemark.plans.research import CORR, SHARPE
from tidemark.sources import files, tables
from tidemark.streaming import jobs

HELD = f", eq AS (SELECT pair, ts, 10000 / first_value(close) OVER {BY} * (close + 0.5 * (row_number() OVER {BY} - 1) - 20) AS equity FROM bars)"


@register("bt6_buy_and_hold_net", f"WITH {DAILY}{HELD} SELECT pair, ts, {r('equity', 'equity')} FROM eq")
def _(spark, sf):
    return rounded(simulate.buy_and_hold_net(tables.daily_bars(spark, sf), swap=0.5, cost=20.0))


@register("met1_annualised", f"""WITH {DAILY}{HELD}, e AS (SELECT pair, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total, greatest(date_diff('day', min(ts), max(ts)) / 365.25, 1e-6) AS years FROM eq GROUP BY pair)
  SELECT pair, {r('total', 'total')}, round(CASE WHEN total <= -1 THEN -1 ELSE power(1 + total, 1 / years) - 1 END, 6) AS annual FROM e""")
def _(spark, sf):
    return rounded(metrics.annualised(simulate.buy_and_hold_net(tables.daily_bars(spark, sf), swap=0.5, cost=20.0)))


@register("met4_exposure", f"""WITH {DAILY}, {POS}, {TRADES}, h AS (SELECT pair, sum(epoch(exit_time) - epoch(entry_time)) AS held FROM trades GROUP BY pair)
  SELECT pair, round(coalesce(any_value(held) / (max(epoch(ts)) - min(epoch(ts))), 0), 6) AS exposure FROM bars LEFT JOIN h USING (pair) GROUP BY pair""")
def _(spark, sf):
    return rounded(metrics.exposure_share(_trades(spark, sf), tables.daily_bars(spark, sf)))


@register("met8_fold_average", f"WITH f AS ({SQL['met8_purged_folds']}) SELECT pair, count(*) AS folds, round(sum(sharpe * n_test) / sum(n_test), 5) AS mean FROM f GROUP BY pair")
def _(spark, sf):
    folds = stats.purged_folds(_net(spark, sf), 5, 2, 4, 6).withColumn("sharpe", F.round("sharpe", 6))
    return rounded(metrics.fold_average(folds), 5)


@register("met9_consistency", f"WITH {DAILY}, {POS}, y AS (SELECT pair, year(ts) AS y, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 9) AS s FROM net GROUP BY ALL) SELECT pair, count(*) AS blocks, count_if(s > 0)::BIGINT AS positive FROM y GROUP BY pair")
def _(spark, sf):
    return metrics.regime_consistency(_net(spark, sf))


@register("met11_weightings", f"""WITH {HOURLY}{SIMPLE}, k AS (SELECT pair, ts, ret / 1000 AS ret FROM x), v AS (SELECT pair, least(1.0 / stddev_samp(ret), 5) AS w FROM k GROUP BY pair), b AS (SELECT 'volatility' AS weighting, ts, sum(w * ret) / sum(w) AS ret FROM k JOIN v USING (pair) GROUP BY ts UNION ALL SELECT 'equal', ts, avg(ret) FROM k GROUP BY ts),
  e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY weighting ORDER BY ts)) AS equity FROM b), d AS (SELECT *, max(equity) OVER (PARTITION BY weighting ORDER BY ts) AS peak FROM e)
  SELECT weighting, {SHARPE} AS sharpe, {r('max(greatest(0, 1 - equity / peak))', 'max_drawdown')} FROM d GROUP BY weighting""")
def _(spark, sf):
    return rounded(metrics.weighting_report(_returns(tables.hourly_bars(spark, sf)).withColumn("ret", F.col("ret") / 1000), 1.0))


@register("met17_independent_bets")
def _(spark, sf):
    return rounded(metrics.independent_bets(metrics.correlations(_returns(tables.hourly_bars(spark, sf)))))


@register("met18_volume_range", f"""WITH {HOURLY}, {SEASONAL}, q AS (SELECT pair, volume, high - low AS rng, round(relvol, 9) AS relvol, round(relrng, 9) AS relrng FROM n),
  k AS (SELECT *, {', '.join(f"rank() OVER (PARTITION BY pair ORDER BY {c}) + (count(*) OVER (PARTITION BY pair, {c}) - 1) / 2 AS r_{c}" for c in ('volume', 'rng', 'relvol', 'relrng'))} FROM q)
  SELECT pair, {r('corr(r_volume, r_rng)', 'raw')}, {r('corr(r_relvol, r_relrng)', 'relative')}, {r('power(corr(ln(1 + relvol), ln(1 + relrng)), 2)', 'r2_log')} FROM k GROUP BY pair""")
def _(spark, sf):
    rows = _seasonal(spark, sf).withColumns({c: F.round(c, 9) for c in ("relvol", "relrng")})
    return rounded(metrics.volume_range(rows))


@register("met20_screen_verdict", f"""WITH t AS ({SQL['bt9_reversion_trades']}), s AS (SELECT pair, count(*) AS trades, avg(gross / 1000) / avg(cost) AS ratio, (max(epoch(ts)) - min(epoch(ts))) / (365.25 * 86400) AS years FROM t GROUP BY pair)
  SELECT pair, trades, round(ratio, 4) AS ratio, CASE WHEN round(ratio, 9) <= 0.8 THEN 'FAIL' WHEN round(ratio, 9) <= 1 THEN 'STRETCH' WHEN ratio IS NOT NULL THEN 'PASS' END AS verdict, round(trades / nullif(years, 0), 4) AS fires_per_year FROM s""")
def _(spark, sf):
    trades = simulate.reversion_trades(_seasonal(spark, sf), least_volume=1.1, tight=0.6, extension=0.5)
    trades = trades.withColumns({"gross": F.round("gross", 2) / 1000, "cost": F.round("cost", 6)})
    return rounded(metrics.screen_verdict(trades), 4)


@register("met21_power_gate", f"""WITH {DAILY}, {POS}, {TRADES}, nn AS (SELECT pair, count(*) AS n FROM trades GROUP BY pair), g AS (SELECT pair, coalesce(any_value(nn.n), 0) / greatest(date_diff('day', min(ts), max(ts)), 1) AS p FROM bars LEFT JOIN nn USING (pair) GROUP BY pair)
  SELECT pair, {r('p', 'per_day')}, {r('p * 90', 'expected')}, round(p * 90, 9) >= 15 AS enough FROM g""")
def _(spark, sf):
    return rounded(metrics.power_gate(_trades(spark, sf), tables.daily_bars(spark, sf), 90, 15))


@register("bt15_side_totals", f"WITH {DAILY}, {POS}, {TRADES} SELECT pair, direction, count(*) AS trades, round(sum(pnl_pips), 1) AS pips FROM trades GROUP BY pair, direction")
def _(spark, sf):
    return metrics.side_totals(_trades(spark, sf)).withColumn("pips", F.round("pips", 1))


@register("led7_sharpe_clause", f"""WITH {DAILY}{RET}, s AS (SELECT pair, ts, round(CASE WHEN {full('stddev_samp', 'r', 60)} > 0 THEN {full('avg', 'r', 60)} / {full('stddev_samp', 'r', 60)} * sqrt(252) END, 9) AS v, row_number() OVER (PARTITION BY pair ORDER BY ts DESC) AS n FROM t)
  SELECT pair, coalesce(bool_or(v < 0.2), false) AS met, {r('min(v)', 'lowest')}, count_if(v < 0.2)::BIGINT AS below FROM s WHERE n <= 90 GROUP BY pair""")
def _(spark, sf):
    return rounded(metrics.low_sharpe_clause(ind.rolling_sharpe(tables.daily_bars(spark, sf))))


@register("flt1_holdout_trades", f"WITH {DAILY}, {POS}, {TRADES} SELECT pair, direction, entry_time, exit_time FROM trades WHERE entry_time >= TIMESTAMP '1997-01-01'")
def _(spark, sf):
    return files.holdout(_trades(spark, sf), "1997-01-01", "entry_time", after=True).select("pair", "direction", "entry_time", "exit_time")


@register("sig6_static_carry", f"WITH {DAILY} SELECT pair, ts, CASE WHEN hour(ts) + day(ts) % 3 - 1 > 0 THEN 1 WHEN day(ts) % 3 = 0 THEN -1 ELSE 0 END::DOUBLE AS signal FROM bars")
def _(spark, sf):
    rows = tables.daily_bars(spark, sf).withColumns({"long": F.dayofmonth("ts") % 3 - 1, "short": 1 - F.dayofmonth("ts") % 3})
    return signals.static_carry(rows, "long", "short").select("pair", "ts", "signal")


@register("sig7_raw_carry", f"WITH {HOURLY}{SIMPLE} SELECT pair, ts, round(CASE WHEN abs(ret) >= 0.1 THEN greatest(-1, least(1, ret / 2)) ELSE 0 END, 6)::DOUBLE AS signal FROM x")
def _(spark, sf):
    return rounded(signals.cross_sectional(_returns(tables.hourly_bars(spark, sf)), "ret", 0.1, raw=2.0).select("pair", "ts", "signal"))


VOL = f"(({full('stddev_samp', 'r', 20)}) * sqrt(252))"


@register("sig9_ablations", f"""WITH {DAILY}{RET}, v AS (SELECT *, {VOL} AS vol, day(ts) % 2 - 0.5 AS diff FROM t), l AS (SELECT *, lag(vol, 5) OVER {BY} AS vol5 FROM v) SELECT pair, ts, (vol > 0)::INT::DOUBLE AS constant,
  round(CASE WHEN vol > 0 AND diff > 0 THEN greatest(0, least(2, 4 / vol)) / 2 ELSE 0 END, 6)::DOUBLE AS filtered, round(CASE WHEN vol5 > 0 THEN greatest(0, least(2, 4 / vol5)) / 2 ELSE 0 END, 6)::DOUBLE AS delayed FROM l""".replace("(vol > 0)::INT::DOUBLE", "coalesce(vol > 0, false)::INT::DOUBLE"))
def _(spark, sf):
    rows = tables.daily_bars(spark, sf).withColumn("diff", F.dayofmonth("ts") % 2 - 0.5)
    out = rows.select("pair", "ts")
    for name, args in (("constant", {"scaled": False}), ("filtered", {"carry_diff": "diff"}), ("delayed", {"lag": 5})):
        out = out.join(signals.vol_target(rows, 4.0, **args).select("pair", "ts", F.col("signal").alias(name)), ["pair", "ts"])
    return rounded(out)


@register("str8_swap_in_quote", f"WITH {DAILY} SELECT pair, ts, round(coalesce((epoch(ts) - epoch(lag(ts) OVER {BY})) / 86400 * 0.25 * lag(volume) OVER {BY} / CASE WHEN ends_with(pair, 'LOW') THEN close / 1000 ELSE 1 END, 0), 6) AS accrued FROM bars")
def _(spark, sf):
    rows = tables.daily_bars(spark, sf).withColumns({"held": F.col("volume"), "price": F.col("close") / 1000})
    return rounded(jobs.swap_accrual(rows, 0.25, "LOW", "price").select("pair", "ts", "accrued"))
