"""Registered queries of drift trades, carry holds, stress grids, warmed walk-forward windows and ladders put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import strategies
from tidemark.operators import events, evidence, indicators as ind, joins, metrics, signals, simulate, statistics as stats, walkforward
from tidemark.plans.decisions import MOMENTS, PRICED, SEASONAL, _seasonal
from tidemark.plans.market import BY, DAILY, HOURLY, OWN_RATES, POS, RATES, SIMPLE, SMA_SIGNAL, TR, TRADES, _net, _rate_rows, _returns, _trades, full, r, register, rounded
from tidemark.plans.research import SHARPE, md5u
from tidemark.sources import files, tables
from tidemark.streaming import jobs

# ---- drift trades ------------------------------------------------------------------------------------------------------------------

PAST48 = "(PARTITION BY pair ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)"
DRIFT = f"""t AS (SELECT *, {TR} AS tr, date_trunc('day', ts) AS day, row_number() OVER {BY} AS i FROM bars),
  u AS (SELECT *, CASE WHEN count(tr) OVER {PAST48} = 48 THEN quantile_cont(tr, 0.5) OVER {PAST48} END AS usual, {full('avg', 'tr', 14)} AS atr, sign(close - open) AS move FROM t),
  an AS (SELECT pair, day, ts, i, tr, usual, move FROM u WHERE day(day) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY pair, day ORDER BY tr DESC, ts) = 1),
  en AS (SELECT a.pair, a.day, a.ts AS bar_ts, a.move, e.i, e.ts AS entry_ts, e.open AS eo, e.spread_median_pips AS es, e.open - a.move * e.atr * 1.0 AS level FROM an a JOIN u e ON e.pair = a.pair AND e.i = a.i + 1
  WHERE a.usual > 0 AND a.tr > a.usual * 1.1 AND a.move <> 0 AND e.spread_median_pips > 0),
  af AS (SELECT en.pair, en.day, u.i, CASE WHEN en.move > 0 THEN u.low < level ELSE u.high > level END AS hit FROM en JOIN u ON u.pair = en.pair AND u.i BETWEEN en.i + 1 AND en.i + 6),
  ex AS (SELECT pair, day, min(CASE WHEN hit THEN i END) AS h, max(i) AS z, count(*) AS n FROM af GROUP BY ALL),
  dr AS (SELECT en.pair, en.day, bar_ts, entry_ts, x.ts AS exit_ts, en.move AS direction, CASE WHEN h IS NOT NULL THEN 'stop' WHEN coalesce(n, 0) = 6 THEN 'hold' ELSE 'end_of_data' END AS reason,
  en.move * (x.close - eo) / 0.0001 AS gross, es + x.spread_median_pips + 0.8 AS cost FROM en LEFT JOIN ex USING (pair, day) JOIN u x ON x.pair = en.pair AND x.i = coalesce(h, z, en.i) WHERE x.spread_median_pips > 0)"""


def _drift(spark, sf):
    bars = tables.hourly_bars(spark, sf)
    days = bars.select("pair", F.date_trunc("day", "ts").alias("day")).where(F.dayofmonth("day") % 2 == 0)
    return events.drift_trades(bars, days, hold=6, surprise=1.1, trailing=48, stop=1.0)


@register("bt10_drift_trades", f"WITH {HOURLY}, {DRIFT} SELECT pair, day, bar_ts, entry_ts, exit_ts, direction, reason, {r('gross', 'gross', 2)}, {r('cost', 'cost')}, {r('gross - cost', 'net', 2)} FROM dr")
def _(spark, sf):
    return _drift(spark, sf).withColumns({"gross": F.round("gross", 2), "cost": F.round("cost", 6), "net": F.round("net", 2)})


@register("bt10_drift_verdict", f"""WITH {HOURLY}, {DRIFT}, s AS (SELECT pair, count(*) AS fires, avg(gross) AS gross, avg(cost) AS cost, stddev_samp(gross) AS spread, count_if(reason = 'stop') AS stops FROM dr GROUP BY pair)
  SELECT pair, fires, {r('gross', 'gross', 2)}, {r('cost', 'cost')}, {r('gross - cost', 'margin', 2)}, {r('spread', 'spread', 2)}, stops, CASE WHEN fires < 3 OR gross <= 1.12 THEN 'FAIL' WHEN gross <= 1.12 / 0.8 THEN 'STRETCH' ELSE 'PASS' END AS verdict FROM s""")
def _(spark, sf):
    rows = events.drift_verdict(_drift(spark, sf), 1.12, 3)
    return rows.withColumns({"gross": F.round("gross", 2), "cost": F.round("cost", 6), "margin": F.round("margin", 2), "spread": F.round("spread", 2)})


# ---- carry holds -------------------------------------------------------------------------------------------------------------------


@register("bt11_carry_holds", f"""WITH {DAILY}, {RATES}, d AS (SELECT b.*, coalesce(round(r.rate, 6) - 5, 0) AS diff FROM bars b ASOF LEFT JOIN {OWN_RATES} r ON b.pair = r.pair AND b.ts >= r.ts),
  l AS (SELECT *, ln(close / lag(close) OVER {BY}) AS lr FROM d), v AS (SELECT *, {full('stddev_samp', 'lr', 5)} AS vol FROM l), m AS (SELECT *, {full('quantile_half', 'vol', 10)} AS usual FROM v),
  s AS (SELECT *, CASE WHEN NOT coalesce(round(vol, 12) > round(usual * 1.3, 12), false) AND abs(diff) > 0.05 THEN sign(diff) ELSE 0 END AS signal FROM m), p AS (SELECT *, coalesce(lag(signal) OVER {BY}, 0) AS position FROM s),
  q AS (SELECT *, abs(position - coalesce(lag(position) OVER {BY}, 0)) * (CASE WHEN spread_median_pips > 0 THEN spread_median_pips ELSE 0 END + 0.8) AS cost_pips, coalesce(position <> lag(position) OVER {BY}, true)::INT AS turn FROM p),
  k AS (SELECT *, sum(turn) OVER {BY} AS run, coalesce(lead(cost_pips) OVER {BY}, 0) AS nc FROM q),
  h AS (SELECT pair, run, position, min(ts) AS entry_ts, max(ts) AS exit_ts, first(close ORDER BY ts) AS a, last(close ORDER BY ts) AS z, avg(abs(diff)) AS mean_diff, sum(cost_pips) + last(nc ORDER BY ts) AS cost FROM k WHERE position <> 0 GROUP BY pair, run, position),
  g AS (SELECT *, floor((epoch(exit_ts) - epoch(entry_ts)) / 86400)::BIGINT AS days FROM h), c AS (SELECT *, mean_diff * greatest(days, 1) / 365 * 0.5 / 0.0001 AS carry, position * (z - a) / 0.0001 AS drift FROM g)
  SELECT pair, entry_ts, exit_ts, position::DOUBLE AS direction, days, {r('mean_diff', 'mean_diff')}, {r('carry', 'carry', 4)}, {r('drift', 'drift', 2)}, {r('carry + drift', 'gross', 2)}, {r('cost', 'cost')}, {r('carry + drift - cost', 'net', 2)} FROM c""".replace("quantile_half(vol)", "quantile_cont(vol, 0.5)"))
def _(spark, sf):
    rows = joins.asof(tables.daily_bars(spark, sf), _rate_rows(spark, sf), "rate").withColumn("diff", F.round("rate", 6) - 5)
    digits = {"mean_diff": 6, "carry": 4, "drift": 2, "gross": 2, "cost": 6, "net": 2}
    return simulate.carry_holds(rows, least=0.05, crash=1.3, n=5, median_n=10).withColumns({c: F.round(c, d) for c, d in digits.items()})


# ---- stress grid -------------------------------------------------------------------------------------------------------------------

EQUITY = f"""j AS (SELECT b.pair, b.ts, b.close, pt.* EXCLUDE (pair) FROM {{rows}} b ASOF LEFT JOIN pt ON b.pair = pt.pair AND b.ts >= pt.entry_time), k AS (SELECT *, entry_equity - entry_pips * 0.0001 * size AS paid FROM j),
  eq AS (SELECT pair, ts, CASE WHEN direction IS NULL THEN 10000 WHEN ts >= exit_time THEN paid + pnl_pips * 0.0001 * size ELSE paid + (close - entry_price) * direction * size END AS equity FROM k),
  rt AS (SELECT pair, ts, equity, round(equity / lag(equity) OVER {BY} - 1, 12) AS ret, greatest(0, least(1, 1 - equity / max(equity) OVER {BY})) AS dd FROM eq)"""
RATIO = SHARPE.replace(", 6)", ", 4)")
_hash = lambda tag: md5u(f"'1|{tag}|' || stress || '|' || draw || '|' || o || '|' || epoch(ts)::BIGINT")


def _stress_sql(draws: int) -> str:
    cells = ", ".join(str((name, share, delay, cost, d)) for name, share, delay, cost in simulate.STRESSES for d in range(draws if share else 1))
    stressed = f"""t0 AS (SELECT *, {TR} AS tr FROM bars), a0 AS (SELECT *, round({full('avg', 'tr', 14)}, 6) AS atr FROM t0),
  s0 AS (SELECT *, coalesce(sign({full('avg', 'close', 5)} - {full('avg', 'close', 20)}), 0.0) AS signal FROM a0), ce(stress, share, delay, m, draw) AS (VALUES {cells}), s1 AS (SELECT s0.* EXCLUDE (pair), ce.*, pair AS o, pair || '#' || stress || '#' || draw AS pair FROM s0, ce),
  s2 AS (SELECT * REPLACE (CASE WHEN {_hash('hit')} < share THEN floor({_hash('value')} * 3) - 1 ELSE signal END AS signal) FROM s1), s AS (SELECT * REPLACE (CASE WHEN delay = 1 THEN coalesce(lag(signal) OVER {BY}, 0) ELSE signal END AS signal) FROM s2),"""
    priced = PRICED[PRICED.index("p AS (SELECT *, coalesce(lag(signal)"):]
    priced = priced.replace("first(atr ORDER BY ts) AS atr,", "first(atr ORDER BY ts) AS atr, first(m ORDER BY ts) AS m,", 1)
    priced = priced.replace("s1 / 2 + 0.3 - CASE WHEN side > 0 THEN -0.4 ELSE 0.1 END * floor((epoch(exit_time) - epoch(entry_time)) / 86400) AS cost_pips, s0 / 2 + 0.3 AS entry_pips",
                            "m * (s1 / 2 + 0.3 - CASE WHEN side > 0 THEN -0.4 ELSE 0.1 END * floor((epoch(exit_time) - epoch(entry_time)) / 86400)) AS cost_pips, m * (s0 / 2 + 0.3) AS entry_pips")
    return f"""WITH {DAILY}, {stressed} {priced}, {EQUITY.format(rows='s')}, tc AS (SELECT pair, count(*) AS trades FROM pt GROUP BY pair),
  st AS (SELECT pair, {RATIO} AS sharpe, last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1 AS total_return, max(dd) AS max_drawdown FROM rt GROUP BY pair),
  sc AS (SELECT split_part(pair, '#', 1) AS pair, split_part(pair, '#', 2) AS stress, split_part(pair, '#', 3)::INT AS draw, sharpe, total_return, max_drawdown, coalesce(trades, 0) AS trades FROM st LEFT JOIN tc USING (pair))"""


def _stressed(spark, sf, draws):
    rows = signals.sma_cross(ind.atr_simple(tables.daily_bars(spark, sf)).withColumn("atr", F.round("atr", 6)))
    cells = simulate.stress_grid(rows, draws, swap_long=-0.4, swap_short=0.1)
    return cells.withColumn("sharpe", F.round("sharpe", 4))


@register("bt12_stress_grid", f"{_stress_sql(3)} SELECT pair, stress, draw, sharpe, round(total_return, 5) AS total_return, round(max_drawdown, 5) AS max_drawdown, trades FROM sc")
def _(spark, sf):
    return _stressed(spark, sf, 3).withColumns({c: F.round(c, 5) for c in ("total_return", "max_drawdown")})


@register("bt12_stress_report", f"""{_stress_sql(25)}, ba AS (SELECT pair, sharpe AS base FROM sc WHERE stress = 'baseline')
  SELECT pair, stress, count(*) AS draws, round(avg(sharpe), 9) AS sharpe, min(sharpe) AS worst, round(avg((sharpe < base)::INT), 6) AS below FROM sc JOIN ba USING (pair) GROUP BY pair, stress""")
def _(spark, sf):
    return simulate.stress_report(_stressed(spark, sf, 25)).withColumns({"sharpe": F.round("sharpe", 9), "below": F.round("below", 6)})


# ---- walk-forward ------------------------------------------------------------------------------------------------------------------

TRAIN, TEST, STEP, WARM = 100, 60, 30, 50
WARMED = f"""n AS (SELECT *, row_number() OVER {BY} - 1 AS i, count(*) OVER (PARTITION BY pair) AS z FROM bars),
  wn AS (SELECT n.* EXCLUDE (pair), pair || '#' || w AS pair, i >= w * {STEP} + {TRAIN} AS is_test FROM n, range(100000) g(w) WHERE w <= (SELECT max(i) FROM n) AND w * {STEP} + {TRAIN + TEST} <= z AND i < w * {STEP} + {TRAIN + TEST} AND i >= w * {STEP} + {TRAIN - WARM})"""
TESTED = PRICED.replace("FROM bars)", "FROM wn)", 1).replace("AS position FROM s)", "AS position FROM (SELECT * FROM s WHERE is_test))", 1)
WALKED = f"""WITH {DAILY}, {WARMED}, {TESTED}, {EQUITY.format(rows='(SELECT * FROM s WHERE is_test)')}, tc AS (SELECT pair, count(*) AS trades FROM pt GROUP BY pair),
  st AS (SELECT pair, min(ts) AS test_start, max(ts) AS test_end, count(*) AS bars, {RATIO} AS sharpe, max(dd) AS max_drawdown FROM rt GROUP BY pair),
  wk AS (SELECT split_part(pair, '#', 1) AS pair, split_part(pair, '#', 2)::INT AS "window", test_start, test_end, bars, sharpe, max_drawdown, coalesce(trades, 0) AS trades FROM st LEFT JOIN tc USING (pair))"""


def _walked(spark, sf):
    def signal(bars):
        return signals.sma_cross(ind.atr_simple(bars).withColumn("atr", F.round("atr", 6)))

    rows = walkforward.run(tables.daily_bars(spark, sf), signal, TRAIN, TEST, STEP, WARM, swap_long=-0.4, swap_short=0.1)
    return rows.withColumn("sharpe", F.round("sharpe", 4))


@register("met6_warmed_windows", f"{WALKED} SELECT pair, wk.window, test_start, test_end, bars, sharpe, round(max_drawdown, 5) AS max_drawdown, trades FROM wk")
def _(spark, sf):
    return _walked(spark, sf).withColumn("max_drawdown", F.round("max_drawdown", 5))


@register("met6_verdict", f"{WALKED} SELECT pair, count(*) AS windows, round(avg(sharpe), 9) AS avg_sharpe, round(avg(max_drawdown), 5) AS avg_max_drawdown, sum(trades)::BIGINT AS trades, count_if(sharpe > 0) > count(*) / 2 AS consistent FROM wk GROUP BY pair")
def _(spark, sf):
    return walkforward.verdict(_walked(spark, sf)).withColumns({"avg_sharpe": F.round("avg_sharpe", 9), "avg_max_drawdown": F.round("avg_max_drawdown", 5)})


# ---- ladders put together, reconciliation ----------------------------------------------------------------------------------------------

_rung = lambda name, levels: f"CASE WHEN dd >= {levels[2]} THEN 0 WHEN dd >= {levels[1]} THEN 0.5 ELSE 1 END AS {name}"


@register("str6_composed_ladders", f"""WITH {DAILY}, d AS (SELECT pair, ts, coalesce(greatest(0, 1 - close / max(CASE WHEN day(ts) % 5 <> 0 THEN close END) OVER {BY}), 0) AS dd FROM bars),
  l AS (SELECT pair, ts, {_rung('x', jobs.LADDER)}, {_rung('y', (0.08, 0.25, 0.4))} FROM d) SELECT pair, ts, least(x, y)::DOUBLE AS size, x = 0 OR y = 0 AS flat FROM l""")
def _(spark, sf):
    rows = tables.daily_bars(spark, sf).select("pair", "ts", F.col("close").alias("equity"), (F.dayofmonth("ts") % 5 == 0).alias("is_mock"))
    return jobs.compose(jobs.ladder(rows), jobs.ladder(rows, (0.08, 0.25, 0.4)))


def cycles(spark, sf):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return tables.read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("strategy"), o.alias("seq"), F.when(k % 3 == 0, "USDJPY").otherwise("EURUSD").alias("pair"), (100 + (o % 50) * 0.1).alias("mid"), ((k % 4) * 10.0).alias("held"),
        ((k % 7) * 0.5).alias("cost"), ((k % 5) * 0.75).alias("swap"), (100000 + (k % 200)).cast("double").alias("broker"), (o % 6 == 0).alias("is_mock"),
    )


@register("str7_reconciliation", """WITH c AS (SELECT o_orderpriority AS strategy, o_orderkey AS seq, CASE WHEN o_custkey % 3 = 0 THEN 'USDJPY' ELSE 'EURUSD' END AS pair, 100 + (o_orderkey % 50) * 0.1::DOUBLE AS mid, (o_custkey % 4) * 10::DOUBLE AS held,
  (o_custkey % 7) * 0.5::DOUBLE AS cost, (o_custkey % 5) * 0.75::DOUBLE AS swap, 100000 + (o_custkey % 200)::DOUBLE AS broker, o_orderkey % 6 = 0 AS mock FROM orders),
  p AS (SELECT *, lag(mid) OVER (PARTITION BY strategy, pair ORDER BY seq) AS b FROM c), s AS (SELECT *, CASE WHEN b > 0 AND held > 0 THEN CASE WHEN pair = 'USDJPY' THEN held / b ELSE held END * (mid - b) ELSE 0 END + swap - cost AS step FROM p),
  m AS (SELECT *, first_value(broker) OVER w + sum(step) OVER w AS modelled, greatest(50, coalesce(max(CASE WHEN NOT mock THEN broker END) OVER w, 0) * 0.003) AS tol FROM s WINDOW w AS (PARTITION BY strategy ORDER BY seq)),
  f AS (SELECT *, NOT mock AND abs(broker - modelled) > tol AS breach, NOT mock AND abs(broker - modelled) > 2 * tol AS double_breach FROM m), i AS (SELECT *, count_if(NOT mock AND NOT breach) OVER (PARTITION BY strategy ORDER BY seq) AS isl FROM f)
  SELECT strategy, seq, round(modelled, 4) AS modelled, round(broker - modelled, 4) AS residual, breach, double_breach, count_if(breach) OVER (PARTITION BY strategy, isl ORDER BY seq) AS in_a_row FROM i""")
def _(spark, sf):
    rows = jobs.reconcile(cycles(spark, sf), 50.0, 0.003)
    return rows.select("strategy", "seq", F.round("modelled", 4).alias("modelled"), F.round("residual", 4).alias("residual"), "breach", "double_breach", "in_a_row")


# ---- fixed benchmarks, drawdowns, aggregates, spacing -----------------------------------------------------------------------------------


def _fixed_sql() -> str:
    out = []
    for name, b in (("cells", evidence.CELL_BENCHMARK), ("events", evidence.EVENT_BENCHMARK)):
        z, stands = evidence.deflated_sql("sharpe", "n", "skew", "kurt", f"({b!r} * sqrt(n - 1.0))", 252.0)
        out.append(f"SELECT pair, '{name}' AS benchmark, CASE WHEN {stands} THEN {z} END AS z FROM s")
    return f"""WITH {DAILY}{SIMPLE}, c AS (SELECT pair, ret, ret - avg(ret) OVER (PARTITION BY pair) AS d FROM x), s AS (SELECT pair, count(*) AS n, {SHARPE} AS sharpe, {MOMENTS} FROM c GROUP BY pair),
  zs AS ({' UNION ALL '.join(out)}) SELECT pair, benchmark, round(coalesce({evidence.cdf_sql('z')}, 0), 6) AS dsr FROM zs"""


@register("st9_fixed_benchmarks", _fixed_sql())
def _(spark, sf):
    rows = _returns(tables.daily_bars(spark, sf))
    cells = rows.groupBy("pair").agg(F.round(stats.sharpe(), 6).alias("sharpe")).join(evidence.moments(rows, "pair"), "pair")
    out = evidence.deflated_against(cells, evidence.CELL_BENCHMARK).withColumn("benchmark", F.lit("cells")).unionByName(evidence.deflated_against(cells, evidence.EVENT_BENCHMARK).withColumn("benchmark", F.lit("events")))
    return rounded(out.select("pair", "benchmark", "dsr"))


DETAILS = f"""b0 AS (SELECT b.*, round(r.rate, 6) AS rate FROM bars b ASOF LEFT JOIN {OWN_RATES} r ON b.pair = r.pair AND b.ts >= r.ts),
  b1 AS (SELECT *, close AS equity, max(close) OVER {BY} AS peak, CASE WHEN {full('avg', 'close', 10)} > {full('avg', 'close', 40)} THEN 'UP' WHEN count(close) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) = 40 THEN 'DOWN' ELSE '?' END AS trend FROM b0),
  b2 AS (SELECT *, count_if(equity >= peak) OVER {BY} AS island, greatest(0, 1 - equity / peak) AS dd FROM b1),
  b3 AS (SELECT pair, island, min(ts) AS peak_ts, first(equity ORDER BY ts) AS peak_equity, arg_min({{'r': rate}}, ts).r AS rate, first(trend ORDER BY ts) AS trend, max(dd) AS depth, first(ts ORDER BY dd DESC, ts) AS trough_ts, first(equity ORDER BY dd DESC, ts) AS trough_equity FROM b2 GROUP BY pair, island),
  b4 AS (SELECT *, lead(peak_ts) OVER (PARTITION BY pair ORDER BY island) AS recovery_ts FROM b3), dt AS (SELECT *, floor((epoch(trough_ts) - epoch(peak_ts)) / 86400)::BIGINT AS days_down, floor((epoch(recovery_ts) - epoch(trough_ts)) / 86400)::BIGINT AS days_up,
  row_number() OVER (PARTITION BY pair ORDER BY depth DESC, peak_ts) AS rank FROM b4 WHERE depth >= 0.05)"""


def _details(spark, sf):
    rows = joins.asof(tables.daily_bars(spark, sf), _rate_rows(spark, sf), "rate").withColumns({"rate": F.round("rate", 6), "equity": F.col("close"), "a": ind.sma("close", 10), "b": ind.sma("close", 40)})
    trend = F.when(F.col("a") > F.col("b"), "UP").when(F.col("b").isNotNull(), "DOWN").otherwise("?")
    return metrics.drawdown_details(rows.withColumn("trend", trend), 0.05, ("rate", "trend"))


@register("met5_drawdown_details", f"WITH {DAILY}, {RATES}, {DETAILS} SELECT pair, peak_ts, trough_ts, recovery_ts, {r('depth', 'depth')}, {r('peak_equity', 'peak_equity')}, {r('trough_equity', 'trough_equity')}, days_down, days_up, rate, trend, CAST(rank AS INT) AS rank FROM dt")
def _(spark, sf):
    return rounded(_details(spark, sf))


@register("met5_depth_histogram", f"""WITH {DAILY}, {RATES}, {DETAILS}, g(o, u) AS (VALUES {', '.join(map(str, zip(metrics.DEPTHS, metrics.DEPTHS[1:])))})
  SELECT pair, o::DOUBLE AS over, u::DOUBLE AS upto, count(*) AS drawdowns, count_if(recovery_ts IS NULL) AS unrecovered, sum(days_down)::BIGINT AS days FROM dt JOIN g ON depth > o::DOUBLE AND depth <= u::DOUBLE GROUP BY pair, o, u""")
def _(spark, sf):
    return metrics.drawdown_histogram(_details(spark, sf))


@register("met13_aggregate", f"""WITH {DAILY}, {POS}, {TRADES}, xr AS (SELECT pair, ts, ret / 100 AS ret FROM net), ee AS (SELECT *, exp(sum(ln(1 + ret)) OVER {BY}) AS equity, ret - avg(ret) OVER (PARTITION BY pair) AS d FROM xr),
  kk AS (SELECT *, 1 - equity / max(equity) OVER {BY} AS dd FROM ee), mo AS (SELECT pair, count(*)::DOUBLE AS n, {SHARPE} AS sharpe, greatest(0, max(dd)) AS max_drawdown, {MOMENTS} FROM kk GROUP BY pair), tt AS (SELECT pair, count(*) AS trades FROM trades GROUP BY pair),
  sm AS (SELECT *, sqrt(n * (n - 1)) / (n - 2) * skew AS sk, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6) AS ku FROM mo LEFT JOIN tt USING (pair))
  SELECT 'sma' AS strategy, count(*) AS cells, round(avg(sharpe), 5) AS sharpe, {r('max(max_drawdown)', 'max_drawdown')}, sum(coalesce(trades, 0))::BIGINT AS trades, min(n)::BIGINT AS bars, {r('avg(sk)', 'skew')}, {r('avg(ku)', 'kurt')} FROM sm""")
def _(spark, sf):
    rows = _net(spark, sf).select("pair", "ts", (F.col("ret") / 100).alias("ret"))
    cells = rows.groupBy("pair").agg(F.round(stats.sharpe(), 6).alias("sharpe"), F.count("*").alias("bars")).join(metrics.max_drawdown(metrics.equity_from_returns(rows)), "pair")
    cells = cells.join(metrics.sample_moments(rows, "pair").select("pair", "skew", "kurt"), "pair").join(_trades(spark, sf).groupBy("pair").agg(F.count("*").alias("trades")), "pair", "left")
    out = metrics.cross_pair_aggregate(cells.withColumn("strategy", F.lit("sma")).na.fill(0, ["trades"]))
    return rounded(out.withColumn("sharpe", F.round("sharpe", 5)))


def _spaced(bars: str, name: str) -> str:
    return f"""(WITH {bars}, x AS (SELECT '{name} ' || pair AS pair, ret, (epoch(ts) - epoch(before)) / 3600 AS gap FROM (SELECT pair, ts, lag(ts) OVER {BY} AS before, close / lag(close) OVER {BY} - 1 AS ret FROM bars))
  SELECT pair, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s, quantile_cont(gap, 0.5) AS h FROM x GROUP BY pair)"""


@register("met1_by_spacing", f"""WITH u AS ({_spaced(HOURLY, 'hour')} UNION ALL {_spaced(DAILY, 'day')}), f AS (SELECT *, CASE WHEN h <= 1.5 THEN 6240.0 WHEN h <= 6 THEN 1560.0 ELSE 252.0 END::DOUBLE AS periods_per_year FROM u)
  SELECT pair, n, periods_per_year, round(CASE WHEN s > 0 THEN m / s * sqrt(periods_per_year) ELSE 0 END, 6) AS sharpe FROM f""")
def _(spark, sf):
    both = [b.select(F.concat(F.lit(f"{k} "), "pair").alias("pair"), "ts", ind.momentum("close", 1).alias("ret")) for k, b in (("hour", tables.hourly_bars(spark, sf)), ("day", tables.daily_bars(spark, sf)))]
    return rounded(metrics.summary_by_spacing(both[0].unionByName(both[1])).select("pair", "n", "periods_per_year", "sharpe"))


@register("bt8_event_trades", f"""WITH {HOURLY}, {SEASONAL}, l AS (SELECT *, sign(close - open) AS direction, lead(ts) OVER {BY} AS ets, lead(open) OVER {BY} AS eo, lead(spread_median_pips) OVER {BY} AS es, lead(ts, 2) OVER {BY} AS xts, lead(close, 2) OVER {BY} AS xc, lead(spread_median_pips, 2) OVER {BY} AS xs FROM n)
  SELECT pair, ts, ets AS entry_ts, xts AS exit_ts, direction::DOUBLE AS direction, {r('relvol', 'relvol')}, {r('relrng', 'relrng')}, round(direction * (xc - eo) / 0.0001, 2) AS gross, {r('es + xs + 0.8', 'cost')}, round(direction * (xc - eo) / 0.0001 - (es + xs + 0.8), 2) AS net
  FROM l WHERE hour(ts) IN (7, 13) AND relvol >= 1.2 AND direction <> 0 AND es > 0 AND xs > 0""")
def _(spark, sf):
    rows = events.participation_trades(_seasonal(spark, sf), least_volume=1.2)
    return rounded(rows).withColumns({c: F.round(c, 2) for c in ("gross", "net")})


# ---- plug points, the store ------------------------------------------------------------------------------------------------------------


@register("udf1_pandas_signal", f"WITH {DAILY} SELECT pair, ts, {SMA_SIGNAL}::DOUBLE AS signal FROM bars")
def _(spark, sf):
    """The crossover as a user's function on pandas frames, with a look-back of 19 bars."""
    def crossover(bars):
        gap = bars["close"].rolling(5).mean() - bars["close"].rolling(20).mean()
        return (gap > 0).astype(float) - (gap < 0).astype(float)

    return tables.daily_bars(spark, sf).transform(strategies.pandas_signal(crossover, 19)).select("pair", "ts", "signal")


@register("udf2_registered_signal", f"WITH {DAILY} SELECT pair, ts, {SMA_SIGNAL}::DOUBLE AS signal FROM bars")
def _(spark, sf):
    return tables.daily_bars(spark, sf).transform(strategies.signal("sma_cross", fast=5, slow=20)).select("pair", "ts", "signal")


@register("src4_store_catalog", f"WITH {HOURLY} SELECT DISTINCT pair, 'hour' AS timeframe FROM bars")
def _(spark, sf):
    folder = files.scratch(spark, "src4")
    files.write_bars(tables.hourly_bars(spark, sf).withColumn("timeframe", F.lit("hour")), folder)
    return files.catalog(spark, folder).select("pair", "timeframe")
