"""Registered queries of trades with sizes and costs, event studies, reality checks and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import costs, events, evidence, indicators as ind, joint, metrics, resample, signals, simulate, statistics as stats
from tidemark.plans.market import BY, CUTOFF, DAILY, HOURLY, LEDGER, POS, SIMPLE, TR, _indicator, _ledger, _net, _returns, frame, full, r, register, rounded
from tidemark.plans.research import ADMITTED, BANKS, EVENTS, PASTW, RESAMPLES, SHARPE, SWEPT, CELLS, _events
from tidemark.sources import tables
from tidemark.streaming import jobs

# ---- deflated Sharpe ratios ------------------------------------------------------------------------------------------------------

MOMENTS = "avg(power(d, 3)) / power(avg(d * d), 1.5) AS skew, avg(power(d, 4)) / power(avg(d * d), 2) - 3 AS kurt"


def _dsr_sql(rows: str, keep: str) -> str:
    """dsr of rows (sharpe, n, skew, kurt, trials)."""
    z, stands = evidence.deflated_sql("sharpe", "n", "skew", "kurt", "best", 252.0)
    return f"b AS (SELECT *, {evidence.expected_max_sql('trials')} AS best FROM {rows}), z AS (SELECT *, CASE WHEN {stands} AND n > 1 THEN {z} END AS z FROM b), d AS (SELECT {keep}, best, n, CASE WHEN n > 1 THEN coalesce({evidence.cdf_sql('z')}, 0) END AS dsr FROM z)"


@register("st9_deflated_sharpe", f"""WITH {DAILY}{SIMPLE}, c AS (SELECT pair, ret, ret - avg(ret) OVER (PARTITION BY pair) AS d FROM x), s AS (SELECT pair, count(*) AS n, {SHARPE} AS sharpe, {MOMENTS}, 30 AS trials FROM c GROUP BY pair),
  {_dsr_sql('s', 'pair, sharpe')} SELECT pair, n, sharpe, round(best / sqrt(n - 1), 6) AS expected_max, round(dsr, 6) AS dsr FROM d""")
def _(spark, sf):
    rows = _returns(tables.daily_bars(spark, sf))
    cells = rows.groupBy("pair").agg(F.round(stats.sharpe(), 6).alias("sharpe")).join(evidence.moments(rows, "pair"), "pair").withColumn("trials", F.lit(30))
    return rounded(evidence.expected_max_sharpe(evidence.deflated_sharpe(cells)).select("pair", "n", "sharpe", "expected_max", "dsr"))


@register("st10_deflated_recompute", f"""WITH {LEDGER}, l AS (SELECT trial_id, arg_max(status, seq) AS status, arg_max({{'s': sharpe}}, seq).s AS sharpe FROM ledger GROUP BY trial_id), q AS (SELECT o_custkey AS trial_id, o_totalprice / lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ret FROM orders),
  c AS (SELECT trial_id, ret, ret - avg(ret) OVER (PARTITION BY trial_id) AS d FROM q), m AS (SELECT trial_id, count(ret) AS n, {MOMENTS} FROM c GROUP BY trial_id), s AS (SELECT l.*, m.n, skew, kurt, (SELECT count(*) FROM l) AS trials,
  CASE WHEN sharpe IS NULL THEN 'blocked-no-sharpe' WHEN m.trial_id IS NULL THEN 'blocked-no-equity-series' WHEN n < 2 THEN 'compute-error' ELSE 'ok' END AS state FROM l LEFT JOIN m USING (trial_id) WHERE status IN ('F', 'O')),
  {_dsr_sql('s', 'trial_id, sharpe, skew, kurt, state')} SELECT trial_id, sharpe, CASE WHEN state = 'ok' THEN n END AS n, round(CASE WHEN state = 'ok' THEN skew END, 6) AS skew, round(CASE WHEN state = 'ok' THEN kurt END, 6) AS kurt, round(CASE WHEN state = 'ok' THEN dsr END, 6) AS dsr, state FROM d""")
def _(spark, sf):
    last = _ledger(spark, sf).groupBy("trial_id").agg(F.max_by(F.struct("status", "sharpe"), "seq").alias("l")).select("trial_id", "l.*")
    last = last.crossJoin(F.broadcast(last.agg(F.count("*").alias("trials"))))  # one row
    equity = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("trial_id"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_totalprice").alias("equity"))
    return rounded(evidence.recompute_deflated(last, equity, ["F", "O"]))


def _adjusted(spark, sf, n):
    from tidemark.plans.research import _null_rank

    return rounded(evidence.adjusted_null_p(_null_rank(spark, sf, n), 30).select("pair", "sharpe", "draws", "p_adjusted"))


def _adjusted_sql(n: int) -> str:
    from tidemark.plans.research import _drawn

    z = f"(sharpe - m - s * {evidence.expected_max_sql('30.0')}) / nullif(s, 0)"
    return f"""WITH {DAILY}, {POS}, c AS (SELECT pair, {SHARPE} AS sharpe FROM net GROUP BY pair), n AS (WITH {_drawn(n)} SELECT split_part(pair, '#', 1) AS pair, {SHARPE} AS ns FROM net GROUP BY net.pair),
  a AS (SELECT pair, sharpe, count(*) AS draws, round(avg(ns), 6) AS m, round(stddev_pop(ns), 6) AS s FROM n JOIN c USING (pair) GROUP BY pair, sharpe), z AS (SELECT *, {z} AS z FROM a) SELECT pair, sharpe, draws, round(1 - {evidence.cdf_sql('z')}, 6) AS p_adjusted FROM z"""


@register("st11_adjusted_p", _adjusted_sql(100))
def _(spark, sf):
    return _adjusted(spark, sf, 100)


# ---- reality checks --------------------------------------------------------------------------------------------------------------


@register("st2_block_length")
def _(spark, sf):
    return rounded(stats.block_lengths(_net(spark, sf)))


def _net_weekly(spark, sf):
    """Net returns of weekly bars: days on which every series has a bar are rare in the smaller tables."""
    return simulate.net_returns(signals.sma_cross(resample.ticks_to_bars(tables.daily_ticks(spark, sf), "week")))


@register("st6_reality_check")
def _(spark, sf):
    return rounded(joint.reality_check(_net_weekly(spark, sf), RESAMPLES), 9)


@register("st7_combined_verdict")
def _(spark, sf):
    """The part at or after the cutoff is judged; placement looks at windows of its length in the whole history."""
    rows = _net_weekly(spark, sf)
    late = rows.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp"))
    zero = stats.zero_mean_test(late, RESAMPLES).select("pair", "length", "p", "p5", "p10", "p20", "flips")
    placed = metrics.placement_after(rows, CUTOFF).select("pair", F.col("size").alias("window"), "percentile", "median_sharpe")
    check = joint.reality_check(late, RESAMPLES).select("p_consistent")  # one row
    return rounded(evidence.combined_verdict(zero.join(placed, "pair").crossJoin(F.broadcast(check))))


PLACED = f"""ev AS (SELECT pair, ts, ret, row_number() OVER {BY} AS i, count(*) FILTER (ts >= TIMESTAMP '{CUTOFF}') OVER (PARTITION BY pair) AS size FROM net),
  ws AS (SELECT a.pair, a.ts, a.size, round(avg(b.ret) / nullif(stddev_samp(b.ret), 0), 12) AS s FROM ev a JOIN ev b ON a.pair = b.pair AND b.i > a.i - a.size AND b.i <= a.i WHERE a.i >= a.size AND a.size > 1 GROUP BY a.pair, a.ts, a.size),
  la AS (SELECT pair, arg_max(s, ts) AS last FROM ws WHERE s IS NOT NULL GROUP BY pair)"""


@register("st5_placement_after", f"WITH {DAILY}, {POS}, {PLACED} SELECT pair, size, count(*) AS windows, {r('last', 'last_sharpe')}, {r('avg((s <= last)::INT)', 'percentile')}, {r('quantile_cont(s, 0.5) * sqrt(252)', 'median_sharpe')} FROM ws JOIN la USING (pair) WHERE s IS NOT NULL GROUP BY pair, size, last")
def _(spark, sf):
    return rounded(metrics.placement_after(_net(spark, sf), CUTOFF))


@register("st8_best_studentised", f"""WITH {DAILY}, {SWEPT}, c AS (SELECT pair, ts, ret - avg(ret) OVER (PARTITION BY pair) AS e, count(*) OVER (PARTITION BY pair) AS n, avg(ret) OVER (PARTITION BY pair) AS mean, stddev_samp(ret) OVER (PARTITION BY pair) AS sd FROM net),
  l AS (SELECT *, {', '.join(f'lag(e, {k}) OVER {BY} AS e{k}' for k in range(1, 6))} FROM c), t AS (SELECT pair, n, mean, sd, sqrt(greatest((sum(e * e) + {' + '.join(f'sum(e * e{k}) * {2 * (1 - k / 6)!r}' for k in range(1, 6))}) / n, 1e-12) / n) AS se FROM l GROUP BY pair, n, mean, sd)
  SELECT pair, {r('sqrt(n) * mean / se', 't')}, {r('mean / sd * sqrt(252)', 'sharpe')} FROM t ORDER BY round(sqrt(n) * mean / se, 9) DESC, pair LIMIT 1""")
def _(spark, sf):
    return rounded(evidence.best_by_studentised_mean(simulate.net_returns(stats.sma_grid(tables.daily_bars(spark, sf), CELLS)), 6))


# ---- event studies ---------------------------------------------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MEMBERS = [(b, p, b == p) for b in BANKS for p in PRIORITIES]
AROUND = f"ar AS (SELECT pair, ts AS bar_ts, lag(close) OVER {BY} AS before, close AS d0, lead(close) OVER {BY} AS d1, lead(close, 2) OVER {BY} AS d2 FROM bars)"


@register("jn3_event_bars", f"WITH {DAILY}, {EVENTS}, {ADMITTED}, {AROUND} SELECT a.bank AS pair, a.date AS ts, bar_ts, before, d0, d1, d2 FROM adm a ASOF LEFT JOIN ar ON a.bank = ar.pair AND a.date <= bar_ts")
def _(spark, sf):
    asked = _events(spark, sf).select(F.col("bank").alias("pair"), F.col("date").alias("ts"))
    return evidence.event_bars(tables.daily_bars(spark, sf), asked).select("pair", "ts", "bar_ts", "before", "d0", "d1", "d2")


def _event_returns(spark, sf):
    bars = ind.mad_zscore(tables.daily_bars(spark, sf), "spread_mean_pips").withColumns({"cost": F.col("spread_median_pips") * 0.0001 / F.col("close"), "wide": F.coalesce(F.round("spread_z", 6) > 3, F.lit(False))})
    members = spark.createDataFrame(MEMBERS, "bank string, pair string, reference boolean")
    return evidence.event_returns(_events(spark, sf).select("bank", F.col("date").alias("ts")), F.broadcast(members), bars, "cost", "wide")


@register("st12_event_returns", f"""WITH {DAILY}, {EVENTS}, {ADMITTED}, l AS (SELECT pair, ts, close, spread_median_pips, spread_mean_pips AS x, coalesce(list(spread_mean_pips) OVER {PASTW}, []) AS l FROM bars), m AS (SELECT *, list_median(l) AS m FROM l),
  w AS (SELECT *, list_median([abs(v - m) for v in l]) AS mad FROM m), z AS (SELECT pair, ts, spread_median_pips * 0.0001 / close AS cost, coalesce(round(CASE WHEN len(l) >= 2 THEN CASE WHEN mad > 0 THEN (x - m) / mad ELSE 0 END END, 6) > 3, false) AS wide FROM w),
  {AROUND}, mem(bank, pair, reference) AS (VALUES {', '.join(f"('{b}', '{p}', {str(x).lower()})" for b, p, x in MEMBERS)}), q AS (SELECT a.bank, a.date, mem.pair, reference FROM adm a JOIN mem USING (bank)),
  f AS (SELECT q.*, ar.bar_ts, before, d0, d2 FROM q ASOF LEFT JOIN ar ON q.pair = ar.pair AND q.date <= ar.bar_ts), g AS (SELECT bank, date AS ts, max(CASE WHEN reference THEN sign(round(d0 - before, 9)) END)::DOUBLE AS direction,
  avg(CASE WHEN NOT coalesce(wide, true) AND d2 IS NOT NULL THEN d2 / d0 - 1 - cost END) AS mean FROM f LEFT JOIN z ON z.pair = f.pair AND z.ts = f.bar_ts GROUP BY bank, date)
  SELECT bank, ts, direction, {r('mean', 'mean')}, {r('direction * mean', 'y')} FROM g WHERE direction <> 0 AND mean IS NOT NULL""")
def _(spark, sf):
    return rounded(_event_returns(spark, sf))


@register("st13_blocked_bootstrap")
def _(spark, sf):
    return rounded(joint.blocked_bootstrap(_event_returns(spark, sf), RESAMPLES))


@register("st14_decision")
def _(spark, sf):
    rows = _event_returns(spark, sf)
    late = joint.blocked_bootstrap(rows.where("ts >= timestamp'1995-01-01'"), RESAMPLES, 2).select(F.col("p").alias("p_late"))
    whole = joint.blocked_bootstrap(rows, RESAMPLES).select(F.col("p").alias("p_all"))
    pooled = rows.agg(F.count("y").alias("n"), F.skewness("y").alias("skew"), F.kurtosis("y").alias("kurt"), stats.sharpe("y").alias("sharpe"), F.lit(30).alias("trials"))
    one = late.crossJoin(whole).crossJoin(evidence.deflated_sharpe(pooled).select("dsr")).withColumn("failure", F.lit(False))  # one row each
    return rounded(evidence.decide(one))


# ---- trades ----------------------------------------------------------------------------------------------------------------------

PRICED = f"""t0 AS (SELECT *, {TR} AS tr FROM bars), a0 AS (SELECT *, round({full('avg', 'tr', 14)}, 6) AS atr FROM t0), {POS.replace('FROM bars)', 'FROM a0)', 1)},
  sd AS (SELECT *, sign(position) AS side FROM p), tn AS (SELECT *, coalesce(side <> lag(side) OVER {BY}, true)::INT AS turn FROM sd), rn AS (SELECT *, sum(turn) OVER {BY} AS run, row_number() OVER {BY} AS n FROM tn),
  rs AS (SELECT pair, run, side, min(ts) AS entry_time, first(close ORDER BY ts) AS entry_price, first(spread_median_pips ORDER BY ts) AS s0, first(atr ORDER BY ts) AS atr, max(ts) AS z, last(close ORDER BY ts) AS zp, last(spread_median_pips ORDER BY ts) AS zs, min(n) AS from_n FROM rn GROUP BY pair, run, side),
  nx AS (SELECT *, coalesce(lead(entry_time) OVER w, z) AS exit_time, coalesce(lead(entry_price) OVER w, zp) AS exit_price, coalesce(lead(s0) OVER w, zs) AS s1 FROM rs WINDOW w AS (PARTITION BY pair ORDER BY run)),
  cs AS (SELECT *, CASE WHEN atr > 0 THEN 0.01 / (atr * 2) ELSE 0.01 / (entry_price * 0.02) END AS share, s1 / 2 + 0.3 - CASE WHEN side > 0 THEN -0.4 ELSE 0.1 END * floor((epoch(exit_time) - epoch(entry_time)) / 86400) AS cost_pips, s0 / 2 + 0.3 AS entry_pips FROM nx WHERE side <> 0 AND from_n > 1),
  pn AS (SELECT *, side * (exit_price - entry_price) / 0.0001 - cost_pips AS pnl_pips FROM cs), fc AS (SELECT *, 10000 * coalesce(product(1 + (pnl_pips - entry_pips) * 0.0001 * share) OVER (PARTITION BY pair ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS entry_equity FROM pn),
  pt AS (SELECT pair, CAST(side AS INT) AS direction, entry_time, exit_time, entry_price, exit_price, entry_equity * share AS size, entry_equity, entry_pips, pnl_pips, cost_pips FROM fc)"""


def _priced(spark, sf):
    rows = ind.atr_simple(tables.daily_bars(spark, sf)).withColumn("atr", F.round("atr", 6))
    return simulate.priced_trades(signals.sma_cross(rows), swap_long=-0.4, swap_short=0.1)


@register("bt3_trade_pnl", f"WITH {DAILY}, {PRICED} SELECT pair, direction, entry_time, exit_time, round(size, 9) AS size, round(entry_equity, 4) AS entry_equity, round(pnl_pips, 2) AS pnl_pips, round(cost_pips, 6) AS cost_pips, round(pnl_pips * 0.0001 * size, 4) AS pnl_dollars, round(cost_pips * 0.0001 * size, 9) AS cost_dollars FROM pt")
def _(spark, sf):
    digits = {"size": 9, "entry_equity": 4, "pnl_pips": 2, "cost_pips": 6, "pnl_dollars": 4, "cost_dollars": 9}
    return _priced(spark, sf).select("pair", "direction", "entry_time", "exit_time", *[F.round(c, d).alias(c) for c, d in digits.items()])


@register("bt2_discrete_equity", f"""WITH {DAILY}, {PRICED}, j AS (SELECT b.pair, b.ts, b.close, pt.* EXCLUDE (pair) FROM bars b ASOF LEFT JOIN pt ON b.pair = pt.pair AND b.ts >= pt.entry_time), k AS (SELECT *, entry_equity - entry_pips * 0.0001 * size AS paid FROM j)
  SELECT pair, ts, round(CASE WHEN direction IS NULL THEN 10000 WHEN ts >= exit_time THEN paid + pnl_pips * 0.0001 * size ELSE paid + (close - entry_price) * direction * size END, 4) AS equity FROM k""")
def _(spark, sf):
    return rounded(simulate.discrete_equity(tables.daily_bars(spark, sf), _priced(spark, sf)), 4)


SIZERS = {"fraction": costs.fraction_sizer(), "continuous": costs.continuous_sizer(most=2.2e-4, least=1e-4), "target": costs.target_sizer(2e-8, most=1e-4, least=1e-6)}
UNITS = """CASE WHEN nxt <= 0 THEN 0 WHEN name = 'fraction' THEN CASE WHEN atr > 0 THEN least(nxt * 0.01 * 0.6 / (atr * 2), nxt * 0.1 / entry_price) ELSE 0 END
  WHEN name = 'continuous' THEN CASE WHEN atr > 0 AND least(nxt * 0.01 / (atr * 2) * 0.6, 2.2e-4) >= 1e-4 THEN least(nxt * 0.01 / (atr * 2) * 0.6, 2.2e-4) ELSE 0 END
  ELSE CASE WHEN side > 0 AND least(0.6 * 2e-8 * nxt, 1e-4) >= 1e-6 THEN least(0.6 * 2e-8 * nxt, 1e-4) ELSE 0 END END"""


@register("bt3_sizers", f"""WITH RECURSIVE {DAILY}, {PRICED}, kn AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY run) AS k FROM pn), sz(name) AS (VALUES ('fraction'), ('continuous'), ('target')),
  fe AS (SELECT pair, name, 0::BIGINT AS k, 10000::DOUBLE AS nxt, 0::DOUBLE AS entry_equity, 0::DOUBLE AS size FROM (SELECT DISTINCT pair FROM kn), sz
  UNION ALL SELECT n.pair, name, n.k, nxt + ({UNITS}) * (pnl_pips - entry_pips) * 0.0001, nxt, {UNITS} FROM fe JOIN kn n ON n.pair = fe.pair AND n.k = fe.k + 1)
  SELECT fe.pair, name AS sizer, entry_time, round(fe.size * 1e6, 4) AS micro_units, round(entry_equity, 4) AS entry_equity FROM fe JOIN kn ON fe.pair = kn.pair AND fe.k = kn.k""")
def _(spark, sf):
    rows = ind.atr_simple(tables.daily_bars(spark, sf)).withColumn("atr", F.round("atr", 6))
    rows = signals.sma_cross(rows).withColumn("signal", F.col("signal") * 0.6)
    out = None
    for name, sizer in SIZERS.items():
        one = simulate.priced_trades(rows, swap_long=-0.4, swap_short=0.1, sizer=sizer).select("pair", F.lit(name).alias("sizer"), "entry_time", F.round(F.col("size") * 1e6, 4).alias("micro_units"), F.round("entry_equity", 4).alias("entry_equity"))
        out = one if out is None else out.unionByName(one)
    return out


SEASONAL = f"""sv AS (SELECT pair AS p, (isodow(ts) - 1) * 24 + hour(ts) AS k, greatest(quantile_cont(volume, 0.5), 1.0) AS nv, greatest(quantile_cont(high - low, 0.5), 1e-9) AS nr FROM bars GROUP BY ALL),
  n AS (SELECT bars.*, volume / nv AS relvol, (high - low) / nr AS relrng, nr AS usual_range, first_value(open) OVER (PARTITION BY pair, CAST(ts AS DATE) ORDER BY ts) AS so, row_number() OVER {BY} AS i, count(*) OVER (PARTITION BY pair) AS size FROM bars JOIN sv ON pair = p AND (isodow(ts) - 1) * 24 + hour(ts) = k)"""


def _seasonal(spark, sf):
    rows = tables.hourly_bars(spark, sf).withColumn("rng", F.col("high") - F.col("low"))
    return ind.session_open(ind.relative_to_season(ind.relative_to_season(rows, "volume", "relvol"), "rng", "relrng", 1e-9, "usual_range"))


@register("bt9_reversion_trades", f"""WITH {HOURLY}, {SEASONAL}, q AS (SELECT pair, quantile_cont(spread_median_pips, 0.6) AS tight FROM bars GROUP BY pair), g AS (SELECT n.*, CASE WHEN close - so > 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS direction FROM n JOIN q USING (pair)
  WHERE spread_median_pips > 0 AND spread_median_pips <= tight AND relvol >= 1.1 AND abs(close - so) >= usual_range * 0.5 AND i <= size - 4),
  h AS (SELECT g.pair, g.ts, b.i, CASE WHEN direction > 0 THEN b.high >= g.so ELSE b.low <= g.so END AS hit FROM g JOIN n b ON g.pair = b.pair AND b.i BETWEEN g.i + 2 AND g.i + 4), x AS (SELECT pair, ts, coalesce(min(CASE WHEN hit THEN i END), max(i)) AS k, bool_or(hit) AS hit FROM h GROUP BY ALL),
  y AS (SELECT g.*, e.ts AS entry_ts, e.open AS eo, e.spread_median_pips AS es, z.ts AS exit_ts, z.spread_median_pips AS zs, CASE WHEN NOT hit THEN z.close WHEN direction > 0 THEN least(g.so, z.close) ELSE greatest(g.so, z.close) END AS price
  FROM g JOIN x USING (pair, ts) JOIN n e ON e.pair = g.pair AND e.i = g.i + 1 JOIN n z ON z.pair = g.pair AND z.i = x.k WHERE e.spread_median_pips > 0 AND z.spread_median_pips > 0)
  SELECT pair, ts, entry_ts, exit_ts, direction, {r('relvol', 'relvol')}, {r('relrng', 'relrng')}, round(direction * (price - eo) / 0.0001, 2) AS gross, {r('es + zs + 0.8', 'cost')}, round(direction * (price - eo) / 0.0001 - (es + zs + 0.8), 2) AS net FROM y""")
def _(spark, sf):
    rows = simulate.reversion_trades(_seasonal(spark, sf), least_volume=1.1, tight=0.6, extension=0.5)
    return rounded(rows).withColumns({c: F.round(c, 2) for c in ("gross", "net")})


@register("met19_volatility_control", f"""WITH {HOURLY}, {SEASONAL}, g AS (SELECT *, lead(close, 2) OVER {BY} - lead(open) OVER {BY} AS y FROM n), v AS (SELECT * FROM g WHERE y IS NOT NULL),
  k AS (SELECT pair, y, rank() OVER (PARTITION BY pair ORDER BY round(relvol, 9)) + (count(*) OVER (PARTITION BY pair, round(relvol, 9)) - 1) / 2 AS a, rank() OVER (PARTITION BY pair ORDER BY round(relrng, 9)) + (count(*) OVER (PARTITION BY pair, round(relrng, 9)) - 1) / 2 AS b FROM v),
  s AS (SELECT pair, count(*) AS n, covar_pop(a, a) * count(*) AS aa, covar_pop(b, b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy, covar_pop(y, y) * count(*) AS yy FROM k GROUP BY pair),
  d AS (SELECT *, CASE WHEN aa * bb - ab * ab > 1e-9 AND n >= 10 THEN aa * bb - ab * ab END AS det FROM s), c AS (SELECT *, (bb * ay - ab * byy) / det AS b1, (aa * byy - ab * ay) / det AS b2 FROM d), e AS (SELECT *, yy - b1 * ay - b2 * byy AS rest FROM c)
  SELECT pair, n, {r('b1', 'b1')}, {r('b1 / sqrt(rest / greatest(n - 3, 1) * bb / det)', 't1')}, {r('b2', 'b2')}, {r('b2 / sqrt(rest / greatest(n - 3, 1) * aa / det)', 't2')}, {r('1 - rest / yy', 'r2')}, coalesce(b1 / sqrt(rest / greatest(n - 3, 1) * bb / det) >= 2, false) AS passes FROM e""")
def _(spark, sf):
    rows = events.entry_exit(_seasonal(spark, sf)).withColumn("gross", F.col("exit") - F.col("entry")).where("gross is not null")
    return rounded(metrics.volatility_control(rows.withColumns({c: F.round(c, 9) for c in ("relvol", "relrng")})))


WINDOWS = f"SELECT pair, w, {SHARPE.replace('6)', '9)')} AS s FROM (SELECT pair, ret, w FROM (SELECT *, row_number() OVER {BY} - 1 - 100 AS i FROM {{rows}}) n, range(100000) g(w) WHERE i >= 0 AND w * 30 <= i AND i < w * 30 + 60 AND w <= (SELECT count(*) FROM {{rows}})) GROUP BY pair, w HAVING count(*) = 60"


@register("met7_against_benchmark", f"""WITH {DAILY}, {POS}, bh AS (SELECT pair, ts, coalesce(close / lag(close) OVER {BY} - 1, 0) AS ret FROM bars), u AS ({WINDOWS.format(rows='net')}), v AS ({WINDOWS.format(rows='bh')})
  SELECT pair, count(*) AS windows, {r('avg((u.s > v.s)::INT)', 'wins')}, {r('avg(u.s - v.s)', 'mean_delta')} FROM u JOIN v USING (pair, w) GROUP BY pair""")
def _(spark, sf):
    bench = tables.daily_bars(spark, sf).select("pair", "ts", F.coalesce(ind.momentum("close", 1), F.lit(0.0)).alias("ret"))
    return rounded(stats.against_benchmark(_net(spark, sf), bench, 100, 60, 30))


# ---- the envelope and live jobs -----------------------------------------------------------------------------------------------------

ENVELOPE = f"""n AS (SELECT pair, ts, row_number() OVER {BY} AS i, round(CASE WHEN count(y) OVER w = 30 THEN (y - avg(y) OVER w - covar_samp(k, y) OVER w / 77.5 * 14.5) / sqrt(var_samp(y) OVER w - (covar_samp(k, y) OVER w) ** 2 / 77.5) END, 5) AS z
  FROM (SELECT pair, ts, ln(close) AS y, row_number() OVER {BY} AS k FROM bars) WINDOW w AS {frame(30)})"""
ENTERS = "st = 0 AND abs(n.z) > 1.5"
LEAVES = "st = 1 AND (abs(n.z) < 0.5 OR age + 1 > 10 OR -side * n.z < -1.5)"


@register("sig11_envelope", f"""WITH RECURSIVE {DAILY}, {ENVELOPE}, e AS (SELECT pair, ts, i, 0 AS st, 0 AS side, 0 AS age, 0.0::DOUBLE AS signal FROM n WHERE i = 1 UNION ALL SELECT n.pair, n.ts, n.i,
  CASE WHEN n.z IS NULL THEN st WHEN {ENTERS} THEN 1 WHEN {LEAVES} THEN 2 WHEN st = 2 THEN 0 ELSE st END, CASE WHEN n.z IS NULL THEN side WHEN {ENTERS} THEN CASE WHEN n.z > 0 THEN -1 ELSE 1 END WHEN {LEAVES} THEN 0 ELSE side END,
  CASE WHEN n.z IS NULL THEN age WHEN {ENTERS} OR {LEAVES} THEN 0 WHEN st = 1 THEN age + 1 ELSE age END,
  CASE WHEN n.z IS NULL OR {LEAVES} OR st = 2 THEN 0.0 WHEN {ENTERS} THEN CASE WHEN n.z > 0 THEN -1 ELSE 1 END * least((abs(n.z) - 1.5) / 1.5, 1) WHEN st = 1 THEN greatest(-1, least(1, side * greatest(0, abs(n.z) - 1.5) / 1.5)) ELSE 0.0 END::DOUBLE
  FROM e JOIN n ON n.pair = e.pair AND n.i = e.i + 1) SELECT pair, ts, round(signal, 6) + 0.0 AS signal FROM e""")
def _(spark, sf):
    rows = ind.ols_zscore(tables.daily_bars(spark, sf), 30).withColumn("z", F.round("z", 5))
    return rounded(signals.envelope(rows, enter=1.5, leave=0.5, scale=1.5, longest=10).select("pair", "ts", (F.col("signal") + 0.0).alias("signal")))


@register("str3_signal_log", f"""WITH {HOURLY}, m AS (SELECT pair, ts, close, close / lag(close, 20) OVER {BY} - 1 AS momentum, row_number() OVER {BY} AS i, lead(ts) OVER {BY} AS nx FROM bars)
  SELECT pair, ts, {r('close', 'close')}, {r('momentum', 'momentum')}, CASE WHEN momentum > 0 THEN 1 WHEN momentum < 0 THEN -1 ELSE 0 END::DOUBLE AS signal, CASE WHEN momentum > 0 THEN 'LONG' WHEN momentum < 0 THEN 'SHORT' ELSE 'FLAT' END AS position FROM m WHERE nx IS NOT NULL AND i >= 22""")
def _(spark, sf):
    return rounded(jobs.signal_log(tables.hourly_bars(spark, sf)))


def snapshots(spark, sf):
    return tables.read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pair"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 90).alias("received"),
        F.col("o_totalprice").alias("equity"), (F.col("o_orderkey") % 5 == 0).alias("is_mock"),
    )


@register("str5_aggregate_ladder", """WITH s AS (SELECT o_orderpriority AS pair, o_orderkey AS seq, o_orderdate AS ts, o_custkey % 90 > 60 AS stale, o_totalprice AS equity, o_orderkey % 5 = 0 AS mock FROM orders), w AS (SELECT *, max(CASE WHEN NOT stale THEN ts END) OVER (PARTITION BY pair ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
  a AS (SELECT *, CASE WHEN stale THEN 'stale' WHEN coalesce(ts < before, false) THEN 'out of order' END AS reason FROM w), p AS (SELECT *, max(CASE WHEN reason IS NULL AND NOT mock THEN equity END) OVER (PARTITION BY pair ORDER BY seq) AS peak FROM a),
  d AS (SELECT *, CASE WHEN reason IS NULL THEN coalesce(greatest(0, 1 - equity / peak), 0) END AS dd FROM p), l AS (SELECT *, CASE WHEN reason IS NULL THEN (dd >= 0.04)::INT + (dd >= 0.08)::INT + (dd >= 0.12)::INT + (dd >= 0.15)::INT END AS level FROM d)
  SELECT pair, seq, reason, round(dd, 6) AS drawdown, level, CASE level WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0 WHEN 4 THEN 0 END::DOUBLE AS size, level < 3 AS dispatch, level = 4 AS flat FROM l""")
def _(spark, sf):
    rows = snapshots(spark, sf)
    return rounded(jobs.aggregate_ladder(rows).select("pair", "seq", "reason", "drawdown", "level", "size", "dispatch", "flat"))
