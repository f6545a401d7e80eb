"""More registered queries: gates, events, costs, rules, grids, portfolios and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import costs, events, gate, indicators as ind, joins, ledger, metrics, quality, resample, signals, simulate, statistics as stats
from tidemark.plans.market import (
    BY, DAILY, HOURLY, LEDGER, MACD, OWN_RATES, POS, QUERIES, RATES, RET, SESSION, SIMPLE, SLOTS, SQL, SMA_SIGNAL, TR, TRADES, _ema_sql, _indicator, _ledger, _net, _rate_rows, _returns, _trades,
    frame, full, r, register, rounded,
)
from tidemark.sources import tables


def past(f: str, x: str, n: int) -> str:
    """Aggregate of the n rows before, where all are there."""
    w = f"(PARTITION BY pair ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f} OVER {w} END"


# ---- gates ---------------------------------------------------------------------------------------------------------------------

@register("dq9_bar_checks", f"""WITH {HOURLY}, c AS (SELECT *, NOT coalesce(spread_p90_pips > 0, false) AS b1, spread_median_pips > spread_p90_pips AS b2, volume <= 20 AS b3, spread_median_pips <= 2 AS f FROM bars),
  i AS (SELECT *, count_if(NOT f) OVER {BY} AS island FROM c), n AS (SELECT pair, island, count_if(f) AS n FROM i GROUP BY ALL), z AS (SELECT pair, CAST(max(n) AS BIGINT) AS tight_run FROM n GROUP BY pair)
  SELECT pair, count(*) AS bars, count_if(b1)::BIGINT AS bad_p90, count_if(b2)::BIGINT AS crossed, count_if(b3)::BIGINT AS bad_volume, count_if(b1 OR b2 OR b3) / count(*) > 0.05 AS excluded, tight_run
  FROM c JOIN z USING (pair) GROUP BY pair, tight_run""")
def _(spark, sf):
    return gate.bar_checks(tables.hourly_bars(spark, sf), 20.0, 2.0)


GATE = f"""WITH {HOURLY}, {SLOTS}, g AS (SELECT s.pair, s.ts, b.ts IS NULL AS gone FROM slots s LEFT JOIN bars b ON s.pair = b.pair AND s.ts = b.ts),
  e AS (SELECT *, NOT gone OR coalesce(epoch(ts) - epoch(lag(ts) OVER {BY}) > 3600, false) AS edge FROM g), i AS (SELECT *, count_if(edge) OVER {BY} AS island FROM e),
  n AS (SELECT pair, island, count(*) AS n, count_if(gone) AS g FROM i GROUP BY ALL), c AS (SELECT pair, sum(n) AS expected, sum(n) - sum(g) AS present, max(g) AS longest_gap FROM n GROUP BY pair),
  s AS (SELECT pair, avg(spread_mean_pips) AS spread, avg((spread_mean_pips > 0)::INT) AS measured FROM bars GROUP BY pair), v AS (SELECT pair, round(present / expected, 6) AS coverage, round(spread, 6) AS spread, round(measured, 6) AS measured,
  concat_ws(',', CASE WHEN present < 100 THEN 'bars' END, CASE WHEN present / expected < 0.5 THEN 'coverage' END, CASE WHEN NOT coalesce(measured >= 0.9, false) THEN 'measured' END, CASE WHEN longest_gap > 2 THEN 'gap' END, CASE WHEN NOT coalesce(spread BETWEEN 1 AND 4.0, false) THEN 'spread' END) AS issues,
  present < 100 OR present / expected < 0.5 OR NOT coalesce(measured >= 0.9, false) AS gone FROM c LEFT JOIN s USING (pair)),
  verdicts AS (SELECT pair, coverage, spread, measured, issues, CASE WHEN gone THEN 'EXCLUDE' WHEN issues <> '' THEN 'MANUAL_REVIEW' ELSE 'ADMIT' END AS verdict FROM v)"""


def _spreads(bars):
    return bars.groupBy("pair").agg(F.avg("spread_mean_pips").alias("spread"), F.avg((F.col("spread_mean_pips") > 0).cast("double")).alias("measured"))


def _gate(spark, sf):
    bars = tables.hourly_bars(spark, sf)
    return gate.coverage_gate(quality.missing_hours(bars), _spreads(bars), 100, 0.5, 2, (1.0, 4.0), 0.9)


@register("dq10_coverage_gate", f"{GATE} SELECT * FROM verdicts")
def _(spark, sf):
    return rounded(_gate(spark, sf))


@register("dq12_verdict_counts", f"{GATE} SELECT verdict, count(*) AS pairs FROM verdicts GROUP BY verdict")
def _(spark, sf):
    return gate.verdict_counts(_gate(spark, sf))


@register("dq11_cross_pair_flags", f"""WITH {HOURLY}, s AS (SELECT pair, avg(spread_mean_pips) AS m, NOT ends_with(pair, 'k') AS plain FROM bars GROUP BY pair), e AS (SELECT min(m) AS lo, max(m) AS hi, quantile_cont(m, 0.5) AS mid FROM s WHERE plain)
  SELECT pair, {r('m', 'spread')}, plain AND m > lo * 1.02 AS wide, plain AND hi > m * 1.02 AS narrow, NOT plain AND NOT m / mid BETWEEN 0.995 AND 1.005 AS off FROM s, e""")
def _(spark, sf):
    return rounded(gate.cross_pair_flags(_spreads(tables.hourly_bars(spark, sf)), 1.02, "k", 0.995, 1.005))


# ---- events and joins ----------------------------------------------------------------------------------------------------------

EVENTS = "ev AS (SELECT o_orderdate AS date, o_orderpriority AS bank, o_orderstatus AS tier, o_orderkey FROM orders)"
ADMITTED = "adm AS (SELECT date, min(bank) AS bank, arg_min(tier, bank || tier) AS tier FROM ev WHERE tier IN ('F', 'O') AND bank <> '5-LOW' GROUP BY date)"
BANKS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
MAPPED = {"1-URGENT": ["AN", "AR"], "2-HIGH": ["NR"], "4-NOT SPECIFIED": ["AN", "AR", "NR"]}


def _events(spark, sf):
    rows = tables.read(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("bank"), F.col("o_orderstatus").alias("tier"))
    return events.admissible(rows, ["F", "O"], BANKS)


@register("flt5_admissible_events", f"WITH {EVENTS}, {ADMITTED} SELECT * FROM adm")
def _(spark, sf):
    return _events(spark, sf)


@register("flt6_date_window", f"WITH {EVENTS}, {ADMITTED} SELECT *, date >= TIMESTAMP '1997-01-01' AS late FROM adm WHERE date >= TIMESTAMP '1994-01-01' AND date <= TIMESTAMP '1998-01-01'")
def _(spark, sf):
    return events.date_window(_events(spark, sf), "1994-01-01", "1998-01-01", "1997-01-01")


@register("flt7_log_query", "SELECT o_orderkey AS trial_id, o_orderdate AS ts, o_totalprice AS sharpe FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderpriority = '2-HIGH' AND o_totalprice >= 100000 AND o_orderstatus = 'O'")
def _(spark, sf):
    rows = tables.read(spark, sf, "orders").where("o_orderpriority = '2-HIGH' and o_totalprice >= 100000 and o_orderdate >= timestamp_ntz'1995-01-01'")
    tags = F.array("o_orderpriority", "o_orderstatus")
    rows = rows.where(F.forall(F.array(F.lit("2-HIGH"), F.lit("O")), lambda t: F.array_contains(tags, t)))
    return rows.select(F.col("o_orderkey").alias("trial_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("sharpe"))


@register("jn7_event_pairs", f"WITH {EVENTS}, {ADMITTED} SELECT adm.*, m.pair FROM adm JOIN (VALUES {', '.join(f"('{b}', '{p}')" for b, ps in MAPPED.items() for p in ps)}) m(bank, pair) USING (bank)")
def _(spark, sf):
    return events.expand(_events(spark, sf), MAPPED)


@register("jn2_rate_differentials", f"""WITH {RATES}, s AS (SELECT min(ts) AS a, max(ts) AS b FROM rates), d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM s),
  g AS (SELECT c.currency, d.ts FROM d, (SELECT DISTINCT currency FROM rates) c WHERE isodow(d.ts) < 6), f AS (SELECT g.currency, g.ts, rate FROM g ASOF LEFT JOIN rates USING (currency, ts))
  SELECT l.pair, x.ts, {r('(x.rate - y.rate) / 100', 'diff', 9)} FROM f x JOIN (VALUES ('AN', 'A', 'N'), ('AR', 'A', 'R'), ('NR', 'N', 'R')) l(pair, base, quote) ON x.currency = base
  JOIN f y ON y.currency = quote AND y.ts = x.ts WHERE x.rate IS NOT NULL AND y.rate IS NOT NULL""")
def _(spark, sf):
    legs = spark.createDataFrame([("AN", "A", "N"), ("AR", "A", "R"), ("NR", "N", "R")], "pair string, base string, quote string")
    rates = tables.rates(spark, sf).select("currency", F.col("date").alias("ts"), F.col("rate_pct").alias("rate"))
    return rounded(joins.differentials(rates, F.broadcast(legs)), 9)


MOM_SIGNAL = f"CAST(CASE WHEN close / lag(close, 20) OVER {BY} - 1 > 0 THEN 1 WHEN close / lag(close, 20) OVER {BY} - 1 < 0 THEN -1 ELSE 0 END AS DOUBLE)"


@register("jn6_compare_sources", f"WITH {DAILY}, t AS (SELECT pair, {SMA_SIGNAL} AS x, {MOM_SIGNAL} AS y FROM bars) SELECT pair, count(*) AS rows, {r('avg(abs(x - y))', 'mean_diff')}, {r('avg((sign(x) = sign(y))::INT)', 'agreement')} FROM t GROUP BY pair")
def _(spark, sf):
    bars = tables.daily_bars(spark, sf)
    return rounded(joins.compare_sources(signals.sma_cross(bars), signals.momentum_signal(bars)))


@register("jn8_widest_bar", f"""WITH {HOURLY}, t AS (SELECT *, {TR} AS tr, date_trunc('day', ts)::TIMESTAMP AS day FROM bars), d AS (SELECT DISTINCT event_type AS pair, date_trunc('day', ts)::TIMESTAMP AS day FROM events)
  SELECT pair, day, ts, {r('tr', 'tr')} FROM t SEMI JOIN d USING (pair, day) QUALIFY row_number() OVER (PARTITION BY pair, day ORDER BY tr DESC, ts) = 1""")
def _(spark, sf):
    days = tables.ticks(spark, sf).select("pair", F.date_trunc("day", "ts").alias("day")).distinct()
    return rounded(events.widest_bar(tables.hourly_bars(spark, sf), days))


@register("jn9_bounded_exit", f"""WITH {HOURLY}, n AS (SELECT *, row_number() OVER {BY} AS i FROM bars), p AS (SELECT a.pair, a.ts, b.ts AS bts, b.close AS c, b.i, (b.low <= a.close - 20 OR b.high >= a.close + 30) AS hit
  FROM n a JOIN n b ON a.pair = b.pair AND b.i BETWEEN a.i + 1 AND a.i + 5), q AS (SELECT pair, ts, bool_or(hit) AS hit, CASE WHEN bool_or(hit) THEN min(CASE WHEN hit THEN i END) ELSE max(i) END AS k FROM p GROUP BY ALL)
  SELECT n.pair, n.ts, x.ts AS exit_ts, {r('x.close', 'exit_close')}, CASE WHEN q.hit THEN 'touch' WHEN q.k IS NOT NULL THEN 'time' ELSE 'none' END AS reason FROM n LEFT JOIN q ON q.pair = n.pair AND q.ts = n.ts LEFT JOIN n x ON x.pair = n.pair AND x.i = q.k""")
def _(spark, sf):
    return rounded(events.bounded_exit(tables.hourly_bars(spark, sf), 5, 20.0, 30.0))


@register("rs5_quarter_end", f"""WITH {RATES}, q AS (SELECT currency, date_trunc('quarter', ts)::TIMESTAMP AS quarter, arg_max(rate, ts) AS rate FROM rates GROUP BY ALL),
  g AS (SELECT currency, unnest(generate_series(min(quarter), max(quarter), INTERVAL 3 MONTH)) AS quarter FROM q GROUP BY currency)
  SELECT currency, quarter, round(last_value(rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY quarter), 6) AS rate FROM g LEFT JOIN q USING (currency, quarter)""")
def _(spark, sf):
    rates = tables.rates(spark, sf).select("currency", F.col("date").alias("ts"), F.col("rate_pct").alias("rate"))
    return rounded(resample.quarter_end(rates))


@register("led6_set_operations", f"""WITH {HOURLY}, a AS (SELECT ts FROM bars WHERE pair = 'click'), b AS (SELECT ts FROM bars WHERE pair = 'view')
  SELECT 'both' AS kind, ts FROM (SELECT ts FROM a INTERSECT SELECT ts FROM b) UNION ALL SELECT 'rest', ts FROM (SELECT DISTINCT ts FROM bars EXCEPT SELECT ts FROM a)""")
def _(spark, sf):
    bars = tables.hourly_bars(spark, sf)
    a, b = bars.where("pair = 'click'").select("ts"), bars.where("pair = 'view'").select("ts")
    return a.intersect(b).select(F.lit("both").alias("kind"), "ts").unionByName(bars.select("ts").subtract(a).select(F.lit("rest").alias("kind"), "ts"))


# ---- indicators and signals ----------------------------------------------------------------------------------------------------

BB = full("avg", "close", 20)
_indicator("ind9_by_names", f"{r(full('avg', 'close', 10), 'sma_10')}, {r(BB, 'bb_mid')}, {r(f'close / lag(close, 5) OVER {BY} - 1', 'mom_5')}", lambda b: ind.by_names(b, ["sma_10", "bb_20_2", "mom_5"]), ["sma_10", "bb_mid", "mom_5"])
CLASS = "(PARTITION BY pair, hour(ts) IN (2, 3, 4, 5) ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
SIGMA = f"CASE WHEN hour(ts) IN (2, 3, 4, 5) AND count(r) OVER {CLASS} = 10 THEN stddev_samp(r) OVER {CLASS} END"
_indicator("ind12_hour_class_sigma", r(SIGMA, "sigma"), lambda b: ind.hour_class_sigma(b, (2, 3, 4, 5), 10), ["sigma"], RET, table="t")
_indicator("ind14_ols_zscore", f"round(CASE WHEN count(y) OVER w = 30 THEN (y - avg(y) OVER w - covar_samp(i, y) OVER w / 77.5 * 14.5) / sqrt(var_samp(y) OVER w - (covar_samp(i, y) OVER w) ** 2 / 77.5) END, 5) AS z",
           lambda b: ind.ols_zscore(b, 30).withColumn("z", F.round("z", 5)), ["z"], f", t AS (SELECT pair, ts, ln(close) AS y, row_number() OVER {BY} AS i FROM bars)", DAILY, f"t WINDOW w AS {frame(30)}")
PASTW = "(PARTITION BY pair ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_indicator("ind18_spread_z", "round(CASE WHEN len(l) >= 2 THEN CASE WHEN mad > 0 THEN (x - m) / mad ELSE 0 END END, 6) AS spread_z", lambda b: ind.mad_zscore(b, "spread_mean_pips"), ["spread_z"],
           f", l AS (SELECT pair, ts, spread_mean_pips AS x, coalesce(list(spread_mean_pips) OVER {PASTW}, []) AS l FROM bars), m AS (SELECT *, list_median(l) AS m FROM l), t AS (SELECT *, list_median([abs(v - m) for v in l]) AS mad FROM m)", table="t")
_indicator("ind20_range_surprise", f"{r(past('quantile_cont(tr, 0.5)', 'tr', 50), 'usual')}, coalesce(tr > {past('quantile_cont(tr, 0.5)', 'tr', 50)} * 1.5, false) AS surprise", lambda b: ind.range_surprise(b, 50), ["usual", "surprise"], f", t AS (SELECT *, {TR} AS tr FROM bars)", table="t")


@register("sig5_ema_cross", f"SELECT f.pair, f.ts, coalesce(sign(round(f.v - s.v, 6)), 0)::DOUBLE AS signal FROM ({_ema_sql('close', 2 / 11, 10, DAILY)}) f JOIN ({_ema_sql('close', 2 / 41, 40, DAILY)}) s USING (pair, ts)")
def _(spark, sf):
    return signals.ema_cross(tables.daily_bars(spark, sf), 10, 40).select("pair", "ts", "signal")


@register("sig4_macd_cross", f"SELECT pair, ts, coalesce(sign(round(macd_hist, 6)), 0)::DOUBLE AS signal FROM (SELECT b.pair, b.ts, m.macd_hist FROM (WITH {HOURLY} SELECT pair, ts FROM bars) b LEFT JOIN ({MACD}) m USING (pair, ts))")
def _(spark, sf):
    return signals.macd_cross(tables.hourly_bars(spark, sf)).select("pair", "ts", "signal")


CARRY = f"""c AS (SELECT b.*, CASE WHEN abs(r.rate - 5) >= 0.01 THEN greatest(-1, least(1, (r.rate - 5) / 0.1)) ELSE 0 END AS carry
  FROM bars b ASOF LEFT JOIN {OWN_RATES} r ON b.pair = r.pair AND b.ts >= r.ts)"""


def _carry(spark, sf):
    rows = joins.asof(tables.daily_bars(spark, sf), _rate_rows(spark, sf), "rate").withColumn("diff", F.col("rate") - 5)
    return signals.carry(rows, "diff", 0.1, 0.01).withColumnRenamed("signal", "carry")


@register("sig8_carry_momentum", f"WITH {DAILY}, {RATES}, {CARRY}, a AS (SELECT *, greatest(-1, least(1, (close / ({full('avg', 'close', 20)}) - 1) / 0.02)) AS away, count(close) OVER {frame(20)} AS k FROM c) SELECT pair, ts, round(CASE WHEN k = 20 AND sign(carry) = sign(away) THEN carry * 0.5 + away * 0.5 ELSE 0 END, 6)::DOUBLE AS signal FROM a")
def _(spark, sf):
    return rounded(signals.carry_momentum(_carry(spark, sf), "carry").select("pair", "ts", "signal"))


VOL = f"({full('stddev_samp', 'r', 20)}) * sqrt(252)"
_indicator("sig9_vol_target", f"round(CASE WHEN ({VOL}) > 0 THEN greatest(0, least(2, 4 / ({VOL}))) / 2 ELSE 0 END, 6)::DOUBLE AS signal", lambda b: signals.vol_target(b, 4.0), ["signal"], RET, DAILY, "t")
_indicator("sig10_overnight_fade", f"CAST(CASE WHEN coalesce((epoch(lead(ts) OVER {BY}) - epoch(ts)) / 3600 <= 1, false) AND abs(r) > ({SIGMA}) * 1.0 THEN -sign(r) ELSE 0 END AS DOUBLE) AS signal", lambda b: signals.overnight_fade(b, k=1.0, n=10).withColumn("signal", F.col("signal") + 0.0), ["signal"], RET, table="t")

PAST24 = "(PARTITION BY pair ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
FAMILIES = f"""md AS (SELECT pair AS p, quantile_cont(spread_median_pips, 0.5) AS middle FROM bars GROUP BY pair), m0 AS (SELECT *, sign(close - open) AS move, ln(close / lag(close) OVER {BY}) AS lr,
  CASE WHEN hour(ts) = 8 THEN coalesce(sign(open - lag(close) OVER {BY}), 0) ELSE 0 END AS gap FROM bars JOIN md ON p = pair),
  m AS (SELECT *, coalesce(-last_value(nullif(move, 0) IGNORE NULLS) OVER {BY}, 0) AS against, coalesce(sign(round({full('avg', 'lr', 3)}, 12)), 0) AS three,
  CASE WHEN count(close) OVER {PAST24} = 24 THEN max(high - low) OVER {PAST24} END AS widest, greatest(-1, least(1, sum(gap) OVER {frame(4)})) AS drift FROM m0),
  fam AS (SELECT pair, ts, close, spread_median_pips, unnest({signals.FAMILIES}) AS family, unnest([against, CASE WHEN hour(ts) = 7 THEN move ELSE 0 END, three,
  CASE WHEN high - low > widest * 0.5 THEN move ELSE 0 END, drift, CASE WHEN spread_median_pips >= middle THEN 0 ELSE against END])::DOUBLE + 0.0 AS signal FROM m)"""


@register("sig12_intraday_families", f"WITH {HOURLY}, {FAMILIES} SELECT pair, ts, family, signal FROM fam")
def _(spark, sf):
    return signals.intraday_families(tables.hourly_bars(spark, sf)).select("pair", "ts", "family", "signal")


FW = "(PARTITION BY pair, family ORDER BY ts)"


SCREEN = f"""p AS (SELECT *, coalesce(lag(signal) OVER {FW}, 0) AS position FROM fam), q AS (SELECT *, coalesce(abs(position - lag(position) OVER {FW}), 0) AS turn,
  CASE WHEN spread_median_pips > 0 THEN coalesce(position * ln(close / lag(close) OVER {FW}), 0) / 0.0001 ELSE 0 END AS gross, CASE WHEN spread_median_pips > 0 THEN spread_median_pips ELSE 0 END AS spread FROM p),
  n AS (SELECT *, gross - turn * (spread + 0.8) AS net FROM q)"""
NET_SHARPE = "CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(6150) END"


@register("met22_family_screen", f"""WITH {HOURLY}, {FAMILIES}, {SCREEN}, s AS (SELECT pair, family, round(CASE WHEN stddev_samp(gross) > 0 THEN avg(gross) / stddev_samp(gross) * sqrt(6150) END, 6) AS gross_sharpe,
  round({NET_SHARPE}, 6) AS net_sharpe, sum(turn) AS turnover FROM n GROUP BY pair, family) SELECT *, CASE WHEN net_sharpe >= 1.76 THEN 'PASS' WHEN net_sharpe >= 1.44 THEN 'STRETCH' ELSE 'FAIL' END AS verdict FROM s""")
def _(spark, sf):
    return rounded(metrics.family_screen(signals.intraday_families(tables.hourly_bars(spark, sf))))


def _shared_sharpe(name: str, where: str) -> str:
    return f"""{name} AS (SELECT family, round(CASE WHEN stddev_samp(m) > 0 THEN avg(m) / stddev_samp(m) * sqrt(6150) END, 6) AS {name} FROM (SELECT family, ts, avg(net) AS m FROM n {where} GROUP BY family, ts
  HAVING count(*) = (SELECT count(DISTINCT pair) FROM n {where})) GROUP BY family)"""


@register("met22_family_summary", f"""WITH {HOURLY}, {FAMILIES}, {SCREEN}, c AS (SELECT pair, family, round({NET_SHARPE}, 9) AS x FROM n GROUP BY pair, family),
  {_shared_sharpe('portfolio', '')}, {_shared_sharpe('portfolio_subset', "WHERE pair IN ('click', 'view')")}
  SELECT family, {r('min(x)', 'least')}, {r('quantile_cont(x, 0.5)', 'middle')}, {r('max(x)', 'most')}, (count(*) FILTER (WHERE x > 0))::BIGINT AS positive, any_value(portfolio) AS portfolio, any_value(portfolio_subset) AS portfolio_subset
  FROM c LEFT JOIN portfolio USING (family) LEFT JOIN portfolio_subset USING (family) GROUP BY family""")
def _(spark, sf):
    return rounded(metrics.family_summary(signals.intraday_families(tables.hourly_bars(spark, sf)), ["click", "view"]))


@register("sig14_blend", f"WITH {DAILY}, t AS (SELECT pair, ts, {SMA_SIGNAL} AS x, {MOM_SIGNAL} AS y FROM bars) SELECT pair, ts, round(greatest(-1, least(1, (0.7 * x + 0.3 * y) / 1.0)), 6)::DOUBLE AS signal FROM t")
def _(spark, sf):
    bars = tables.daily_bars(spark, sf)
    both = signals.sma_cross(bars).select("pair", "ts", "signal", F.lit("sma").alias("strategy")).unionByName(signals.momentum_signal(bars).select("pair", "ts", "signal", F.lit("mom").alias("strategy")))
    return rounded(signals.blend(both, {"sma": 0.7, "mom": 0.3}))


AWAY = f"close / ({full('avg', 'close', 50)}) - 1"


@register("sig15_trend_filters", f"WITH {DAILY}, {RATES}, {CARRY}, a AS (SELECT *, {AWAY} AS away FROM c) SELECT pair, ts, coalesce(away > 0, false)::INT::DOUBLE AS trend, (coalesce(away > 0, false) AND carry > 0)::INT::DOUBLE AS trend_carry, round(coalesce(CASE WHEN away IS NULL THEN NULL ELSE greatest(0, least(1, away / 0.02)) END, 0), 6)::DOUBLE AS strength FROM a")
def _(spark, sf):
    return rounded(signals.trend_filters(_carry(spark, sf), "carry").select("pair", "ts", "trend", "trend_carry", "strength"))


def md5u(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0"


AT = "pair || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)"


@register("sig17_degraded", f"""WITH {DAILY}, s AS (SELECT pair, ts, {SMA_SIGNAL} AS signal FROM bars), m AS (SELECT pair, ts, CASE WHEN {md5u("'1|d|' || " + AT)} < 0.25 THEN floor({md5u("'1|v|' || " + AT)} * 3) - 1 ELSE signal END AS x FROM s)
  SELECT pair, ts, coalesce(lag(x) OVER {BY}, 0)::DOUBLE AS signal FROM m""")
def _(spark, sf):
    return signals.degraded(signals.sma_cross(tables.daily_bars(spark, sf)), 0.25, 1).select("pair", "ts", "signal")


# ---- costs and sizes -----------------------------------------------------------------------------------------------------------

@register("cst1_fixed_costs", f"WITH {HOURLY} SELECT pair, ts, {r('spread_median_pips / 2 + 0.3', 'entry_cost')}, {r('spread_median_pips / 2 + 0.3 + 0.5', 'exit_cost')} FROM bars")
def _(spark, sf):
    s = F.col("spread_median_pips")
    return rounded(tables.hourly_bars(spark, sf).select("pair", "ts", costs.entry_cost(s, 0.3).alias("entry_cost"), costs.exit_cost(s, 0.3, 0.5).alias("exit_cost")))


@register("cst2_holding_cost", f"WITH {DAILY}, {POS}, {TRADES} SELECT pair, entry_time, round(CASE WHEN direction > 0 THEN 0.4 WHEN direction < 0 THEN -0.1 ELSE 0 END * date_diff('day', entry_time, exit_time), 6)::DOUBLE AS cost FROM trades")
def _(spark, sf):
    days = F.datediff("exit_time", "entry_time")
    return rounded(_trades(spark, sf).select("pair", "entry_time", costs.holding_cost(F.col("direction"), days, -0.4, 0.1).alias("cost")))


@register("cst5_hour_curve_cost", f"WITH {HOURLY}, c AS (SELECT pair AS p, hour(ts) AS h, quantile_cont(spread_pips, 0.5) AS s FROM ticks WHERE isodow(ts) < 6 GROUP BY ALL) SELECT pair, ts, round(coalesce(s, 2.5), 6) AS curve_spread FROM bars LEFT JOIN c ON p = pair AND h = hour(ts)")
def _(spark, sf):
    curve = resample.hour_curve(tables.ticks(spark, sf))
    return rounded(costs.hour_curve_cost(tables.hourly_bars(spark, sf), curve, 2.5).select("pair", "ts", "curve_spread"))


@register("cst6_static_round_trip", f"WITH {DAILY}, {POS}, {TRADES} SELECT pair, entry_time, round(pnl_pips - 7.5, 2) AS net_pips FROM trades")
def _(spark, sf):
    return _trades(spark, sf).select("pair", "entry_time", F.round(F.col("pnl_pips") - costs.static_round_trip(), 2).alias("net_pips"))


@register("cst7_stressed_costs", f"WITH {DAILY}, {POS} SELECT pair, multiplier::DOUBLE AS multiplier, round(sum(cost_pips * multiplier), 4) AS cost_pips FROM q, (VALUES (1.0), (1.5), (2.0)) m(multiplier) GROUP BY pair, multiplier")
def _(spark, sf):
    rows = simulate.turnover_cost(signals.sma_cross(tables.daily_bars(spark, sf)), "spread_median_pips", 0.8)
    return costs.stressed(rows, "cost_pips", [1.0, 1.5, 2.0]).groupBy("pair", "multiplier").agg(F.round(F.sum("cost_pips"), 4).alias("cost_pips"))


@register("sz2_to_sz5_sizes", f"""WITH {DAILY}, t AS (SELECT *, {TR} AS tr FROM bars), a AS (SELECT *, {full('avg', 'tr', 14)} AS atr, {SMA_SIGNAL} AS s FROM t) SELECT pair, ts, round(100 / (CASE WHEN atr > 0 THEN atr ELSE close * 0.02 END), 9) AS atr_size,
  CASE WHEN least(abs(s) * 0.6 * 0.5 * 10, 10) >= 1 THEN least(abs(s) * 0.6 * 0.5 * 10, 10) ELSE 0 END::DOUBLE AS continuous, CASE WHEN least(least(abs(s), 1) * 0.5 * 10000, 4000) >= 100 THEN least(least(abs(s), 1) * 0.5 * 10000, 4000) ELSE 0 END::DOUBLE AS vol_target,
  round(CASE WHEN pair LIKE '%HIGH' THEN 1000 ELSE 1000 / close END, 9)::DOUBLE AS units FROM a""")
def _(spark, sf):
    rows, s = signals.sma_cross(ind.atr_simple(tables.daily_bars(spark, sf))), F.col("signal")
    return rounded(rows.select(
        "pair", "ts", costs.atr_size(F.lit(10000.0), F.col("atr"), F.col("close")).alias("atr_size"), costs.continuous_size(s, 0.6, 0.5, 10.0, 1.0).alias("continuous"),
        costs.vol_target_size(s, 10000.0, 0.5, 4000.0, 100.0).alias("vol_target"), costs.quote_units(F.col("pair"), F.lit(1000.0), F.col("close"), "HIGH").alias("units"),
    ), 9)


# ---- grids and nulls -----------------------------------------------------------------------------------------------------------

SHARPE = "round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6)"
NET_OF = f"""p AS (SELECT *, coalesce(lag(signal) OVER {BY}, 0) AS position FROM s), q AS (SELECT *, abs(position - coalesce(lag(position) OVER {BY}, 0)) * (spread_median_pips + 0.8) AS cost_pips FROM p),
  net AS (SELECT *, coalesce(position * ln(close / lag(close) OVER {BY}), 0) - cost_pips * 0.0001 / close AS ret FROM q)"""
#: Draws of the reference's null gate and of its bootstrap tests.
NULLS, RESAMPLES = 1000, 10_000


def _drawn(n: int) -> str:
    return f"""d AS (SELECT pair || '#' || draw AS pair, ts, close, spread_median_pips FROM bars, range({n}) x(draw)), f AS (SELECT *, CASE WHEN {md5u("'1|0|c|' || " + AT)} < 0.2 THEN floor({md5u("'1|0|v|' || " + AT)} * 3) - 1 END AS fresh FROM d),
  s AS (SELECT *, coalesce(last_value(fresh IGNORE NULLS) OVER {BY}, 0)::DOUBLE AS signal FROM f), {NET_OF}"""


DRAWN = _drawn(10)


def _null_cells(spark, sf, n=10):
    bars = tables.daily_bars(spark, sf).select("pair", "ts", "close", "spread_median_pips")
    rows = simulate.net_returns(signals.random_signals(stats.draws(bars, n), 0))
    return rows.groupBy("pair").agg(stats.sharpe().alias("sharpe"))


@register("bt12_null_grid", f"WITH {DAILY}, {DRAWN} SELECT pair, {SHARPE} AS sharpe FROM net GROUP BY pair")
def _(spark, sf):
    return rounded(_null_cells(spark, sf))


def _null_rank(spark, sf, n=10):
    candidate = _net(spark, sf).groupBy("pair").agg(F.round(stats.sharpe(), 6).alias("sharpe"))
    nulls = _null_cells(spark, sf, n).select(F.split_part("pair", F.lit("#"), F.lit(1)).alias("pair"), F.round("sharpe", 6).alias("sharpe"))
    return rounded(stats.null_rank(candidate, nulls))


@register("st11_null_rank", f"WITH {DAILY}, {POS}, c AS (SELECT pair, {SHARPE} AS sharpe FROM net GROUP BY pair), n AS (WITH {DRAWN} SELECT split_part(pair, '#', 1) AS pair, {SHARPE} AS ns FROM net GROUP BY net.pair) SELECT pair, sharpe, count(*) AS draws, round(avg((ns < sharpe)::INT), 6) AS rank, round(avg(ns), 6) AS null_mean, round(stddev_pop(ns), 6) AS null_std FROM n JOIN c USING (pair) GROUP BY pair, sharpe")
def _(spark, sf):
    return _null_rank(spark, sf)


@register("bt12_null_grid_full", f"WITH {DAILY}, {_drawn(NULLS)} SELECT pair, {SHARPE} AS sharpe FROM net GROUP BY pair")
def _(spark, sf):
    return rounded(_null_cells(spark, sf, NULLS))


@register("st11_null_rank_full", f"WITH {DAILY}, {POS}, c AS (SELECT pair, {SHARPE} AS sharpe FROM net GROUP BY pair), n AS (WITH {_drawn(NULLS)} SELECT split_part(pair, '#', 1) AS pair, {SHARPE} AS ns FROM net GROUP BY net.pair) SELECT pair, sharpe, count(*) AS draws, round(avg((ns < sharpe)::INT), 6) AS rank, round(avg(ns), 6) AS null_mean, round(stddev_pop(ns), 6) AS null_std FROM n JOIN c USING (pair) GROUP BY pair, sharpe")
def _(spark, sf):
    return _null_rank(spark, sf, NULLS)


CELLS = [(3, 10), (5, 20), (10, 40), (20, 60)]
SWEPT = f"""cells AS ({' UNION ALL '.join(f"SELECT pair || '#{a}-{b}' AS pair, ts, close, spread_median_pips, coalesce(sign({full('avg', 'close', a)} - {full('avg', 'close', b)}), 0)::DOUBLE AS signal FROM bars" for a, b in CELLS)}), s AS (SELECT * FROM cells), {NET_OF}"""


def _sweep(spark, sf):
    rows = simulate.net_returns(stats.sma_grid(tables.daily_bars(spark, sf), CELLS)).groupBy("pair").agg(stats.sharpe().alias("sharpe"))
    return rows.select(F.split_part("pair", F.lit("#"), F.lit(1)).alias("pair"), F.split_part("pair", F.lit("#"), F.lit(2)).alias("cell"), F.round("sharpe", 6).alias("sharpe"))


SWEEP = f"WITH {DAILY}, {SWEPT}, w AS (SELECT split_part(pair, '#', 1) AS pair, split_part(pair, '#', 2) AS cell, {SHARPE} AS sharpe FROM net GROUP BY net.pair)"


@register("bt14_sweep", f"{SWEEP} SELECT * FROM w")
def _(spark, sf):
    return _sweep(spark, sf)


@register("top2_best_cell", f"{SWEEP} SELECT pair, arg_max(cell, (sharpe, cell)) AS cell, max(sharpe) AS sharpe, count(*) AS cells FROM w GROUP BY pair")
def _(spark, sf):
    return stats.best_cell(_sweep(spark, sf), ["pair"], "sharpe", "cell")


@register("bt15_diagnosis", f"WITH {DAILY}, t AS (SELECT pair, CAST({SMA_SIGNAL} AS INT) AS direction, lead(close) OVER {BY} / close - 1 AS nxt FROM bars) SELECT pair, direction, count(*) AS bars, {r('avg(nxt)', 'next_ret')}, {r('avg((nxt * direction > 0)::INT)', 'hit')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY pair)', 'share')} FROM t GROUP BY pair, direction")
def _(spark, sf):
    return rounded(metrics.diagnosis(signals.sma_cross(tables.daily_bars(spark, sf))))


@register("bt8_event_entries", f"""WITH {HOURLY}, n AS (SELECT pair AS p, (isodow(ts) - 1) * 24 + hour(ts) AS k, greatest(quantile_cont(volume, 0.5), 1.0) AS norm FROM bars GROUP BY ALL),
  t AS (SELECT *, lead(open) OVER {BY} AS a, lead(close, 2) OVER {BY} AS b FROM bars) SELECT pair, ts, {r('a', 'entry')}, {r('b', 'exit')}, {r('b - a', 'gross')} FROM t JOIN n ON pair = p AND (isodow(ts) - 1) * 24 + hour(ts) = k WHERE hour(ts) IN (7, 12) AND volume / norm >= 1.2""")
def _(spark, sf):
    rows = events.entry_exit(ind.relative_to_season(tables.hourly_bars(spark, sf), "volume", "relvol"))
    return rounded(rows.where(F.hour("ts").isin(7, 12) & (F.col("relvol") >= 1.2)).select("pair", "ts", "entry", "exit", (F.col("exit") - F.col("entry")).alias("gross")))


@register("met6_walk_forward", f"WITH {DAILY}, {POS}, n AS (SELECT *, row_number() OVER {BY} - 1 - 100 AS i FROM net), x AS (SELECT pair, ret, w FROM n, range(100000) g(w) WHERE i >= 0 AND w * 30 <= i AND i < w * 30 + 60 AND w <= (SELECT max(i) FROM n)) SELECT pair, w AS window, count(*) AS n, {SHARPE} AS sharpe FROM x GROUP BY pair, w HAVING count(*) = 60")
def _(spark, sf):
    return rounded(stats.walk_forward(_net(spark, sf), 100, 60, 30))


@register("met8_purged_folds", f"""WITH {DAILY}, {POS}, n AS (SELECT pair, ret, row_number() OVER {BY} - 1 AS i, count(*) OVER (PARTITION BY pair) AS size FROM net), f AS (SELECT a::VARCHAR || '-' || b::VARCHAR AS fold, [a, b] AS held FROM range(5) x(a), range(5) y(b) WHERE a < b),
  g AS (SELECT pair, fold, ret, list_contains(held, i * 5 // size) AS test, list_contains(held, least(size - 1, i + 4) * 5 // size) OR list_contains(held, greatest(0, i - 6) * 5 // size) AS near FROM n, f)
  SELECT pair, fold, count_if(NOT test AND NOT near)::BIGINT AS n_train, count_if(test)::BIGINT AS n_test, round(coalesce(avg(CASE WHEN test THEN ret END) / nullif(stddev_samp(CASE WHEN test THEN ret END), 0) * sqrt(252), 0), 6) AS sharpe FROM g GROUP BY pair, fold""")
def _(spark, sf):
    return rounded(stats.purged_folds(_net(spark, sf), 5, 2, 4, 6))


BOOT = f"""WITH {DAILY}, {POS}, n AS (SELECT pair, ret, row_number() OVER {BY} - 1 AS t, count(*) OVER (PARTITION BY pair) AS size FROM net), d AS (SELECT pair, t, size, draw, pair || '|' || draw || '|' || t AS k FROM n, range(8) x(draw)),
  st AS (SELECT *, CASE WHEN t = 0 OR {md5u("'1|r|' || k")} < 0.1 THEN t END AS b, floor({md5u("'1|i|' || k")} * size)::BIGINT AS u FROM d),
  l AS (SELECT pair, draw, t, size, last_value(b IGNORE NULLS) OVER w AS b, last_value(CASE WHEN b IS NOT NULL THEN u END IGNORE NULLS) OVER w AS u FROM st WINDOW w AS (PARTITION BY pair, draw ORDER BY t)),
  m AS (SELECT l.pair, l.draw, avg(n.ret) AS mean FROM l JOIN n ON n.pair = l.pair AND n.t = (l.u + l.t - l.b) % l.size GROUP BY ALL)"""


@register("st3_stationary_bootstrap", f"{BOOT} SELECT pair, CAST(draw AS INT) AS draw, {r('mean', 'mean', 9)} FROM m")
def _(spark, sf):
    return rounded(stats.stationary_bootstrap(_net(spark, sf), 8, 10.0), 9)


@register("st4_zero_mean_test", f"{BOOT}, o AS (SELECT pair, avg(ret) AS o FROM net GROUP BY pair) SELECT pair, round(o, 9) AS mean, round(avg((round(m.mean - 2 * o, 12) >= 0)::INT), 6) AS p FROM m JOIN o USING (pair) GROUP BY pair, o")
def _(spark, sf):
    return rounded(stats.bootstrap_p(_net(spark, sf), 8, 10.0), 9)


@register("st3_stationary_bootstrap_full")
def _(spark, sf):
    return rounded(stats.bootstrap_draws(_net(spark, sf), RESAMPLES, [("p", 10.0)]).select("pair", "draw", "mean", "null_sharpe"), 9)


@register("st4_zero_mean_test_full")
def _(spark, sf):
    return rounded(stats.zero_mean_test(_net(spark, sf), RESAMPLES), 9)


@register("st14_event_summary", f"WITH {DAILY}, {POS}, {TRADES} SELECT pair, count(pnl_pips) AS events, {r('CASE WHEN stddev_samp(pnl_pips) > 0 THEN avg(pnl_pips) / stddev_samp(pnl_pips) ELSE 0 END', 'sharpe')}, {r('avg((pnl_pips > 0)::INT)', 'continued')} FROM trades GROUP BY ROLLUP (pair)")
def _(spark, sf):
    return rounded(events.summary(_trades(spark, sf), "pair", "pnl_pips"))


RULES = [("too_few", "trades", "<", 30.0, 1), ("hit", "win_rate", ">=", 0.3, 3), ("loss", "avg_pips", "<=", 1e9, 2)]


@register("st15_triggers", f"""WITH {DAILY}, {POS}, {TRADES}, m AS (SELECT 'trades' AS metric, count(*)::DOUBLE AS value FROM trades UNION ALL SELECT 'win_rate', avg((pnl_pips > 0)::INT) FROM trades UNION ALL SELECT 'avg_pips', avg(pnl_pips) FROM trades)
  , f AS (SELECT label, metric, priority, round(value, 2) AS value, CASE op WHEN '<' THEN value < t WHEN '>=' THEN value >= t ELSE value <= t END AS fired FROM (VALUES {', '.join(map(str, RULES))}) x(label, metric, op, t, priority) LEFT JOIN m USING (metric))
  SELECT label, metric, value, fired, fired AND priority = (SELECT min(priority) FROM f WHERE fired) AS named FROM f""")
def _(spark, sf):
    wide = _trades(spark, sf).agg(F.count("*").cast("double").alias("trades"), F.avg((F.col("pnl_pips") > 0).cast("double")).alias("win_rate"), F.avg("pnl_pips").alias("avg_pips"))
    rules = spark.createDataFrame(RULES, "label string, metric string, operator string, threshold double, priority int")
    return rounded(stats.evaluate(wide.unpivot([], ["trades", "win_rate", "avg_pips"], "metric", "value"), F.broadcast(rules)), 2)


# ---- portfolios and reports ----------------------------------------------------------------------------------------------------

@register("met5_drawdown_catalogue", f"""WITH {DAILY}, eq AS (SELECT pair, ts, close AS equity, max(close) OVER {BY} AS peak FROM bars), i AS (SELECT *, count_if(equity >= peak) OVER {BY} AS island, 1 - equity / peak AS dd FROM eq),
  n AS (SELECT pair, island, min(ts) AS peak_ts, max(dd) AS depth, arg_max(ts, (dd, -epoch(ts))) AS trough_ts FROM i GROUP BY ALL), l AS (SELECT *, lead(peak_ts) OVER (PARTITION BY pair ORDER BY island) AS recovery_ts FROM n)
  SELECT pair, peak_ts, trough_ts, recovery_ts, {r('depth', 'depth')}, CAST(row_number() OVER (PARTITION BY pair ORDER BY depth DESC, peak_ts) AS INT) AS rank FROM l WHERE depth >= 0.05""")
def _(spark, sf):
    return rounded(metrics.drawdown_catalogue(tables.daily_bars(spark, sf).withColumn("equity", F.col("close"))))


@register("top1_worst_drawdowns", f"""WITH {DAILY}, eq AS (SELECT pair, ts, close AS equity, max(close) OVER {BY} AS peak FROM bars), i AS (SELECT *, count_if(equity >= peak) OVER {BY} AS island, 1 - equity / peak AS dd FROM eq)
  SELECT pair, min(ts) AS peak_ts, {r('max(dd)', 'depth')} FROM i GROUP BY pair, island ORDER BY max(dd) DESC, pair, min(ts) LIMIT 5""")
def _(spark, sf):
    rows = metrics.drawdown_catalogue(tables.daily_bars(spark, sf).withColumn("equity", F.col("close")))
    return rounded(rows.orderBy(F.desc("depth"), "pair", "peak_ts").limit(5).select("pair", "peak_ts", "depth"))


@register("top3_latest_trials", "SELECT o_orderkey AS trial_id, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    return tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_orderdate").cast("timestamp").alias("ts")).orderBy(F.desc("ts"), "trial_id").limit(20)


@register("met11_vol_weighted", f"WITH {HOURLY}{SIMPLE}, v AS (SELECT pair, least(1.0 / stddev_samp(ret), 5) AS w FROM x GROUP BY pair) SELECT ts, {r('sum(w * ret) / sum(w)', 'ret')} FROM x JOIN v USING (pair) GROUP BY ts")
def _(spark, sf):
    return rounded(metrics.vol_weighted(_returns(tables.hourly_bars(spark, sf)), 1.0))


@register("met12_rolling_basket", f"WITH {HOURLY}{SIMPLE}, k AS (SELECT *, 1.0 / nullif({full('stddev_samp', 'ret', 20)}, 0) AS k FROM x), s AS (SELECT ts, ret * lag(k) OVER {BY} AS v FROM k) SELECT ts, {r('avg(v)', 'ret')} FROM s WHERE v IS NOT NULL GROUP BY ts")
def _(spark, sf):
    return rounded(metrics.rolling_basket(_returns(tables.hourly_bars(spark, sf)), 1.0, 20))


@register("met13_cross_pair", f"""WITH {DAILY}, {POS}, e AS (SELECT pair, ts, ret, exp(sum(ln(1 + ret)) OVER {BY}) AS equity FROM (SELECT pair, ts, ret / 100 AS ret FROM net)), d AS (SELECT *, max(equity) OVER {BY} AS peak FROM e),
  c AS (SELECT pair, {SHARPE} AS sharpe, max(greatest(0, least(1, 1 - equity / peak))) AS dd, count(*) AS bars FROM d GROUP BY pair) SELECT 'sma' AS strategy, count(*) AS cells, {r('avg(sharpe)', 'mean_sharpe', 5)}, {r('max(dd)', 'worst_drawdown')}, min(bars) AS least_bars FROM c""")
def _(spark, sf):
    rows = metrics.drawdowns(metrics.equity_from_returns(_net(spark, sf).withColumn("ret", F.col("ret") / 100)))
    cells = rows.groupBy("pair").agg(F.round(stats.sharpe(), 6).alias("sharpe"), F.max("drawdown").alias("max_drawdown"), F.count("*").alias("bars")).withColumn("strategy", F.lit("sma"))
    return rounded(metrics.cross_pair(cells)).withColumn("mean_sharpe", F.round("mean_sharpe", 5))


@register("met15_execution_report", f"SELECT l_returnflag AS pair, count(*) AS fills, {r("""avg((l_linestatus = 'F')::INT)""", 'success', 8)}, {r('avg(l_discount)', 'avg_slippage', 8)}, {r('avg(l_tax)', 'avg_spread', 8)} FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(spark, sf):
    fills = tables.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("pair"), (F.col("l_linestatus") == "F").alias("success"), F.col("l_discount").alias("slippage_pips"), F.col("l_tax").alias("spread_at_fill"))
    return rounded(metrics.execution_report(fills), 8)


@register("met16_go_no_go", f"WITH {DAILY}, {POS}, {TRADES}, sh AS (SELECT pair, {SHARPE} AS sharpe FROM net GROUP BY pair), t AS (SELECT pair, count(*) AS trades FROM trades GROUP BY pair), e AS (SELECT *, sharpe > 0.1 AND trades >= 5 AS edge FROM sh JOIN t USING (pair)) SELECT pair, sharpe, trades, edge, bool_or(edge) OVER () AS go FROM e")
def _(spark, sf):
    a = _net(spark, sf).groupBy("pair").agg(F.round(stats.sharpe(), 6).alias("sharpe"))
    return metrics.go_no_go(a.join(_trades(spark, sf).groupBy("pair").agg(F.count("*").alias("trades")), "pair"), 0.1, 5)


CORR = f"WITH {HOURLY}{SIMPLE}, m AS (SELECT x.pair AS a, y.pair AS b, count(*) AS n, corr(x.ret, y.ret) AS rho FROM x JOIN x y ON x.ts = y.ts AND x.pair < y.pair GROUP BY ALL)"


@register("met17_correlations", f"{CORR} SELECT a, b, n, {r('rho', 'rho')} FROM m")
def _(spark, sf):
    return rounded(metrics.correlations(_returns(tables.hourly_bars(spark, sf))))


@register("met17_effective_bets", f"{CORR}, k AS (SELECT (1 + sqrt(1 + 8 * count(*))) / 2 AS k, sum(rho * rho) AS q, avg(rho) AS mean_rho FROM m) SELECT k::BIGINT AS series, {r('mean_rho', 'mean_rho')}, {r('k * k / (k + 2 * q)', 'effective')} FROM k")
def _(spark, sf):
    return rounded(metrics.effective_bets(metrics.correlations(_returns(tables.hourly_bars(spark, sf)))))


@register("met20_stratified", f"WITH {HOURLY}, m AS (SELECT pair, quantile_cont(volume, 0.5) AS mx, quantile_cont(high - low, 0.5) AS my FROM bars GROUP BY pair) SELECT pair, volume > mx AS x_high, high - low > my AS y_high, count(*) AS n, {r('avg(close - open)', 'mean')} FROM bars JOIN m USING (pair) GROUP BY ALL")
def _(spark, sf):
    rows = tables.hourly_bars(spark, sf).withColumns({"rng": F.col("high") - F.col("low"), "move": F.col("close") - F.col("open")})
    return rounded(metrics.stratified(rows, "volume", "rng", "move"))


@register("met21_gates", f"WITH {DAILY}, {POS}, {TRADES}, g AS (SELECT pair, count(*) AS trades, avg((pnl_pips > 0)::INT) AS hit, avg(pnl_pips) AS net FROM trades GROUP BY pair) SELECT pair, trades, {r('hit', 'hit')}, {r('net', 'net', 2)}, CASE WHEN trades < 20 THEN 'power' WHEN hit < 0.4 THEN 'hit_rate' WHEN net < 0 THEN 'net_pips' ELSE 'pass' END AS gate FROM g")
def _(spark, sf):
    return rounded(metrics.gates(_trades(spark, sf), 20, 0.4, 0.0)).withColumn("net", F.round("net", 2))


# ---- ledger --------------------------------------------------------------------------------------------------------------------

CLASSIFIED = "cl AS (SELECT o_custkey AS trial_id, max(o_orderkey) % 2 = 0 AS counted FROM orders GROUP BY o_custkey HAVING min(o_orderdate) < TIMESTAMP '1992-06-01')"


@register("led3_deflation_denominator", f"""WITH {LEDGER}, {CLASSIFIED}, l AS (SELECT trial_id, arg_max(status, seq) AS status, arg_max(config_hash, seq) AS config_hash, arg_max({{'s': sharpe}}, seq).s AS sharpe, min(seq) AS first, bool_or(status = 'P' OR NOT counts) AS gone FROM ledger GROUP BY trial_id),
  m AS (SELECT l.*, counted AS legacy FROM l LEFT JOIN cl USING (trial_id)), d AS (SELECT *, CASE WHEN legacy THEN 0 ELSE 1 END AS late FROM m WHERE (legacy AND sharpe IS NOT NULL) OR (legacy IS NULL AND NOT gone AND NOT (sharpe IS NULL AND status = 'O'))),
  k AS (SELECT trial_id, late, sharpe IS NULL OR row_number() OVER (PARTITION BY config_hash, sharpe ORDER BY late, first, trial_id) = 1 AS kept FROM d)
  SELECT trial_id, 'legacy' AS how FROM cl WHERE counted UNION ALL SELECT trial_id, 'new' FROM k WHERE late = 1 AND kept""")
def _(spark, sf):
    first = tables.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("trial_id")).agg(F.min("o_orderdate").alias("first"), (F.max("o_orderkey") % 2 == 0).alias("counted"))
    classified = first.where("first < timestamp_ntz'1992-06-01'").select("trial_id", "counted")
    return ledger.deflation_denominator(_ledger(spark, sf), classified, "P", "O")


@register("led5_params_hash", """SELECT o_orderpriority AS strategy, count(DISTINCT substr(sha256('{"a":"' || o_orderstatus || '","k":' || (o_custkey % 50) || '}'), 1, 12)) AS trials, min(substr(sha256('{"a":"' || o_orderstatus || '","k":' || (o_custkey % 50) || '}'), 1, 12)) AS first_hash FROM orders GROUP BY 1""")
def _(spark, sf):
    h = ledger.params_hash({"k": F.col("o_custkey") % 50, "a": F.col("o_orderstatus")})
    return tables.read(spark, sf, "orders").withColumn("h", h).groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.countDistinct("h").alias("trials"), F.min("h").alias("first_hash"))


@register("led7_level_run", f"""WITH {RATES}, q AS (SELECT currency AS pair, date_trunc('quarter', ts) AS ts, arg_max(rate, ts) AS rate FROM rates GROUP BY 1, 2), i AS (SELECT *, count_if(NOT rate >= 5) OVER {BY} AS island FROM q),
  n AS (SELECT pair, island, count_if(rate >= 5) AS n FROM i GROUP BY ALL) SELECT pair, CAST(max(n) AS BIGINT) AS run FROM n GROUP BY pair""")
def _(spark, sf):
    rates = tables.rates(spark, sf).select("currency", F.col("date").alias("ts"), F.col("rate_pct").alias("rate"))
    q = resample.quarter_end(rates).select(F.col("currency").alias("pair"), F.col("quarter").alias("ts"), "rate")
    return ledger.longest_level_run(q, "rate", 5.0)


@register("led9_limit_check", """WITH b AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS ts, l_returnflag AS strategy_id, sum(l_quantity) AS notional FROM lineitem GROUP BY 1, 2), a AS (SELECT ts, sum(notional) AS all_notional FROM b GROUP BY ts)
  SELECT ts, strategy_id, notional, all_notional, CASE WHEN notional > 2000 THEN 'strategy' WHEN all_notional > 2000 THEN 'aggregate' ELSE 'none' END AS breach FROM b JOIN a USING (ts)""")
def _(spark, sf):
    p = tables.read(spark, sf, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp").alias("ts"), F.col("l_returnflag").alias("strategy_id"), F.col("l_quantity").alias("notional"))
    return ledger.limit_check(p, 2000.0, 2000.0)


# ---- files and streams ---------------------------------------------------------------------------------------------------------

@register("src5_broker_bars", "SELECT o_orderpriority AS pair, o_orderdate AS ts, round(o_totalprice + 0.5, 6) AS close, o_totalprice AS close_bid, o_totalprice + 1 AS close_ask FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) = 1")
def _(spark, sf):
    from tidemark.sources import files

    bid, ask = F.col("o_totalprice"), F.col("o_totalprice") + 1
    bar = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Time"), *(v.alias(f"{c}{s}") for c in ("Open", "High", "Low", "Close") for s, v in (("Bid", bid), ("Ask", ask))))
    replies = tables.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("pair"), F.col("o_orderkey").alias("seq"), F.to_json(F.array(bar)).alias("body"))
    return rounded(files.broker_bars(replies).select("pair", "ts", "close", "close_bid", "close_ask"))


@register("str1_live_bars", f"WITH {HOURLY}, m AS (SELECT max(ts) AS z FROM ticks) SELECT pair, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')} FROM bars, m WHERE ts + INTERVAL 1 HOUR <= z - INTERVAL 10 MINUTE")
def _(spark, sf):
    from tidemark.sources import files
    from tidemark.streaming import jobs

    raw = jobs.tick_stream(spark, sf, tables.read(spark, sf, "events").schema, "events.parquet")
    folder = files.scratch(spark, "str1")
    jobs.run_to_end(jobs.live_bars(tables.as_ticks(raw)), folder)
    return rounded(spark.read.parquet(f"{folder}/out"))


@register("str4_drawdown_ladder", f"""WITH {DAILY}, t AS (SELECT pair, ts, close, hash5, max(CASE WHEN hash5 <> 0 THEN close END) OVER {BY} AS peak FROM (SELECT *, CAST(day(ts) % 5 AS INT) AS hash5 FROM bars)),
  d AS (SELECT *, coalesce(greatest(0, 1 - close / peak), 0) AS dd FROM t) SELECT pair, ts, {r('dd', 'drawdown')}, (dd >= 0.1)::INT + (dd >= 0.15)::INT + (dd >= 0.2)::INT AS level, CASE WHEN dd >= 0.2 THEN 0 WHEN dd >= 0.15 THEN 0.5 ELSE 1 END::DOUBLE AS size FROM d""")
def _(spark, sf):
    from tidemark.streaming import jobs

    rows = tables.daily_bars(spark, sf).select("pair", "ts", F.col("close").alias("equity"), (F.dayofmonth("ts") % 5 == 0).alias("is_mock"))
    return rounded(jobs.ladder(rows).select("pair", "ts", "drawdown", "level", "size"))


@register("str8_swap_accrual", f"WITH {DAILY} SELECT pair, ts, round(coalesce((epoch(ts) - epoch(lag(ts) OVER {BY})) / 86400 * 0.25 * lag(volume) OVER {BY}, 0), 6) AS accrued FROM bars")
def _(spark, sf):
    from tidemark.streaming import jobs

    rows = tables.daily_bars(spark, sf).withColumn("held", F.col("volume"))
    return rounded(jobs.swap_accrual(rows, 0.25).select("pair", "ts", "accrued"))


for _name in ("rs4_hour_curve", "dq8_missing_hours", "cst5_hour_curve_cost", "rs5_quarter_end", "jn8_widest_bar"):  # second names of queries over whole tables
    QUERIES[f"{_name}_whole"], SQL[f"{_name}_whole"] = QUERIES[_name], SQL[_name]
