"""Registered queries of the market operators, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import indicators as ind, joins, ledger, metrics, quality, resample, signals, simulate
from tidemark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- the stand-in tables in SQL ------------------------------------------------------------------------------------------------

TICKS = """ticks AS (SELECT event_type AS pair, ts, value AS mid, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ask_vol,
  CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 + 1 AS DOUBLE) AS spread_pips, event_id AS seq FROM events)"""
DAILY_TICKS = """ticks AS (SELECT o_orderpriority AS pair, o_orderdate AS ts, o_totalprice AS mid, 1.0 AS ask_vol,
  CAST(o_custkey % 7 + 1 AS DOUBLE) AS spread_pips, o_orderkey AS seq FROM orders)"""


def _bars(unit: str) -> str:
    return f"""bars AS (SELECT pair, date_trunc('{unit}', ts) AS ts, first(mid ORDER BY ts, seq) AS open, max(mid) AS high, min(mid) AS low,
  last(mid ORDER BY ts, seq) AS close, coalesce(sum(ask_vol), 0.0) AS volume, quantile_cont(spread_pips, 0.5) AS spread_median_pips,
  avg(spread_pips) AS spread_mean_pips, quantile_cont(spread_pips, 0.9) AS spread_p90_pips FROM ticks GROUP BY ALL)"""


HOURLY, DAILY = f"{TICKS}, {_bars('hour')}", f"{DAILY_TICKS}, {_bars('day')}"
BY = "(PARTITION BY pair ORDER BY ts)"


def frame(n: int) -> str:
    return f"(PARTITION BY pair ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {f}({x}) OVER {frame(n)} END"


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null, so that the order of summation does not show."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(F.round(F.when(~F.isnan(c), c), digits).alias(f.name) if f.dataType.simpleString() == "double" else c)
    return df.select(out)


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"


# ---- sources and resampling ----------------------------------------------------------------------------------------------------

BAR_COLUMNS = "pair, ts, " + ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume", "spread_median_pips", "spread_mean_pips", "spread_p90_pips"))


@register("rs2_ticks_to_hourly_bars", f"WITH {HOURLY} SELECT {BAR_COLUMNS} FROM bars")
def _(spark, sf):
    return rounded(tables.hourly_bars(spark, sf))


@register("src7_daily_bars", f"WITH {DAILY} SELECT {BAR_COLUMNS} FROM bars")
def _(spark, sf):
    return rounded(tables.daily_bars(spark, sf))


@register("src4_catalog", f"WITH {HOURLY}, h AS (SELECT pair, 'hour' AS timeframe, count(*) AS bars FROM bars GROUP BY ALL) SELECT * FROM h")
def _(spark, sf):
    return tables.hourly_bars(spark, sf).groupBy("pair").agg(F.count("*").alias("bars")).withColumn("timeframe", F.lit("hour"))


@register("rs1_resample_daily", f"""WITH {HOURLY} SELECT pair, date_trunc('day', ts) AS ts, {r('first(open ORDER BY ts)', 'open')}, {r('max(high)', 'high')},
  {r('min(low)', 'low')}, {r('last(close ORDER BY ts)', 'close')}, {r('sum(volume)', 'volume')} FROM bars GROUP BY pair, date_trunc('day', ts)""")
def _(spark, sf):
    return rounded(resample.resample(tables.hourly_bars(spark, sf), "day"))


@register("rs3_spread_by_clock", f"WITH {HOURLY} SELECT pair, ts, {r('spread_median_pips', 'spread_median_pips')}, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week FROM bars")
def _(spark, sf):
    return rounded(resample.spread_by_clock(tables.hourly_bars(spark, sf)))


@register("rs4_hour_curve", f"""WITH {TICKS}, seen AS (SELECT pair, CAST(hour(ts) AS INT) AS hour, quantile_cont(spread_pips, 0.5) AS q FROM ticks
  WHERE isodow(ts) < 6 GROUP BY ALL), grid AS (SELECT p.pair, CAST(s.slot AS INT) AS slot, CAST(s.slot % 24 AS INT) AS hour FROM (SELECT DISTINCT pair FROM seen) p, range(72) s(slot)),
  t AS (SELECT grid.*, q, CASE WHEN q IS NOT NULL THEN slot END AS k FROM grid LEFT JOIN seen USING (pair, hour)),
  u AS (SELECT *, last_value(k IGNORE NULLS) OVER w AS bk, last_value(q IGNORE NULLS) OVER w AS bq, first_value(k IGNORE NULLS) OVER v AS ak,
  first_value(q IGNORE NULLS) OVER v AS aq FROM t WINDOW w AS (PARTITION BY pair ORDER BY slot), v AS (PARTITION BY pair ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT pair, hour, round(coalesce(q, bq + (aq - bq) * (slot - bk) / nullif(ak - bk, 0)), 6) AS spread FROM u WHERE slot BETWEEN 24 AND 47""")
def _(spark, sf):
    return rounded(resample.hour_curve(tables.ticks(spark, sf)))


@register("rs6_monthly_returns", f"""WITH {DAILY}, m AS (SELECT pair, date_trunc('month', ts) AS month, last(close ORDER BY ts) AS close FROM bars GROUP BY ALL),
  c AS (SELECT pair, CAST(year(month) AS INT) AS year, month(month) AS k, round(close / lag(close) OVER (PARTITION BY pair ORDER BY month) - 1, 9) AS v FROM m)
  SELECT pair, year, {', '.join(f"round(max(CASE WHEN k = {i} THEN v END), 6) AS m{i}" for i in range(1, 13))} FROM c GROUP BY pair, year""")
def _(spark, sf):
    return rounded(resample.monthly_returns(tables.daily_bars(spark, sf)))


# ---- filters -------------------------------------------------------------------------------------------------------------------

CUTOFF = "1999-01-01"


@register("flt1_holdout_split", f"WITH {DAILY} SELECT pair, CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'in' ELSE 'out' END AS part, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY ALL")
def _(spark, sf):
    part = F.when(F.col("ts") < F.lit(CUTOFF).cast("timestamp"), "in").otherwise("out")
    return tables.daily_bars(spark, sf).groupBy("pair", part.alias("part")).agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("flt2_holdout_guard", f"WITH {DAILY} SELECT pair, bool_or(ts >= TIMESTAMP '{CUTOFF}') AS violated FROM bars GROUP BY pair")
def _(spark, sf):
    return tables.daily_bars(spark, sf).groupBy("pair").agg(F.bool_or(F.col("ts") >= F.lit(CUTOFF).cast("timestamp")).alias("violated"))


@register("flt8_post_freeze", f"WITH {DAILY} SELECT pair, count_if(ts <= TIMESTAMP '{CUTOFF}') AS violations, min(CASE WHEN ts <= TIMESTAMP '{CUTOFF}' THEN ts END) AS earliest FROM bars GROUP BY pair")
def _(spark, sf):
    late = F.col("ts") <= F.lit(CUTOFF).cast("timestamp")
    return tables.daily_bars(spark, sf).groupBy("pair").agg(F.count_if(late).alias("violations"), F.min(F.when(late, F.col("ts"))).alias("earliest"))


SESSION = "NOT (isodow(ts) = 6 OR (isodow(ts) = 5 AND hour(ts) >= 21) OR (isodow(ts) = 7 AND hour(ts) < 22))"


@register("flt4_in_session", f"WITH {HOURLY} SELECT pair, ts, {SESSION} AS in_session FROM bars")
def _(spark, sf):
    return tables.hourly_bars(spark, sf).select("pair", "ts", quality.in_session(F.col("ts")).alias("in_session"))


SMA_SIGNAL = f"coalesce(sign({full('avg', 'close', 5)} - {full('avg', 'close', 20)}), 0.0)"


@register("flt3_session_filter", f"WITH {HOURLY} SELECT pair, ts, CAST(CASE WHEN (hour(ts) >= 22 OR hour(ts) < 2) OR (hour(ts) >= 7 AND hour(ts) < 16) THEN {SMA_SIGNAL} ELSE 0 END AS DOUBLE) AS signal FROM bars")
def _(spark, sf):
    return signals.session_filter(signals.sma_cross(tables.hourly_bars(spark, sf)), [(22, 2), (7, 16)]).select("pair", "ts", "signal")


# ---- data quality --------------------------------------------------------------------------------------------------------------

@register("dq1_validation_report", f"""WITH {DAILY}, z AS (SELECT *, CASE WHEN count(close) OVER {frame(50)} = 50 AND stddev_samp(close) OVER {frame(50)} > 0
  THEN (close - avg(close) OVER {frame(50)}) / stddev_samp(close) OVER {frame(50)} END AS z, (epoch(ts) - epoch(lag(ts) OVER {BY})) / 86400 AS gap, lag(ts) OVER {BY} = ts AS twin FROM bars)
  SELECT pair, count(*) AS rows, count_if(twin) AS duplicates, count_if(high < low OR high < greatest(open, close) OR low > least(open, close)) AS high_low,
  count_if(least(open, high, low, close) <= 0) AS not_positive, count_if(abs(z) > 3) AS outliers, count_if(gap > 4) AS gaps, min(ts) AS first_ts, max(ts) AS last_ts FROM z GROUP BY pair""")
def _(spark, sf):
    return quality.validation_report(tables.daily_bars(spark, sf), z_limit=3.0)


@register("dq2_price_range", f"""WITH {DAILY} SELECT pair, {r('min(close)', 'low')}, {r('max(close)', 'high')}, count_if(NOT isfinite(close) OR (pair LIKE '1%' AND (close < 10000 OR close > 300000))) AS outside FROM bars GROUP BY pair""")
def _(spark, sf):
    bars = tables.daily_bars(spark, sf)
    bounds = bars.select("pair").where("pair like '1%'").distinct().select("pair", F.lit(10000.0).alias("least"), F.lit(300000.0).alias("most"))
    return rounded(quality.price_range(bars, bounds))


@register("dq3_spread_and_spikes", f"""WITH {HOURLY}, c AS (SELECT *, abs(close / lag(close) OVER {BY} - 1) AS change, lag(ts) OVER {BY} = ts AS twin FROM bars) SELECT pair,
  count_if(spread_median_pips IS NULL OR spread_median_pips <= 0 OR spread_median_pips > 6) AS bad_spread, count_if(volume <= 0) AS bad_volume, count_if(change > 0.1) AS spikes, count_if(twin) AS duplicates, count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing FROM c GROUP BY pair""")
def _(spark, sf):
    return quality.spread_and_spike_checks(tables.hourly_bars(spark, sf), widest=6.0)


def _run_sql(flag: str, out: str, extra: int, source: str = HOURLY) -> str:
    return f"""WITH {source}, f AS (SELECT *, coalesce({flag}, false) AS f FROM bars), i AS (SELECT *, count_if(NOT f) OVER {BY} AS island FROM f),
  n AS (SELECT pair, island, count_if(f) AS n FROM i GROUP BY ALL) SELECT pair, CAST(CASE WHEN max(n) > 0 THEN max(n) + {extra} ELSE 0 END AS BIGINT) AS {out} FROM n GROUP BY pair"""


@register("dq4_stale_run", _run_sql(" AND ".join(f"round({c} / 100) = round(lag({c}) OVER {BY} / 100)" for c in ("open", "high", "low", "close")), "stale_run", 1))
def _(spark, sf):
    bars = tables.hourly_bars(spark, sf)
    return quality.stale_run(bars.withColumns({c: F.round(F.col(c) / 100) for c in ("open", "high", "low", "close")}))


@register("dq5_longest_rise", _run_sql(f"close > lag(close) OVER {BY}", "rise", 0))
def _(spark, sf):
    bars = tables.hourly_bars(spark, sf).withColumn("up", F.col("close") > F.lag("close").over(ind.by_ts()))
    return quality.longest_run(bars, F.col("up"), "rise")


@register("dq6_weekend_check", f"WITH {HOURLY} SELECT pair, count_if(isodow(ts) = 6) AS saturday, count_if(isodow(ts) = 5) AS friday, count_if(isodow(ts) = 5 AND hour(ts) >= 21) AS late_friday FROM bars GROUP BY pair")
def _(spark, sf):
    return quality.weekend_check(tables.hourly_bars(spark, sf))


SLOTS = f"slots AS (SELECT pair, ts FROM (SELECT pair, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY pair) WHERE {SESSION})"


@register("dq7_expected_slots", f"WITH {HOURLY}, {SLOTS} SELECT pair, count(*) AS slots FROM slots GROUP BY pair")
def _(spark, sf):
    return quality.slots(tables.hourly_bars(spark, sf)).groupBy("pair").agg(F.count("*").alias("slots"))


@register("dq8_missing_hours", f"""WITH {HOURLY}, {SLOTS}, g AS (SELECT s.pair, s.ts, b.ts IS NULL AS gone FROM slots s LEFT JOIN (SELECT pair, ts FROM bars) b ON s.pair = b.pair AND s.ts = b.ts),
  e AS (SELECT *, NOT gone OR coalesce(epoch(ts) - epoch(lag(ts) OVER {BY}) > 3600, false) AS edge FROM g), i AS (SELECT *, count_if(edge) OVER {BY} AS island FROM e),
  n AS (SELECT pair, island, count(*) AS n, count_if(gone) AS g FROM i GROUP BY ALL)
  SELECT pair, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(n) - sum(g) AS BIGINT) AS present, max(g) AS longest_gap FROM n GROUP BY pair""")
def _(spark, sf):
    return quality.missing_hours(tables.hourly_bars(spark, sf))


@register("dq13_month_manifest", f"""WITH {DAILY}, c AS (SELECT pair, date_trunc('month', ts) AS month, count(*) AS n FROM bars GROUP BY ALL), e AS (SELECT pair, min(month) AS a, max(month) AS b FROM c GROUP BY pair),
  m AS (SELECT e.pair, list_sort(list(n) FILTER (month < b)) AS l FROM c JOIN e USING (pair) GROUP BY e.pair), s AS (SELECT e.pair, b, coalesce(l[len(l) // 2 + 1], 0) AS median, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM e JOIN m USING (pair))
  SELECT s.pair, CAST(s.month AS TIMESTAMP) AS month, coalesce(n, 0) AS bars, CASE WHEN s.month = b THEN 'PARTIAL' WHEN coalesce(n, 0) = 0 THEN 'ZERO' WHEN n < 8 THEN 'LOW' WHEN n < median // 2 THEN 'THIN' ELSE 'OK' END AS status FROM s LEFT JOIN c ON s.pair = c.pair AND s.month = c.month""")
def _(spark, sf):
    return quality.month_manifest(tables.daily_bars(spark, sf), 8)


@register("dq14_fill_gaps", f"""WITH {HOURLY}, x AS (SELECT pair, ts, CASE WHEN hour(ts) % 6 < 2 OR hour(ts) > 17 THEN NULL ELSE close END AS x FROM bars),
  i AS (SELECT *, count(x) OVER {BY} AS island FROM x) SELECT pair, ts, round(CASE WHEN count_if(x IS NULL) OVER (PARTITION BY pair, island) <= 3 THEN last_value(x IGNORE NULLS) OVER {BY} ELSE x END, 6) AS filled FROM i""")
def _(spark, sf):
    x = F.when(~((F.hour("ts") % 6 < 2) | (F.hour("ts") > 17)), F.col("close"))
    rows = tables.hourly_bars(spark, sf).select("pair", "ts", x.alias("x"))
    return rounded(quality.fill_gaps(rows, "x").select("pair", "ts", "filled"))


# ---- indicators ----------------------------------------------------------------------------------------------------------------

def _indicator(name: str, select: str, plan: Callable[[DataFrame], DataFrame], columns: list[str], ctes: str = "", source: str = HOURLY, table: str = "bars") -> None:
    load = tables.hourly_bars if source == HOURLY else tables.daily_bars

    @register(name, f"WITH {source}{ctes} SELECT pair, ts, {select} FROM {table}")
    def _(spark, sf):
        return rounded(plan(load(spark, sf)).select("pair", "ts", *columns))


_indicator("ind1_sma", r(full("avg", "close", 20), "sma"), lambda b: b.withColumn("sma", ind.sma("close", 20)), ["sma"])
_indicator("ind4_bollinger", f"{r(full('avg', 'close', 20), 'bb_mid')}, {r(full('avg', 'close', 20) + ' + 2 * ' + full('stddev_samp', 'close', 20), 'bb_upper')}", ind.bollinger, ["bb_mid", "bb_upper"])
TR = f"greatest(high - low, abs(high - lag(close) OVER {BY}), abs(low - lag(close) OVER {BY}))"
_indicator("ind6_atr_simple", f"{r('tr', 'tr')}, {r(full('avg', 'tr', 14), 'atr')}", ind.atr_simple, ["tr", "atr"], f", t AS (SELECT *, {TR} AS tr FROM bars)", table="t")
_indicator("ind7_momentum", r(f"close / lag(close, 20) OVER {BY} - 1", "momentum"), lambda b: b.withColumn("momentum", ind.momentum("close", 20)), ["momentum"])
RET = f", t AS (SELECT *, close / lag(close) OVER {BY} - 1 AS r FROM bars)"
_indicator("ind10_realised_volatility", r(full("stddev_samp", "r", 20) + " * sqrt(252)", "vol"), ind.realised_volatility, ["vol"], RET, table="t")
_indicator("ind13_hours_to_next", f"round((epoch(lead(ts) OVER {BY}) - epoch(ts)) / 3600, 6) AS hours_to_next, coalesce((epoch(lead(ts) OVER {BY}) - epoch(ts)) / 3600 > 1, true) AS pre_gap", ind.hours_to_next, ["hours_to_next", "pre_gap"])
SEASON = ", n AS (SELECT pair AS p, (isodow(ts) - 1) * 24 + hour(ts) AS k, greatest(quantile_cont({x}, 0.5), {f}) AS norm FROM bars GROUP BY ALL), t AS (SELECT bars.*, norm FROM bars JOIN n ON pair = p AND (isodow(ts) - 1) * 24 + hour(ts) = k)"
_indicator("ind15_relative_volume", r("volume / norm", "relvol"), lambda b: ind.relative_to_season(b, "volume", "relvol"), ["relvol"], SEASON.format(x="volume", f="1.0"), table="t")
_indicator("ind16_relative_range", r("(high - low) / norm", "relrng"), lambda b: ind.relative_to_season(b.withColumn("rng", F.col("high") - F.col("low")), "rng", "relrng", 1e-9), ["relrng"], SEASON.format(x="high - low", f="1e-9"), table="t")
_indicator("ind17_session_open", r("first_value(open) OVER (PARTITION BY pair, CAST(ts AS DATE) ORDER BY ts)", "session_open"), ind.session_open, ["session_open"])
_indicator("ind19_rolling_sharpe", r(f"CASE WHEN {full('stddev_samp', 'r', 60)} > 0 THEN {full('avg', 'r', 60)} / {full('stddev_samp', 'r', 60)} * sqrt(252) END", "sharpe"), ind.rolling_sharpe, ["sharpe"], RET, DAILY, "t")


@register("ind11_bars_per_year", f"""WITH {HOURLY}, g AS (SELECT pair, (epoch(ts) - epoch(lag(ts) OVER {BY})) / 3600 AS h FROM bars), m AS (SELECT pair, quantile_cont(h, 0.5) AS bar_hours FROM g GROUP BY pair)
  SELECT pair, bar_hours, CASE WHEN bar_hours <= 1.5 THEN 6240.0 WHEN bar_hours <= 6 THEN 1560.0 ELSE 252.0 END::DOUBLE AS periods_per_year FROM m""")
def _(spark, sf):
    return ind.bars_per_year(tables.hourly_bars(spark, sf))


def _ema_sql(x: str, alpha: float, least: int, source: str, ctes: str = "", rows: str = "bars") -> str:
    """Recursive mean by row number; leading nulls are dropped, then the first value seeds."""
    return f"""WITH RECURSIVE {source}{ctes}, n AS (SELECT pair, ts, {x} AS x, row_number() OVER {BY} AS i FROM {rows} WHERE {x} IS NOT NULL),
  e AS (SELECT pair, ts, i, x AS v FROM n WHERE i = 1 UNION ALL SELECT n.pair, n.ts, n.i, {alpha!r} * n.x + {1 - alpha!r} * e.v FROM e JOIN n ON n.pair = e.pair AND n.i = e.i + 1)
  SELECT pair, ts, CASE WHEN i >= {least} THEN v END AS v FROM e"""


@register("ind2_ema", f"SELECT b.pair, b.ts, round(v, 6) AS ema FROM ({_ema_sql('close', 2 / 21, 20, HOURLY)}) b")
def _(spark, sf):
    return rounded(ind.ema(tables.hourly_bars(spark, sf), 20).select("pair", "ts", "ema"))


@register("ind5_atr_wilder", f"SELECT b.pair, b.ts, round(v, 6) AS atr FROM ({_ema_sql('tr', 1 / 14, 14, HOURLY, f', t AS (SELECT *, {TR} AS tr FROM bars)', 't')}) b")
def _(spark, sf):
    return rounded(ind.atr(tables.hourly_bars(spark, sf)).select("pair", "ts", "atr"))


CHANGE = f", t AS (SELECT *, coalesce(greatest(close - lag(close) OVER {BY}, 0), 0) AS gain, coalesce(greatest(lag(close) OVER {BY} - close, 0), 0) AS loss FROM bars)"


def _rsi_sql(source: str) -> str:
    return f"""SELECT pair, ts, round(CASE WHEN g.v = 0 AND l.v = 0 THEN 50 WHEN l.v = 0 THEN 100 ELSE 100 - 100 / (1 + g.v / l.v) END, 6) AS rsi
  FROM ({_ema_sql('gain', 1 / 14, 14, source, CHANGE, 't')}) g JOIN ({_ema_sql('loss', 1 / 14, 14, source, CHANGE, 't')}) l USING (pair, ts)"""


@register("ind3_rsi", _rsi_sql(HOURLY))
def _(spark, sf):
    return rounded(ind.rsi(tables.hourly_bars(spark, sf)).select("pair", "ts", "rsi"))


_FAST, _SLOW = _ema_sql("close", 2 / 13, 12, HOURLY), _ema_sql("close", 2 / 27, 26, HOURLY)


@register("ind8_macd", f"SELECT f.pair, f.ts, round(f.v - s.v, 6) AS macd FROM ({_FAST}) f JOIN ({_SLOW}) s USING (pair, ts)")
def _(spark, sf):
    return rounded(ind.macd(tables.hourly_bars(spark, sf)).select("pair", "ts", "macd"))


MACD_LINE = f", ml AS (SELECT f.pair, f.ts, f.v - s.v AS macd FROM ({_FAST}) f JOIN ({_SLOW}) s USING (pair, ts))"
#: The line with its signal, whose recursion starts at the first non-null line.
MACD = f"SELECT l.pair, l.ts, l.macd, g.v AS macd_signal, l.macd - g.v AS macd_hist FROM (SELECT f.pair, f.ts, f.v - s.v AS macd FROM ({_FAST}) f JOIN ({_SLOW}) s USING (pair, ts)) l LEFT JOIN ({_ema_sql('macd', 2 / 10, 9, HOURLY, MACD_LINE, 'ml')}) g USING (pair, ts)"


@register("ind8_macd_signal", f"SELECT pair, ts, {r('macd', 'macd')}, {r('macd_signal', 'macd_signal')}, {r('macd_hist', 'macd_hist')} FROM ({MACD})")
def _(spark, sf):
    return rounded(ind.macd(tables.hourly_bars(spark, sf)).select("pair", "ts", "macd", "macd_signal", "macd_hist"))


# ---- joins ---------------------------------------------------------------------------------------------------------------------

RATES = "rates AS (SELECT l_returnflag AS currency, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, avg(l_discount) * 100 AS rate FROM lineitem GROUP BY ALL)"


#: The currency whose rate each series follows.
LEGS = {"1-URGENT": "R", "2-HIGH": "A", "3-MEDIUM": "N", "4-NOT SPECIFIED": "R", "5-LOW": "A"}
OWN_RATES = f"(SELECT pair, ts, rate FROM rates JOIN (VALUES {', '.join(map(str, LEGS.items()))}) g(pair, currency) USING (currency))"


def _rate_rows(spark, sf):
    """The rates of each series' currency; a currency of several series gives one row for each."""
    of = {c: [p for p, own in LEGS.items() if own == c] for c in LEGS.values()}
    pairs = F.create_map(*(x for c, ps in of.items() for x in (F.lit(c), F.array(*map(F.lit, ps)))))
    return tables.rates(spark, sf).select(F.explode(F.try_element_at(pairs, F.col("currency"))).alias("pair"), F.col("date").alias("ts"), F.col("rate_pct").alias("rate"))


@register("jn1_asof_rate", f"WITH {DAILY}, {RATES} SELECT b.pair, b.ts, round(r.rate, 6) AS rate FROM bars b ASOF LEFT JOIN {OWN_RATES} r ON b.pair = r.pair AND b.ts >= r.ts")
def _(spark, sf):
    return rounded(joins.asof(tables.daily_bars(spark, sf).select("pair", "ts"), _rate_rows(spark, sf), "rate"))


@register("jn3_forward_asof", f"WITH {DAILY}, {RATES} SELECT b.pair, b.ts, round(r.rate, 6) AS rate FROM bars b ASOF LEFT JOIN {OWN_RATES} r ON b.pair = r.pair AND b.ts <= r.ts")
def _(spark, sf):
    return rounded(joins.asof(tables.daily_bars(spark, sf).select("pair", "ts"), _rate_rows(spark, sf), "rate", forward=True))


SIMPLE = f", rets AS (SELECT pair, ts, close / lag(close) OVER {BY} - 1 AS ret FROM bars), x AS (SELECT * FROM rets WHERE ret IS NOT NULL)"


def _returns(bars: DataFrame) -> DataFrame:
    return bars.select("pair", "ts", ind.momentum("close", 1).alias("ret")).where("ret is not null")


@register("jn4_common_times", f"WITH {TICKS}, {_bars('day')}{SIMPLE} SELECT pair, ts, round(ret, 6) AS ret FROM x WHERE ts IN (SELECT ts FROM x GROUP BY ts HAVING count(*) = 5)")
def _(spark, sf):
    return rounded(joins.common_times(_returns(resample.ticks_to_bars(tables.ticks(spark, sf), "day")), 5))


@register("jn5_outer_zero", f"WITH {HOURLY}{SIMPLE} SELECT p.pair, t.ts, round(coalesce(ret, 0), 6) AS ret FROM (SELECT DISTINCT pair FROM x) p CROSS JOIN (SELECT DISTINCT ts FROM x) t LEFT JOIN x ON x.pair = p.pair AND x.ts = t.ts")
def _(spark, sf):
    return rounded(joins.outer_zero(_returns(tables.hourly_bars(spark, sf))))


# ---- signals -------------------------------------------------------------------------------------------------------------------

_indicator("sig1_sma_cross", f"CAST({SMA_SIGNAL} AS DOUBLE) AS signal", signals.sma_cross, ["signal"], source=DAILY)
MOM = f"close / lag(close, 20) OVER {BY} - 1"
_indicator("sig2_momentum", f"CAST(CASE WHEN {MOM} > 0 THEN 1 WHEN {MOM} < 0 THEN -1 ELSE 0 END AS DOUBLE) AS signal", signals.momentum_signal, ["signal"], source=DAILY)
BANDS = f"(SELECT pair, ts, close, {full('avg', 'close', 20)} AS mid, {full('stddev_samp', 'close', 20)} AS sd FROM bars)"


@register("sig3_band_reversal", f"""WITH {DAILY}, b AS {BANDS}, h AS (SELECT b.pair, b.ts, CASE WHEN close < mid - 2 * sd AND rsi < 30 THEN 1 WHEN close > mid + 2 * sd AND rsi > 70 THEN -1 END AS hit FROM b LEFT JOIN ({_rsi_sql(DAILY)}) USING (pair, ts))
  SELECT pair, ts, CAST(coalesce(last_value(hit IGNORE NULLS) OVER {BY}, 0) AS DOUBLE) AS signal FROM h""")
def _(spark, sf):
    return signals.band_reversal(tables.daily_bars(spark, sf)).select("pair", "ts", "signal")


@register("sig6_carry", f"WITH {DAILY}, {RATES} SELECT b.pair, b.ts, round(CASE WHEN abs(r.rate - 5) >= 0.01 THEN greatest(-1, least(1, (r.rate - 5) / 0.1)) ELSE 0 END, 6) AS signal FROM bars b ASOF LEFT JOIN {OWN_RATES} r ON b.pair = r.pair AND b.ts >= r.ts")
def _(spark, sf):
    rows = joins.asof(tables.daily_bars(spark, sf).select("pair", "ts"), _rate_rows(spark, sf), "rate").withColumn("diff", F.col("rate") - 5)
    return rounded(signals.carry(rows, "diff", 0.1, 0.01).select("pair", "ts", "signal"))


@register("sig7_cross_sectional", f"WITH {HOURLY}{SIMPLE} SELECT pair, ts, round(CASE WHEN stddev_samp(ret) OVER t > 0 THEN greatest(-1, least(1, (ret - avg(ret) OVER t) / stddev_samp(ret) OVER t)) ELSE 0 END, 6)::DOUBLE AS signal FROM x WINDOW t AS (PARTITION BY ts)")
def _(spark, sf):
    return rounded(signals.cross_sectional(_returns(tables.hourly_bars(spark, sf)), "ret").select("pair", "ts", "signal"))


LR = f", t AS (SELECT *, ln(close / lag(close) OVER {BY}) AS lr FROM bars)"


@register("sig13_lookbacks", f"WITH {HOURLY}{LR} " + " UNION ALL ".join(f"SELECT pair, ts, {n} AS lookback, CAST(coalesce(sign(round({full('avg', 'lr', n)}, 12)), 0) AS DOUBLE) AS signal FROM t" for n in (12, 24, 48, 96)))
def _(spark, sf):
    return signals.lookback_signs(tables.hourly_bars(spark, sf))


def _u(tag: str) -> str:
    return f"CAST(('0x' || substr(md5('1|3|{tag}|' || pair || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@register("sig16_random_signals", f"WITH {HOURLY}, t AS (SELECT pair, ts, CASE WHEN {_u('c')} < 0.2 THEN floor({_u('v')} * 3) - 1 END AS fresh FROM bars) SELECT pair, ts, CAST(coalesce(last_value(fresh IGNORE NULLS) OVER {BY}, 0) AS DOUBLE) AS signal FROM t")
def _(spark, sf):
    return signals.random_signals(tables.hourly_bars(spark, sf), draw=3).select("pair", "ts", "signal")


# ---- costs, sizes, simulation --------------------------------------------------------------------------------------------------

POS = f"""s AS (SELECT *, {SMA_SIGNAL} AS signal FROM bars), p AS (SELECT *, coalesce(lag(signal) OVER {BY}, 0) AS position FROM s),
  q AS (SELECT *, abs(position - coalesce(lag(position) OVER {BY}, 0)) * (CASE WHEN spread_median_pips > 0 THEN spread_median_pips ELSE 0 END + 0.8) AS cost_pips FROM p),
  net AS (SELECT *, coalesce(position * ln(close / lag(close) OVER {BY}), 0) - cost_pips * 0.0001 / close AS ret FROM q)"""


def _net(spark, sf):
    return simulate.net_returns(signals.sma_cross(tables.daily_bars(spark, sf)))


@register("cst8_turnover_cost", f"WITH {DAILY}, {POS} SELECT pair, ts, CAST(position AS DOUBLE) AS position, {r('cost_pips', 'cost_pips')} FROM q")
def _(spark, sf):
    return rounded(simulate.turnover_cost(signals.sma_cross(tables.daily_bars(spark, sf)), "spread_median_pips", 0.8).select("pair", "ts", "position", "cost_pips"))


@register("bt7_net_returns", f"WITH {DAILY}, {POS} SELECT pair, ts, {r('ret', 'ret', 9)} FROM net")
def _(spark, sf):
    return rounded(_net(spark, sf).select("pair", "ts", "ret"), 9)


@register("cst3_rollovers", """SELECT l_orderkey, l_linenumber, (SELECT coalesce(sum(CASE WHEN isodow(d) = 3 THEN 3 ELSE 1 END), 0)::BIGINT FROM generate_series(date_trunc('day', l_shipdate), date_trunc('day', l_shipdate + INTERVAL (l_quantity) HOUR), INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 5 AND d + INTERVAL 22 HOUR > l_shipdate AND d + INTERVAL 22 HOUR <= l_shipdate + INTERVAL (l_quantity) HOUR) AS days FROM lineitem""")
def _(spark, sf):
    rows = tables.read(spark, sf, "lineitem").withColumn("a", F.col("l_shipdate").cast("timestamp"))
    rows = rows.withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.col("l_quantity").cast("int") * 3600))
    return rows.select("l_orderkey", "l_linenumber", simulate.rollovers(F.col("a"), F.col("b")).alias("days"))


@register("cst4_rollover_bars", f"WITH {HOURLY} SELECT pair, ts, CAST(CASE WHEN hour(ts) = 21 AND isodow(ts) < 5 THEN CASE WHEN isodow(ts) = 3 THEN 3 ELSE 1 END ELSE 0 END AS INT) AS days FROM bars")
def _(spark, sf):
    day = F.weekday("ts")
    days = F.when((F.hour("ts") == 21) & (day < 4), F.when(day == 2, 3).otherwise(1)).otherwise(0)
    return tables.hourly_bars(spark, sf).select("pair", "ts", days.alias("days"))


@register("sz1_fixed_fraction", f"WITH {HOURLY}, t AS (SELECT *, {TR} AS tr FROM bars), a AS (SELECT *, {full('avg', 'tr', 14)} AS atr FROM t) SELECT pair, ts, round(CASE WHEN atr > 0 THEN least(10000 * 0.01 * 1 / (atr * 2), 10000 * 0.1 / close) ELSE 0 END, 6) AS size FROM a WHERE close > 0")
def _(spark, sf):
    rows = ind.atr_simple(tables.hourly_bars(spark, sf)).where("close > 0")
    return rounded(rows.select("pair", "ts", simulate.fixed_fraction(F.lit(10000.0), F.col("atr"), F.col("close"), F.lit(1.0)).alias("size")))


TRADES = f"""side AS (SELECT *, sign(position) AS side FROM p), turn AS (SELECT *, coalesce(side <> lag(side) OVER {BY}, true)::INT AS turn FROM side),
  run AS (SELECT *, sum(turn) OVER {BY} AS run, row_number() OVER {BY} AS n FROM turn),
  runs AS (SELECT pair, run, side, min(ts) AS entry_time, first(close ORDER BY ts) AS entry_price, max(ts) AS last_time, last(close ORDER BY ts) AS last_price, last(spread_median_pips ORDER BY ts) AS last_spread, first(spread_median_pips ORDER BY ts) AS first_spread, min(n) AS from_n, count(*) AS bars FROM run GROUP BY pair, run, side),
  nx AS (SELECT *, coalesce(lead(entry_time) OVER w, last_time) AS exit_time, coalesce(lead(entry_price) OVER w, last_price) AS exit_price, coalesce(lead(first_spread) OVER w, last_spread) AS exit_spread FROM runs WINDOW w AS (PARTITION BY pair ORDER BY run)),
  trades AS (SELECT pair, CAST(side AS INT) AS direction, entry_time, exit_time, entry_price, exit_price, bars, side * (exit_price - entry_price) / 0.0001 - exit_spread / 2 AS pnl_pips FROM nx WHERE side <> 0 AND from_n > 1)"""


def _trades(spark, sf):
    return simulate.trades(signals.sma_cross(tables.daily_bars(spark, sf)))


@register("bt1_trades", f"WITH {DAILY}, {POS}, {TRADES} SELECT pair, direction, entry_time, exit_time, {r('entry_price', 'entry_price')}, {r('exit_price', 'exit_price')}, bars, {r('pnl_pips', 'pnl_pips', 2)} FROM trades")
def _(spark, sf):
    return rounded(_trades(spark, sf)).withColumn("pnl_pips", F.round("pnl_pips", 2))


@register("bt6_buy_and_hold", f"WITH {DAILY} SELECT pair, ts, round(10000 / first_value(close) OVER {BY} * close, 6) AS equity FROM bars")
def _(spark, sf):
    return rounded(simulate.buy_and_hold(tables.daily_bars(spark, sf)).select("pair", "ts", "equity"))


# ---- metrics -------------------------------------------------------------------------------------------------------------------

@register("met1_summary", f"""WITH {DAILY}, {POS} SELECT pair, count(ret) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) AS sharpe,
  round(CASE WHEN stddev_samp(CASE WHEN ret < 0 THEN ret END) > 0 THEN avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) AS sortino FROM (SELECT pair, ts, ret / 100 AS ret FROM net) GROUP BY pair""")
def _(spark, sf):
    return rounded(metrics.summary(_net(spark, sf).withColumn("ret", F.col("ret") / 100)))


EQUITY = f", eq AS (SELECT pair, ts, 10000 / first_value(close) OVER {BY} * close AS equity FROM bars), d AS (SELECT *, max(equity) OVER {BY} AS peak FROM eq)"


@register("met2_max_drawdown", f"WITH {DAILY}{EQUITY} SELECT pair, round(max(greatest(0, least(1, 1 - equity / peak))), 6) AS max_drawdown FROM d GROUP BY pair")
def _(spark, sf):
    return rounded(metrics.max_drawdown(simulate.buy_and_hold(tables.daily_bars(spark, sf))))


@register("met3_longest_drawdown", f"""WITH {DAILY}{EQUITY}, i AS (SELECT *, equity >= peak AS at_peak, count_if(equity >= peak) OVER {BY} AS island FROM d),
  n AS (SELECT pair, island, min(ts) AS peak_ts, min(CASE WHEN NOT at_peak THEN ts END) AS a, max(ts) AS z FROM i GROUP BY ALL), b AS (SELECT *, coalesce(lead(peak_ts) OVER (PARTITION BY pair ORDER BY island), z) AS back FROM n)
  SELECT pair, CAST(coalesce(max(floor((epoch(back) - epoch(a)) / 86400)), 0) AS BIGINT) AS days FROM b GROUP BY pair""")
def _(spark, sf):
    return metrics.longest_drawdown(simulate.buy_and_hold(tables.daily_bars(spark, sf)))


@register("met4_trade_stats", f"""WITH {DAILY}, {POS}, {TRADES} SELECT pair, count(*) AS trades, round(avg((pnl_pips > 0)::INT), 6) AS win_rate, round(CASE WHEN sum(CASE WHEN pnl_pips <= 0 THEN -pnl_pips ELSE 0 END) > 0 THEN sum(CASE WHEN pnl_pips > 0 THEN pnl_pips ELSE 0 END) / sum(CASE WHEN pnl_pips <= 0 THEN -pnl_pips ELSE 0 END) ELSE 99.9 END, 6) AS profit_factor,
  round(avg(pnl_pips), 2) AS avg_pips, round(avg(date_diff('day', entry_time, exit_time)), 6) AS avg_days FROM trades GROUP BY pair""")
def _(spark, sf):
    return rounded(metrics.trade_stats(_trades(spark, sf))).withColumn("avg_pips", F.round("avg_pips", 2))


@register("met9_regime_blocks", f"WITH {DAILY}, {POS} SELECT pair, CAST(year(ts) AS INT) AS year, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) AS sharpe FROM net GROUP BY ALL")
def _(spark, sf):
    return rounded(metrics.regime_blocks(_net(spark, sf)))


@register("met10_portfolio", f"WITH {HOURLY}{SIMPLE}, m AS (SELECT ts, avg(ret / 1000) AS ret FROM x GROUP BY ts) SELECT ts, {r('ret', 'ret')}, round(exp(sum(ln(1 + ret)) OVER (ORDER BY ts)), 6) AS equity FROM m WHERE ret > -1")
def _(spark, sf):
    rows = _returns(tables.hourly_bars(spark, sf)).withColumn("ret", F.col("ret") / 1000)
    return rounded(metrics.portfolio(rows))


@register("met14_concentration", f"""WITH {DAILY}, {POS}, {TRADES}, g AS (SELECT abs(sum(pnl_pips)) AS p, 'pair' AS kind FROM trades GROUP BY pair UNION ALL SELECT abs(sum(pnl_pips)), 'quarter' FROM trades GROUP BY date_trunc('quarter', exit_time)) SELECT kind AS by, round(max(p) / sum(p), 6) AS share FROM g GROUP BY kind""")
def _(spark, sf):
    return rounded(metrics.concentration(_trades(spark, sf)))


@register("met18_spearman", f"""WITH {HOURLY}, k AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY volume) + (count(*) OVER (PARTITION BY pair, volume) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY pair ORDER BY rng) + (count(*) OVER (PARTITION BY pair, rng) - 1) / 2 AS ry FROM (SELECT pair, volume, high - low AS rng FROM bars)) SELECT pair, round(corr(rx, ry), 6) AS rho FROM k GROUP BY pair""")
def _(spark, sf):
    return rounded(metrics.spearman(tables.hourly_bars(spark, sf).withColumn("rng", F.col("high") - F.col("low")), "volume", "rng"))


@register("st1_newey_west", f"""WITH {DAILY}, {POS}, c AS (SELECT pair, ts, ret - avg(ret) OVER (PARTITION BY pair) AS e, count(*) OVER (PARTITION BY pair) AS n, avg(ret) OVER (PARTITION BY pair) AS mean FROM net),
  l AS (SELECT *, {', '.join(f'lag(e, {k}) OVER {BY} AS e{k}' for k in range(1, 6))} FROM c)
  SELECT pair, n, round(mean, 9) AS mean, round(sqrt(greatest((sum(e * e) + {' + '.join(f'sum(e * e{k}) * {2 * (1 - k / 6)!r}' for k in range(1, 6))}) / n, 1e-12) / n), 9) AS se FROM l GROUP BY pair, n, mean""")
def _(spark, sf):
    return rounded(metrics.newey_west(_net(spark, sf), "ret", 5), 9)


@register("st5_window_placement", f"""WITH {DAILY}, {POS}, w AS (SELECT pair, ts, round(CASE WHEN count(ret) OVER {frame(250)} = 250 THEN avg(ret) OVER {frame(250)} / nullif(stddev_samp(ret) OVER {frame(250)}, 0) END, 12) AS s FROM net),
  k AS (SELECT *, last_value(s) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_sharpe FROM w WHERE s IS NOT NULL)
  SELECT pair, round(last_sharpe, 6) AS last_sharpe, count(*) AS windows, round(avg((s <= last_sharpe)::INT), 6) AS percentile, round(quantile_cont(s, 0.5) * sqrt(252), 6) AS median_sharpe FROM k GROUP BY pair, last_sharpe""")
def _(spark, sf):
    return rounded(metrics.window_placement(_net(spark, sf), 250))


# ---- ledger --------------------------------------------------------------------------------------------------------------------

LEDGER = "ledger AS (SELECT o_custkey AS trial_id, o_orderkey AS seq, o_orderdate AS ts, o_orderstatus AS status, o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN '_v2' WHEN 1 THEN '_v2_fast' ELSE '' END AS strategy, CASE WHEN o_orderkey % 7 = 0 THEN 'pre/' || o_orderpriority ELSE '' END AS pre_reg_path, CAST(month(o_orderdate) AS VARCHAR) AS config_hash, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice / 10000) END AS sharpe, o_orderkey % 11 <> 0 AS counts FROM orders)"


def _ledger(spark, sf):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, "_v2").when(F.col("o_orderkey") % 3 == 1, "_v2_fast").otherwise("")
    return tables.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("trial_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("status"), F.concat("o_orderpriority", suffix).alias("strategy"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("pre/"), "o_orderpriority")).otherwise("").alias("pre_reg_path"), F.month("o_orderdate").cast("string").alias("config_hash"),
        F.when(F.col("o_orderkey") % 5 > 0, F.floor(F.col("o_totalprice") / 10000).cast("double")).alias("sharpe"), (F.col("o_orderkey") % 11 != 0).alias("counts"),
    )


LAST = "last AS (SELECT trial_id, arg_max(status, seq) AS status, arg_max(strategy, seq) AS strategy, arg_max(pre_reg_path, seq) AS pre_reg_path, max(seq) AS seq FROM ledger GROUP BY trial_id)"


@register("led1_last_wins", f"WITH {LEDGER}, {LAST} SELECT trial_id, status, strategy, seq FROM last")
def _(spark, sf):
    return ledger.last_wins(_ledger(spark, sf))


@register("led2_distinct_hypotheses", f"WITH {LEDGER}, {LAST} SELECT status, count(*) AS trials, count(DISTINCT coalesce(nullif(pre_reg_path, ''), regexp_replace(strategy, '(?:_v2|_fast)+$', ''))) AS hypotheses, status IN ('F', 'O') AS counted FROM last GROUP BY status")
def _(spark, sf):
    return ledger.distinct_hypotheses(_ledger(spark, sf), ["F", "O"], ["_v2", "_fast"])


@register("led4_orphans", f"WITH {LEDGER} SELECT trial_id, min(ts) AS spawned FROM ledger GROUP BY trial_id HAVING count_if(status = 'P') = 0 AND min(ts) < TIMESTAMP '{CUTOFF}'")
def _(spark, sf):
    return ledger.orphans(_ledger(spark, sf), ["P"], F.lit(CUTOFF).cast("timestamp"))


@register("led8_exposure", """WITH p AS (SELECT l_shipmode AS g, l_suppkey AS strategy_id, l_extendedprice AS notional FROM (SELECT l_returnflag AS l_shipmode, l_suppkey, l_extendedprice FROM lineitem)),
  s AS (SELECT g, count(*) AS positions, count(DISTINCT strategy_id) AS strategies, sum(notional) AS notional FROM p GROUP BY ROLLUP (g)) SELECT g, positions, strategies, round(notional, 2) AS notional, round(notional / (SELECT sum(notional) FROM p), 6) AS share FROM s""")
def _(spark, sf):
    p = tables.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("strategy_id"), F.col("l_extendedprice").alias("notional"))
    return rounded(ledger.exposure(p, "g")).withColumn("notional", F.round("notional", 2))


@register("top4_last_rows", f"WITH {DAILY} SELECT pair, ts, {r('close', 'close')} FROM bars QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ts DESC) <= 90")
def _(spark, sf):
    from pyspark.sql import Window as W

    rows = tables.daily_bars(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("pair").orderBy(F.desc("ts"))))
    return rounded(rows.where("n <= 90").select("pair", "ts", "close"))


@register("flagship_sma_net_of_cost", f"""WITH {HOURLY}, {POS}, e AS (SELECT pair, ts, ret, exp(sum(ln(1 + ret)) OVER {BY}) AS equity FROM (SELECT pair, ts, ret / 100 AS ret FROM net)),
  d AS (SELECT *, max(equity) OVER {BY} AS peak FROM e) SELECT pair, count(*) AS bars, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(6240) ELSE 0 END, 6) AS sharpe,
  round(max(greatest(0, least(1, 1 - equity / peak))), 6) AS max_drawdown FROM d GROUP BY pair""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per pair, what an SMA crossover on hourly bars earns net of cost."""
    rows = simulate.net_returns(signals.sma_cross(tables.hourly_bars(spark, sf))).withColumn("ret", F.col("ret") / 100)
    rows = metrics.drawdowns(metrics.equity_from_returns(rows))
    sharpe = F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret") * 6240**0.5).otherwise(0.0)
    return rounded(rows.groupBy("pair").agg(
        F.count("*").alias("bars"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"), sharpe.alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
    ))
