"""Registered queries that write the tables through a sink or a stream and read them back: stores, chunks, tick files, logs, live jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.decisions import snapshots
from tidemark.plans.market import DAILY, HOURLY, SQL, TICKS, r, register, rounded
from tidemark.plans.studies import cycles
from tidemark.sources import files, tables
from tidemark.streaming import jobs

OHLCV = ("open", "high", "low", "close", "volume")
PRICES_SQL = ", ".join(r(c, c) for c in OHLCV)

# ---- stores ------------------------------------------------------------------------------------------------------------------------


def _timed(spark, sf):
    """Hourly and daily bars with their timeframe."""
    both = [b.select(F.lit(k).alias("timeframe"), "pair", "ts", *OHLCV) for k, b in (("hour", tables.hourly_bars(spark, sf)), ("day", tables.daily_bars(spark, sf)))]
    return both[0].unionByName(both[1])


@register("src1_csv_bars", f"WITH {DAILY} SELECT upper(pair) AS pair, ts, {PRICES_SQL} FROM bars")
def _(spark, sf):
    folder = files.scratch(spark, "src1")
    bars = tables.daily_bars(spark, sf).select("pair", F.col("ts").alias("Date"), *[F.col(c).alias(c.title()) for c in OHLCV])
    bars.write.partitionBy("pair").csv(folder, header=True)
    return rounded(files.csv_bars(spark, folder))


@register("src2_parquet_range", f"WITH {HOURLY} SELECT pair, ts, {PRICES_SQL} FROM bars WHERE pair = 'click' AND ts BETWEEN TIMESTAMP '2024-01-10 05:00' AND TIMESTAMP '2024-02-20 12:00'")
def _(spark, sf):
    folder = files.scratch(spark, "src2")
    files.write_bars(_timed(spark, sf), folder)
    return rounded(files.parquet_bars(spark, folder, "click", "hour", "2024-01-10 05:00:00", "2024-02-20 12:00:00").select("pair", "ts", *OHLCV))


@register("src3_parquet_store", f"WITH {HOURLY}, hourly AS (SELECT * FROM bars), days AS (WITH {DAILY} SELECT * FROM bars), b AS (SELECT 'hour' AS timeframe, * FROM hourly UNION ALL SELECT 'day', * FROM days) SELECT timeframe, pair, ts, {PRICES_SQL} FROM b")
def _(spark, sf):
    folder = files.scratch(spark, "src3")
    files.write_bars(_timed(spark, sf), folder)
    return rounded(spark.read.parquet(folder).select("timeframe", "pair", "ts", *OHLCV))


@register("src7_month_chunks", f"WITH {DAILY} SELECT pair, ts, strftime(ts - CASE WHEN day(ts) = 1 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END, '%Y-%m') AS chunk, {PRICES_SQL} FROM bars")
def _(spark, sf):
    """Chunks that end with the first day of the next month, so that this day is in two of them; the earlier one's bar stays."""
    folder = files.scratch(spark, "src7")
    month = lambda ts: F.date_format(ts, "yyyy-MM")
    own = F.array(month(F.col("ts")))
    held = F.when(F.dayofmonth("ts") == 1, F.array_append(own, month(F.add_months("ts", -1)))).otherwise(own)
    tables.daily_bars(spark, sf).select("pair", "ts", *OHLCV, F.explode(held).alias("chunk")).write.partitionBy("chunk").parquet(folder)
    return rounded(files.assemble_months(spark.read.parquet(folder), F.col("chunk")).select("pair", "ts", "chunk", *OHLCV))


@register("src6_tick_files", f"""WITH {TICKS}, u AS (SELECT pair, date_trunc('milliseconds', ts) AS ts, floor(mid * 100) + 1 AS bid, floor(mid * 100) + spread_pips - 1 AS ask, ask_vol FROM ticks)
  SELECT pair, ts, {r('(ask / 1e2 + bid / 1e2) / 2', 'mid')}, ask_vol, {r('greatest(ask / 1e2 - bid / 1e2, 0) / 1e-2', 'spread_pips')}, ask < bid AS crossed FROM u""")
def _(spark, sf):
    bid = F.floor(F.col("mid") * 100) + 1
    ticks = tables.ticks(spark, sf).select("pair", "ts", ((bid + F.col("spread_pips") - 2) / 100).alias("ask"), (bid / 100).alias("bid"), "ask_vol", F.lit(1.0).alias("bid_vol"), "seq")
    folder = files.scratch(spark, "src6")
    files.tick_files(ticks, 100.0).write.parquet(folder)
    return rounded(files.compressed_ticks(spark.read.parquet(folder), 100.0, 0.01).select("pair", "ts", "mid", "ask_vol", "spread_pips", "crossed"))


# ---- logs --------------------------------------------------------------------------------------------------------------------------


def _orders(spark, sf):
    return tables.read(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))


@register("src8_json_lines", "SELECT o_orderkey AS trial_id, o_orderdate AS ts, o_orderpriority AS strategy, CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus END AS status FROM orders")
def _(spark, sf):
    """A record a line, each with a blank line after it; a null field is left out of its record."""
    folder = files.scratch(spark, "src8")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("trial_id"), "ts", F.col("o_orderpriority").alias("strategy"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus")).alias("status")))
    _orders(spark, sf).select(F.explode(F.array(record, F.lit(" "))).alias("value")).write.text(folder)
    return files.json_lines(spark, folder, "trial_id long, ts timestamp, strategy string, status string").drop("file", "seq")


def _digest(entries: str) -> str:
    """12 digits of the hash of a map's entries, in SQL."""
    return f"substr(sha256('[' || {entries} || ']'), 1, 12)"


def _entry(key: str, value: str) -> str:
    return f"""'{{"key":"{key}","value":"' || {value} || '"}}'"""


@register("src9_prediction_log", f"SELECT o_orderdate AS ts, o_orderpriority AS pair, o_orderkey AS seq, (o_custkey % 3 - 1)::DOUBLE AS signal, {_digest(_entry('fast', 'o_custkey % 4') + " || ',' || " + _entry('slow', 'o_custkey % 7'))} AS params_hash, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, sf):
    folder, k = files.scratch(spark, "src9"), F.col("o_custkey")
    rows = _orders(spark, sf).select(
        "ts", F.col("o_orderpriority").alias("pair"), F.col("o_orderkey").alias("seq"), (k % 3 - 1).cast("double").alias("signal"),
        F.create_map(F.lit("slow"), (k % 7).cast("string"), F.lit("fast"), (k % 4).cast("string")).alias("params"),
    )
    files.log_predictions(rows, folder)
    return spark.read.parquet(folder)


@register("src10_execution_log", "SELECT o_orderkey AS trade_id, o_orderdate AS ts, o_totalprice AS size, o_orderstatus AS venue, CASE WHEN o_custkey % 3 > 0 THEN o_custkey::VARCHAR END AS desk, 1 + (o_custkey % 3 > 0)::INT AS n_context, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, sf):
    folder, k = files.scratch(spark, "src10"), F.col("o_custkey")
    rows = _orders(spark, sf).select(F.col("o_orderkey").alias("trade_id"), "ts", F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("venue"), F.when(k % 3 > 0, k).alias("desk"))
    files.log_fills(rows, folder, ["trade_id", "ts", "size"])
    return spark.read.parquet(folder).select("trade_id", "ts", "size", F.col("ctx")["venue"].alias("venue"), F.col("ctx")["desk"].alias("desk"), F.size("ctx").alias("n_context"), "month")


def _trials(spark, sf) -> DataFrame:
    """A log of trials, read back."""
    folder, k = files.scratch(spark, "trials"), F.col("o_custkey")
    files.log_trials(_orders(spark, sf).select(
        "ts", F.col("o_orderkey").alias("trial_id"), F.col("o_orderpriority").alias("strategy"), F.create_map(F.lit("sharpe"), F.col("o_totalprice"), F.lit("n"), (k % 50).cast("double")).alias("metrics"),
        F.create_map(F.lit("n"), k % 5, F.lit("lag"), k % 2).alias("params"), F.when(k % 3 == 0, F.array("o_orderstatus")).otherwise(F.array("o_orderstatus", F.lit("retest"))).alias("tags"),
    ), folder)
    return spark.read.parquet(folder)


CONFIG = _digest(" || ',' || ".join((_entry("__strategy", "o_orderpriority"), _entry("lag", "o_custkey % 2"), _entry("n", "o_custkey % 5"))))


@register("src11_experiment_table", f"SELECT o_orderkey AS trial_id, o_orderdate AS ts, o_orderpriority AS strategy, o_totalprice AS sharpe, o_custkey % 5 AS n, 1 + (o_custkey % 3 > 0)::INT AS n_tags, {CONFIG} AS config_hash, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, sf):
    rows = _trials(spark, sf).select("trial_id", "ts", "strategy", F.col("metrics")["sharpe"].alias("sharpe"), F.col("params")["n"].alias("n"), F.size("tags").alias("n_tags"), "config_hash", "month")
    return rounded(rows)


@register("flt7_stored_trials", f"SELECT o_orderkey AS trial_id, o_orderdate AS ts, o_totalprice AS sharpe FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-10' AND o_orderdate < TIMESTAMP '2000-07-15' AND o_orderpriority = '2-HIGH' AND o_totalprice >= 150000 AND o_orderstatus = 'O' AND o_custkey % 3 > 0")
def _(spark, sf):
    found = files.query_log(_trials(spark, sf), "1995-03-10", "2000-07-15", strategy="2-HIGH", least_sharpe=150000.0, tags=["retest", "O"])
    return rounded(found.select("trial_id", "ts", F.col("metrics")["sharpe"].alias("sharpe")))


# ---- streams -----------------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    rows.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@register("str2_first_bars", f"WITH {HOURLY} SELECT pair, ts, round(close, 6) AS close FROM bars")
def _(spark, sf):
    """Bars that are delivered again, at another price, after a restart: the first of each stamp stays."""
    folder, bars = files.scratch(spark, "str2"), tables.hourly_bars(spark, sf).select("pair", "ts", "close")
    for again in range(2):
        jobs.run_to_end(jobs.first_bars(_stream(spark, bars.withColumn("close", F.col("close") + again), f"{folder}/in")), folder)
    return rounded(spark.read.parquet(f"{folder}/out"))


def _live(spark: SparkSession, rows: DataFrame, job, name: str) -> DataFrame:
    """rows through a stream job, read back from its sink."""
    folder = files.scratch(spark, name)
    jobs.run_to_end(job(_stream(spark, rows, f"{folder}/in")), folder)
    return spark.read.parquet(f"{folder}/out")


def _equity(spark, sf):
    return tables.daily_bars(spark, sf).select("pair", "ts", F.col("close").alias("equity"), (F.dayofmonth("ts") % 5 == 0).alias("is_mock"))


@register("str4_live_ladder", SQL["str4_drawdown_ladder"])
def _(spark, sf):
    return rounded(_live(spark, _equity(spark, sf), jobs.live_ladder, "str4").select("pair", "ts", "drawdown", "level", "size"))


@register("str5_live_aggregate_ladder", SQL["str5_aggregate_ladder"])
def _(spark, sf):
    rows = _live(spark, snapshots(spark, sf), jobs.live_aggregate_ladder, "str5")
    return rounded(rows.select("pair", "seq", "reason", "drawdown", "level", "size", "dispatch", "flat"))


@register("str6_live_composition", SQL["str6_composed_ladders"])
def _(spark, sf):
    """Each ladder writes its log; a third stream joins the two logs."""
    folder, logs = files.scratch(spark, "str6"), []
    equity = _stream(spark, _equity(spark, sf), f"{folder}/in")
    for name, levels in (("one", jobs.LADDER), ("two", (0.08, 0.25, 0.4))):
        jobs.run_to_end(jobs.live_ladder(equity, levels).select("pair", "ts", "size"), f"{folder}/{name}")
        logs.append(spark.readStream.schema("pair string, ts timestamp, size double").parquet(f"{folder}/{name}/out").withWatermark("ts", "1 day"))
    jobs.run_to_end(jobs.compose(*logs), f"{folder}/both")
    return spark.read.parquet(f"{folder}/both/out")


@register("str7_live_reconciliation", SQL["str7_reconciliation"])
def _(spark, sf):
    rows = _live(spark, cycles(spark, sf), lambda c: jobs.live_reconcile(c, 50.0, 0.003), "str7")
    return rows.select("strategy", "seq", F.round("modelled", 4).alias("modelled"), F.round("residual", 4).alias("residual"), "breach", "double_breach", "in_a_row")
