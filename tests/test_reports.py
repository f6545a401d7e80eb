"""Stores, logs, the holdout guard and summaries on small cases."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, quality, signals
from tidemark.sources import files
from tidemark.streaming import jobs

DAY = datetime(2024, 1, 8)


def test_store_catalog_and_month_chunks(spark, tmp_path):
    bar = lambda p, h, c: (p, DAY + timedelta(hours=h), c)
    for name, rows in (("2024-01", [bar("a", 0, 1.0), bar("a", 1, 2.0)]), ("2024-02", [bar("a", 1, 9.0), bar("a", 2, 3.0), bar("b", 0, 4.0)])):
        spark.createDataFrame(rows, "pair string, ts timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "chunks" / name))
    chunks = spark.read.parquet(*[str(tmp_path / "chunks" / m) for m in ("2024-01", "2024-02")])
    got = files.assemble_months(chunks, F.col("_metadata.file_path"))
    assert sorted((r["pair"], r["ts"].hour, r["close"]) for r in got.collect()) == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 4.0)]
    files.write_bars(got.withColumn("timeframe", F.lit("1h")), str(tmp_path / "store"))
    for folder in (tmp_path / "store").glob("*/*"):  # no file is opened
        (folder / "part-broken.parquet").write_bytes(b"not parquet")
    assert sorted((r["timeframe"], r["pair"]) for r in files.catalog(spark, str(tmp_path / "store")).collect()) == [("1h", "a"), ("1h", "b")]
    for broken in (tmp_path / "store").glob("*/*/part-broken.parquet"):
        broken.unlink()


def test_logs_and_their_queries(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, "a", "mom", 1.0, "live", {"n": "20", "k": "1"}), (DAY + timedelta(days=40), "b", "mom", -1.0, "test", {"k": "1", "n": "20"}), (DAY, "a", "sma", 0.0, "live", {"n": "5"})], "ts timestamp, pair string, strategy string, signal double, source string, params map<string,string>")
    files.log_predictions(rows, str(tmp_path / "p"))
    log = spark.read.parquet(str(tmp_path / "p"))
    hashes = {(r["strategy"], r["pair"]): r["params_hash"] for r in log.collect()}
    assert hashes["mom", "a"] == hashes["mom", "b"] != hashes["sma", "a"] and len(hashes["mom", "a"]) == 12
    assert files.query_log(log, start="2024-02-01").count() == 1 and files.query_log(log, end="2024-02-01", strategy="mom", source="live").count() == 1
    fills = spark.createDataFrame([(DAY, "a", 1.5, None, "x"), (DAY, "b", 2.5, 7, None)], "ts timestamp, pair string, fill_price double, regime int, note string")
    files.log_fills(fills, str(tmp_path / "f"), ["ts", "pair", "fill_price"])
    assert {r["pair"]: r["ctx"] for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {"a": {"note": "x"}, "b": {"regime": "7"}}
    trials = spark.createDataFrame([(DAY, "1", "s", {"sharpe": 0.4}, {"n": 1.0}, ["x", "y"]), (DAY, "2", "s", {"sharpe": 0.9}, {"n": 1.0}, ["x"]), (DAY, "3", "t", {"sharpe": 0.9}, {"n": 1.0}, ["x", "y"])], "ts timestamp, trial_id string, strategy string, metrics map<string,double>, params map<string,double>, tags array<string>")
    files.log_trials(trials, str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t"))
    config = {r["trial_id"]: r["config_hash"] for r in kept.collect()}
    assert config["1"] == config["2"] != config["3"]
    assert [r["trial_id"] for r in files.query_log(kept, least_sharpe=0.5, tags=["y", "x"]).collect()] == ["3"]


def test_holdout_guard(spark):
    rows = spark.createDataFrame([("a", "1h", DAY), ("b", "1h", DAY + timedelta(days=2))], "pair string, timeframe string, ts timestamp")
    cut = str(DAY + timedelta(days=1))
    assert files.guard_holdout(files.holdout(rows, cut), cut).count() == 1
    with pytest.raises(ValueError, match="must not see"):
        files.guard_holdout(rows, cut)
    burnt = rows.where("pair = 'b'").select("pair", "timeframe")
    assert files.guard_holdout(rows, cut, burnt.limit(0), after=True).count() == 1
    with pytest.raises(ValueError, match="used before"):
        files.guard_holdout(rows, cut, burnt, after=True)


def test_manifest_and_bar_checks(spark):
    counts = {1: 20, 2: 10, 3: 0, 4: 24, 5: 3, 6: 22, 7: 2}
    bars = spark.createDataFrame([("a", datetime(2024, m, 1 + d), 1.0) for m, n in counts.items() for d in range(n)], "pair string, ts timestamp, close double")
    got = {r["month"].month: r["status"] for r in quality.month_manifest(bars, 5).collect()}
    assert got == {1: "OK", 2: "OK", 3: "ZERO", 4: "OK", 5: "LOW", 6: "OK", 7: "PARTIAL"}
    rows = [("a", DAY, 1, 1.0, 0.0), ("a", DAY, 2, 1.0, 1.0), ("a", DAY + timedelta(hours=2), 3, 2.0, 1.0), ("a", DAY + timedelta(hours=1), 4, float("nan"), 1.0)]
    bars = spark.createDataFrame([(p, t, s, c, c, c, c, v, 0.0) for p, t, s, c, v in rows], "pair string, ts timestamp, seq long, open double, high double, low double, close double, volume double, spread_median_pips double")
    r = quality.spread_and_spike_checks(bars).first()
    assert (r["bad_spread"], r["bad_volume"], r["duplicates"], r["missing"], r["unordered"]) == (4, 1, 1, 1, 1)


def test_independent_bets(spark):
    rho = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): -0.2}
    got = metrics.independent_bets(spark.createDataFrame([(*k, v) for k, v in rho.items()], "a string, b string, rho double")).first()
    m = np.array([[1, 0.9, 0.1], [0.9, 1, -0.2], [0.1, -0.2, 1]])
    share = np.linalg.eigvalsh(m) / 3
    want = share.max(), 1 / (share**2).sum(), np.exp(-(share * np.log(share)).sum())
    assert (got["top_share"], got["participation"], got["entropy"]) == pytest.approx(want) and got["effective"] == pytest.approx(min(1 / want[0], want[1], want[2]))
    with pytest.raises(ValueError):
        metrics.independent_bets(spark.createDataFrame([("a", "b", 0.5)], "a string, b string, rho double"), most=1)


def test_annual_growth_and_static_carry(spark):
    eq = spark.createDataFrame([("a", DAY, 100.0), ("a", DAY + timedelta(days=731), 121.0), ("b", DAY, 1.0), ("b", DAY + timedelta(days=1), 0.0)], "pair string, ts timestamp, equity double")
    got = {r["pair"]: r["annual"] for r in metrics.annualised(eq).collect()}
    assert got["a"] == pytest.approx(1.21 ** (365.25 / 731) - 1) and got["b"] == -1
    rows = spark.createDataFrame([("a", 0.5, -1.0), ("b", -0.5, 0.2), ("c", -0.5, -0.1)], "pair string, long double, short double")
    assert {r["pair"]: r["signal"] for r in signals.static_carry(rows, "long", "short").collect()} == {"a": 1, "b": -1, "c": 0}
    held = spark.createDataFrame([("USDJPY", DAY, 2.0, 100.0), ("USDJPY", DAY + timedelta(days=1), 0.0, 100.0), ("EURUSD", DAY, 2.0, 1.0), ("EURUSD", DAY + timedelta(days=1), 0.0, 1.0)], "pair string, ts timestamp, held double, close double")
    assert {r["pair"]: r["accrued"] for r in jobs.swap_accrual(held, 0.5, "JPY").where("accrued > 0").collect()} == pytest.approx({"USDJPY": 0.01, "EURUSD": 1.0})


def test_family_summary_counts_none_where_no_sharpe_stands(spark, tmp_path):
    """A spread that never changes: the rule for narrow spreads never trades, no series has a Sharpe, and none of them is over 0."""
    import duckdb

    from tidemark.plans import market, research  # noqa: F401

    rng = np.random.default_rng(9)
    rows = [(i, DAY + timedelta(hours=i // 8), 1, ("click", "view")[i % 2], float(v), '{"k": 3}') for i, v in enumerate(np.round(50 + rng.random(240) * 9, 2))]
    ticks = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    ticks.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = market.QUERIES["met22_family_summary"](spark, str(tmp_path))
    got, want = (sorted(tuple(r) for r in rows) for rows in (df.collect(), con.sql(f"SELECT {', '.join(df.columns)} FROM ({market.SQL['met22_family_summary']})").fetchall()))
    assert got == want and {r[0]: r[1:] for r in got}["spread_filtered_reversal"] == (None, None, None, 0, None, None) and any(r[1] is not None for r in got)
