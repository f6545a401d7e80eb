"""Holes are planted here, and the queries over whole tables lose no measured row."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tidemark.operators import costs, events, quality, resample
from tidemark.plans import decisions, market, reports, research  # noqa: F401

DIR = "/root/testdata/sf0.001"
MONDAY = datetime(2024, 1, 8)


def hours(spark, present, schema="pair string, ts timestamp, spread_pips double"):
    return spark.createDataFrame([("a", MONDAY + timedelta(hours=h), float(x)) for h, x in present], schema)


def test_curve_fills_holes_only(spark):
    curve = resample.hour_curve(hours(spark, [(h, h + 1) for h in range(24) if h not in (4, 5, 23)]))
    got = {r["hour"]: r["spread"] for r in curve.collect()}
    assert got == pytest.approx({h: h + 1 for h in range(23)} | {23: 12.0})
    bars = hours(spark, [(22, 0), (23, 0)]).union(hours(spark, [(1, 0)]).selectExpr("'b'", "ts", "spread_pips"))
    paid = {(r["pair"], r["ts"].hour): r["curve_spread"] for r in costs.hour_curve_cost(bars, curve, 2.5).collect()}
    assert paid == pytest.approx({("a", 22): 23.0, ("a", 23): 12.0, ("b", 1): 2.5})


def test_missing_hours_are_those_that_miss(spark):
    full = quality.missing_hours(hours(spark, [(h, 0) for h in range(48)])).collect()[0]
    assert (full["expected"], full["present"], full["longest_gap"]) == (48, 48, 0)
    r = quality.missing_hours(hours(spark, [(h, 0) for h in range(48) if h not in (5, 10, 11, 12)])).collect()[0]
    assert (r["expected"], r["present"], r["longest_gap"]) == (48, 44, 3)


def test_quarter_without_a_rate_is_filled(spark):
    rows = [("u", datetime(2024, m, 1), float(m)) for m in (1, 3, 5, 11)]
    got = [r["rate"] for r in resample.quarter_end(spark.createDataFrame(rows, "currency string, ts timestamp, rate double")).orderBy("quarter").collect()]
    assert got == [3.0, 5.0, 5.0, 11.0]


def test_widest_bar_of_event_days_only(spark):
    bars = spark.createDataFrame([("a", MONDAY + timedelta(hours=h), 10.0 + h % 7, 9.0, 9.5) for h in range(72)], "pair string, ts timestamp, high double, low double, close double")
    days = spark.createDataFrame([("a", MONDAY + timedelta(days=1))], "pair string, day timestamp")
    got = events.widest_bar(bars, days).collect()
    assert [(r["ts"], r["tr"]) for r in got] == [(MONDAY + timedelta(hours=27), 7.0)]


def test_whole_queries_keep_all_rows(spark):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    run = {n: market.QUERIES[f"{n}_whole"](spark, DIR) for n in ("rs4_hour_curve", "dq8_missing_hours", "cst5_hour_curve_cost", "rs5_quarter_end", "jn8_widest_bar")}
    measured = {r[:2]: r[2] for r in con.sql(f"WITH {market.TICKS} SELECT pair, hour(ts), quantile_cont(spread_pips, 0.5) FROM ticks WHERE isodow(ts) < 6 GROUP BY ALL").fetchall()}
    assert any(h % 2 for _, h in measured)
    curve = {(r["pair"], r["hour"]): r["spread"] for r in run["rs4_hour_curve"].collect()}
    assert {k: curve[k] for k in measured} == pytest.approx(measured, abs=1e-6)
    for r in run["cst5_hour_curve_cost"].collect():
        assert r["curve_spread"] == pytest.approx(curve[r["pair"], r["ts"].hour], abs=1e-6)
    present = dict(con.sql(f"WITH {market.HOURLY} SELECT pair, count(*) FROM bars WHERE {market.SESSION} GROUP BY pair").fetchall())
    assert {r["pair"]: r["present"] for r in run["dq8_missing_hours"].collect()} == present
    assert run["jn8_widest_bar"].count() == con.sql("SELECT count(DISTINCT (event_type, date_trunc('day', ts))) FROM events").fetchall()[0][0]
    third = con.sql("SELECT count(DISTINCT (l_returnflag, date_trunc('quarter', l_shipdate))) FROM lineitem WHERE quarter(l_shipdate) = 3").fetchall()[0][0]
    assert third and run["rs5_quarter_end"].where("quarter(quarter) = 3").count() >= third
