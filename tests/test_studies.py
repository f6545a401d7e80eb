"""Drift trades, carry holds, stress cells, warmed windows and live jobs on small cases."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, events, indicators as ind, signals, simulate, walkforward
from tidemark.streaming import jobs

MONDAY = datetime(2024, 1, 8)
BAR = "pair string, ts timestamp, open double, high double, low double, close double, spread_median_pips double"


def hours(spark, rows):
    return spark.createDataFrame([("a", MONDAY + timedelta(hours=h), *map(float, v)) for h, v in enumerate(rows)], BAR)


def drift(spark, bars, **more):
    days = bars.select("pair", F.date_trunc("day", "ts").alias("day"))
    args = dict(hold=3, surprise=1.5, trailing=4, stop=1.0, atr_n=2, pip=0.01) | more
    return events.drift_trades(bars, days, **args).collect()


def test_drift_trades(spark):
    flat = (10, 10.5, 9.5, 10, 1)
    wide = (10, 14, 10, 13, 1)  # up, true range 4 against a median of 1
    # held to the end
    r = drift(spark, hours(spark, [flat] * 5 + [wide, (13, 14, 12, 13, 2), (13, 14, 12, 13.5, 1), (13, 14, 12, 13.5, 1), (13, 15, 12, 14, 3), (14, 14.5, 13.5, 14, 1)]))
    assert len(r) == 1 and r[0]["reason"] == "hold" and r[0]["entry_ts"] == MONDAY + timedelta(hours=6) and r[0]["exit_ts"] == MONDAY + timedelta(hours=9)
    assert r[0]["direction"] == 1 and r[0]["gross"] == pytest.approx(100) and r[0]["cost"] == pytest.approx(2 + 3 + 0.8) and r[0]["net"] == pytest.approx(94.2)
    # the stop lies half an ATR of the entry bar, (4 + 3.5) / 2, under its open; the entry bar itself is not looked at
    low = [flat] * 5 + [wide, (13, 13.5, 10, 13, 2), (13, 13.2, 11.5, 12, 1), (12, 12, 11, 11.2, 4), flat, flat]
    r = drift(spark, hours(spark, low), stop=0.5)
    assert r[0]["reason"] == "stop" and r[0]["exit_ts"] == MONDAY + timedelta(hours=8) and r[0]["gross"] == pytest.approx(-180)
    assert drift(spark, hours(spark, low), stop=100.0)[0]["reason"] == "hold"
    # the data ends
    r = drift(spark, hours(spark, [flat] * 5 + [wide, (13, 14, 12, 13.5, 2), (13, 14, 12, 12.5, 1)]))
    assert r[0]["reason"] == "end_of_data" and r[0]["gross"] == pytest.approx(-50)
    r = drift(spark, hours(spark, [flat] * 5 + [wide, (13, 14, 12, 13.5, 2)]))
    assert r[0]["reason"] == "end_of_data" and r[0]["entry_ts"] == r[0]["exit_ts"] and r[0]["gross"] == pytest.approx(50)
    # no surprise, no direction, no spread, no next bar, too short a past
    for rows in ([flat] * 9, [flat] * 5 + [(10, 14, 6, 10, 1), flat, flat], [flat] * 5 + [wide, (13, 14, 12, 13, 0), flat], [flat] * 5 + [wide], [flat] * 3 + [wide, flat, flat]):
        assert drift(spark, hours(spark, rows)) == []
    # down, and the first of two bars of equal range
    down = (10, 10, 6, 7, 1)
    r = drift(spark, hours(spark, [flat] * 5 + [down, (7, 11, 7, 8, 1), (8, 9, 7, 7.5, 1), flat, flat]))
    assert r[0]["direction"] == -1 and r[0]["bar_ts"] == MONDAY + timedelta(hours=5) and r[0]["entry_ts"] == MONDAY + timedelta(hours=6)


def test_drift_verdicts(spark):
    rows = spark.createDataFrame([(p, float(g), 1.0, "stop" if i == 0 else "hold") for p, g, n in (("few", 9, 14), ("poor", 1, 15), ("near", 1.2, 15), ("good", 1.3, 15)) for i in range(n)], "pair string, gross double, cost double, reason string")
    got = {r["pair"]: (r["verdict"], r["fires"], r["stops"]) for r in events.drift_verdict(rows, 1.0).collect()}
    assert got == {"few": ("FAIL", 14, 1), "poor": ("FAIL", 15, 1), "near": ("STRETCH", 15, 1), "good": ("PASS", 15, 1)}


def plain_holds(close, diff, spread, least, crash, n, m, overhead, pip):
    """Bar by bar."""
    size = len(close)
    lr = [None] + [np.log(close[i] / close[i - 1]) for i in range(1, size)]
    vol = [np.std(lr[i - n + 1 : i + 1], ddof=1) if i >= n else None for i in range(size)]
    usual = [np.median(vol[i - m + 1 : i + 1]) if i >= n + m - 1 else None for i in range(size)]
    sig = [0.0 if usual[i] is not None and vol[i] > crash * usual[i] or diff[i] is None or abs(diff[i]) <= least else float(np.sign(diff[i])) for i in range(size)]
    pos = [0.0, *sig[:-1]]
    cost = [0.0] + [abs(pos[i] - pos[i - 1]) * ((spread[i] if spread[i] and spread[i] > 0 else 0) + overhead) for i in range(1, size)]
    out, i = [], 0
    while i < size:
        if not pos[i]:
            i += 1
            continue
        j = i
        while j + 1 < size and pos[j + 1] == pos[i]:
            j += 1
        if spread[i] and spread[j] and spread[i] > 0 and spread[j] > 0:
            mean = np.mean([abs(d or 0.0) for d in diff[i : j + 1]])
            out.append((i, j, pos[i], mean * max(j - i, 1) / 365 * 0.5 / pip, pos[i] * (close[j] - close[i]) / pip, sum(cost[i : j + 2])))
        i = j + 1
    return out


def test_carry_holds(spark):
    rng = np.random.default_rng(2)
    close = 100 * np.exp(np.cumsum(rng.normal(size=200) * np.where(rng.random(200) < 0.1, 0.05, 0.01)))
    diff = [None if k == 3 else float(d) for k, d in zip(rng.integers(0, 9, 200), np.repeat(rng.normal(size=20) * 0.02, 10))]
    spread = [None if k == 0 else float(k - 1) for k in rng.integers(0, 6, 200)]
    rows = spark.createDataFrame([("a", MONDAY + timedelta(days=i), float(c), s, d) for i, (c, s, d) in enumerate(zip(close, spread, diff))], "pair string, ts timestamp, close double, spread_median_pips double, diff double")
    got = sorted(simulate.carry_holds(rows, 0.005, 1.5, 5, 12, pip=0.01, overhead=0.8).collect(), key=lambda r: r["entry_ts"])
    want = plain_holds(close, diff, spread, 0.005, 1.5, 5, 12, 0.8, 0.01)
    assert len(got) == len(want) > 10
    for r, (i, j, side, carry, drift_, cost) in zip(got, want):
        assert (r["entry_ts"], r["exit_ts"], r["direction"], r["days"]) == (MONDAY + timedelta(days=i), MONDAY + timedelta(days=j), side, j - i)
        assert (r["carry"], r["drift"], r["cost"]) == pytest.approx((carry, drift_, cost)) and r["net"] == pytest.approx(carry + drift_ - cost)


def test_flip_costs_two_round_trips(spark):
    """Positions 0, +1, +1, -1, 0 at a spread of 2 and an overhead of 0.8 cost 11.20 pips; the flip 5.60, in both holds that meet there."""
    diffs = [1.0, 1.0, -1.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([("a", MONDAY + timedelta(days=i), 100.0, 2.0, d) for i, d in enumerate(diffs)], "pair string, ts timestamp, close double, spread_median_pips double, diff double")
    assert simulate.turnover_cost(rows.withColumn("signal", F.signum("diff")), "spread_median_pips", 0.8).agg(F.sum("cost_pips")).first()[0] == pytest.approx(11.2)
    assert sorted(r["cost"] for r in simulate.carry_holds(rows).collect()) == pytest.approx([8.4, 8.4])


def test_stress_cells(spark):
    rng = np.random.default_rng(3)
    close = 100 + rng.normal(size=120).cumsum()
    sig = np.sign(np.sin(np.arange(120) / 7))
    rows = spark.createDataFrame([(p, MONDAY + timedelta(days=i), float(c), float(s), 1.0, 1.0) for p in "ab" for i, (c, s) in enumerate(zip(close, sig))], "pair string, ts timestamp, close double, signal double, atr double, spread_median_pips double")
    cells = simulate.stress_cells(rows, 4).toPandas().sort_values(["pair", "ts"])
    by = {k: g["signal"].to_numpy() for k, g in cells.groupby("pair")}
    assert len(by) == 2 * (3 + 8)
    assert (by["a#baseline#0"] == sig).all() and (by["a#double_costs#0"] == sig).all() and (by["a#extra_delay#0"] == np.concatenate([[0], sig[:-1]])).all()
    for name, share in (("randomize_10pct", 0.1), ("randomize_25pct", 0.25)):
        changed = np.mean([by[f"{p}#{name}#{d}"] != sig for p in "ab" for d in range(4)])
        assert 0.4 * share < changed < 0.95 * share  # one in three draws is the signal itself
        assert (by[f"a#{name}#0"] != by[f"a#{name}#1"]).any() and (by[f"a#{name}#0"] != by[f"b#{name}#0"]).any()
    got = {(r["pair"], r["stress"], r["draw"]): r for r in simulate.stress_grid(rows, 4, pip=0.01).collect()}
    base = simulate.priced_trades(rows, pip=0.01)
    assert got["a", "baseline", 0]["trades"] == base.where("pair = 'a'").count()
    ends = {r["pair"]: r["e"] for r in simulate.discrete_equity(rows, base, 0.01).groupBy("pair").agg(F.max_by("equity", "ts").alias("e")).collect()}
    assert got["a", "baseline", 0]["total_return"] == pytest.approx(ends["a"] / 10_000 - 1)
    dear = simulate.priced_trades(rows.withColumn("twice", F.lit(2.0)), pip=0.01, multiplier="twice").agg(F.sum("cost_pips"), F.sum("entry_pips")).first()
    cheap = base.agg(F.sum("cost_pips"), F.sum("entry_pips")).first()
    assert tuple(dear) == pytest.approx((2 * cheap[0], 2 * cheap[1])) and got["a", "double_costs", 0]["total_return"] < got["a", "baseline", 0]["total_return"]
    report = {(r["pair"], r["stress"]): r for r in simulate.stress_report(simulate.stress_grid(rows, 4, pip=0.01)).collect()}
    assert report["a", "randomize_25pct"]["draws"] == 4 and report["a", "double_costs"]["below"] == 1 and report["a", "baseline"]["below"] == 0


@pytest.mark.parametrize("train, test, step, warm", [(40, 20, 10, None), (40, 20, 15, 25), (30, 30, 30, 0)])
def test_warmed_windows(spark, train, test, step, warm):
    rng = np.random.default_rng(4)
    sizes = {"a": 130, "b": train + test, "c": train + test - 1}
    closes = {p: 100 + rng.normal(size=n).cumsum() for p, n in sizes.items()}
    bars = spark.createDataFrame([(p, MONDAY + timedelta(days=i), float(c), float(c + 1), float(c - 1), float(c), 1.0) for p, x in closes.items() for i, c in enumerate(x)], BAR)
    seen = []

    def signal(rows):
        seen.append(rows)
        return ind.atr_simple(ind.ema(signals.momentum_signal(rows, 5), 8)).withColumn("signal", F.when(F.col("close") > F.col("ema"), 1.0).otherwise(-1.0))

    got = walkforward.run(bars, signal, train, test, step, warm, pip=0.01).collect()
    starts = {p: list(range(0, n - train - test + 1, step)) for p, n in sizes.items()}
    assert sorted((r["pair"], r["window"]) for r in got) == sorted((p, k) for p, s in starts.items() for k in range(len(s)))
    look = max(train, 250) if warm is None else warm
    counts = {r["pair"]: (r["n"], r["t"]) for r in seen[0].groupBy("pair").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {f"{p}#{k}": (test + min(look, s + train), test) for p, ss in starts.items() for k, s in enumerate(ss)}
    for r in got:  # one window at a time, through the same jobs
        a = starts[r["pair"]][r["window"]]
        part = bars.where(F.col("pair") == r["pair"]).where((F.col("ts") >= F.lit(MONDAY + timedelta(days=max(0, a + train - look)))) & (F.col("ts") < F.lit(MONDAY + timedelta(days=a + train + test))))
        assert r["test_start"] == MONDAY + timedelta(days=a + train) and r["test_end"] == MONDAY + timedelta(days=a + train + test - 1) and r["bars"] == test
        if r["window"] in (0, 2):
            tested = signal(part).where(F.col("ts") >= F.lit(r["test_start"]))
            trades = simulate.priced_trades(tested, pip=0.01)
            e = np.array([x["equity"] for x in simulate.discrete_equity(tested, trades, 0.01).orderBy("ts").collect()])
            ret = e[1:] / e[:-1] - 1
            assert r["trades"] == trades.count() and r["sharpe"] == pytest.approx(ret.mean() / ret.std(ddof=1) * 252**0.5, rel=1e-6) and r["max_drawdown"] == pytest.approx((1 - e / np.maximum.accumulate(e)).max())
    out = {r["pair"]: r for r in walkforward.verdict(spark.createDataFrame(got)).collect()}
    own = [r["sharpe"] for r in got if r["pair"] == "a"]
    assert out["a"]["avg_sharpe"] == pytest.approx(np.mean(own)) and out["a"]["consistent"] == (sum(s > 0 for s in own) > len(own) / 2) and "c" not in out


# ---- live jobs ---------------------------------------------------------------------------------------------------------------------


def replayed(spark, tmp_path, rows, live, cuts, order):
    """Three arrivals, each run to its end by a new start of the query; the last repeats a row."""
    for a, b in zip(cuts, cuts[1:]):
        rows.where((F.col(order) >= F.lit(a)) & (F.col(order) < F.lit(b))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_to_end(live(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "job"))
    rows.where(F.col(order) == F.lit(a)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.run_to_end(live(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "job"))
    return spark.read.parquet(str(tmp_path / "job" / "out"))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (sorted(map(str, df.select(sorted(want.columns)).collect())) for df in (got, want))
    assert a == b and a


def test_live_ladder(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(p, MONDAY + timedelta(hours=h), float(v), bool(rng.random() < 0.2)) for p in "abc" for h, v in enumerate(np.round(100 * np.exp(np.cumsum(rng.normal(size=40) * 0.06)), 3))], "pair string, ts timestamp, equity double, is_mock boolean")
    cuts = [MONDAY + timedelta(hours=h) for h in (0, 11, 30, 40)]
    got = replayed(spark, tmp_path, rows, jobs.live_ladder, cuts, "ts")
    same(got, jobs.ladder(rows))
    assert {r["level"] for r in got.collect()} == {0, 1, 2, 3}


def test_live_aggregate_ladder(spark, tmp_path):
    rng = np.random.default_rng(6)
    made = []
    for p in "ab":
        for q, v in enumerate(np.round(100 * np.exp(np.cumsum(rng.normal(size=60) * 0.03)), 3)):
            at = MONDAY + timedelta(minutes=3 * q - (40 if rng.random() < 0.15 else 0))
            made.append((p, q, at, at + timedelta(seconds=int(rng.integers(0, 70))), float(v), bool(rng.random() < 0.2)))
    rows = spark.createDataFrame(made, "pair string, seq long, ts timestamp, received timestamp, equity double, is_mock boolean")
    got = replayed(spark, tmp_path, rows, jobs.live_aggregate_ladder, [0, 20, 21, 60], "seq")
    same(got, jobs.aggregate_ladder(rows))
    assert {r["reason"] for r in got.collect()} == {None, "stale", "out of order"}


def cycles(spark):
    rng = np.random.default_rng(7)
    rows = [(s, q, str(rng.choice(["EURUSD", "USDJPY", "GBPUSD"])), float(np.round(100 + rng.normal() * 2, 3)), float(rng.integers(0, 4) * 10), float(rng.integers(0, 3)), float(rng.integers(0, 2)), float(1000 + rng.integers(-40, 40)), bool(rng.random() < 0.2)) for s in "xy" for q in range(80)]
    return rows, spark.createDataFrame(rows, "strategy string, seq long, pair string, mid double, held double, cost double, swap double, broker double, is_mock boolean")


def test_live_reconciliation(spark, tmp_path):
    rows, df = cycles(spark)
    live = lambda s: jobs.live_reconcile(s, 20.0, 0.03).withColumns({c: F.round(c, 6) for c in ("modelled", "residual", "tolerance")})
    got = replayed(spark, tmp_path, df, live, [0, 33, 50, 80], "seq")
    same(got, jobs.reconcile(df, 20.0, 0.03).withColumns({c: F.round(c, 6) for c in ("modelled", "residual", "tolerance")}))
    assert max(r["in_a_row"] for r in got.collect()) > 1


def test_reconciliation_cycle_by_cycle(spark):
    rows, df = cycles(spark)
    got = {(r["strategy"], r["seq"]): r for r in jobs.reconcile(df, 20.0, 0.03).collect()}
    for s in "xy":
        mids, peak, run, model = {}, 0.0, 0, None
        for _, q, pair, mid, held, cost, swap, broker, mock in [r for r in rows if r[0] == s]:
            model = broker if model is None else model
            if mids.get(pair, 0) > 0 and held > 0:
                model += (held / mids[pair] if "JPY" in pair else held) * (mid - mids[pair])
            model, mids[pair] = model + swap - cost, mid
            peak = peak if mock else max(peak, broker)
            tolerance = max(20.0, 0.03 * peak)
            breach = not mock and abs(broker - model) > tolerance
            run = run if mock else run + 1 if breach else 0
            r = got[s, q]
            assert (r["modelled"], r["tolerance"]) == pytest.approx((model, tolerance)) and (r["breach"], r["double_breach"], r["in_a_row"]) == (breach, not mock and abs(broker - model) > 2 * tolerance, run)


def test_a_short_holding_is_an_error(spark, tmp_path):
    _, df = cycles(spark)
    df.limit(3).withColumn("held", F.lit(-1.0)).coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="long only"):
        jobs.run_to_end(jobs.live_reconcile(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 1.0, 0.1), str(tmp_path / "job"))


def test_ordered_rows_from_many_runs():
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"seq": rng.integers(0, 40, 200), "ts": [MONDAY + timedelta(hours=int(h)) if h else None for h in rng.integers(0, 30, 200)], "x": range(200)})
    for order in ("seq", "ts"):
        want = frame.sort_values(order, kind="stable")["x"].tolist()
        for run, block in ((9, 4), (50, 50), (1000, 10)):
            kept = [r.x for r in jobs.ordered((frame[i : i + 6] for i in range(0, 200, 6)), order, run, block)]
            firsts = frame.loc[kept].dropna(subset=[order]).drop_duplicates(order)["x"].tolist()
            assert sorted(kept) == list(range(200)) and frame.loc[kept, order].tolist()[:150] == frame.loc[want, order].tolist()[:150]
            assert firsts == frame.loc[want].dropna(subset=[order]).drop_duplicates(order)["x"].tolist() and (block < run or kept == want)
    assert list(jobs.ordered(iter([]), "seq")) == []


def test_rows_of_a_key_wait_outside_memory(spark, monkeypatch):
    """The function that Spark calls for one key with 300,000 rows out of order: it holds few of them at a time."""
    import tracemalloc

    class State:
        exists = False

        def update(self, value):
            self.value = value

    n, made, state = 300_000, [], State()
    rows = spark.createDataFrame([], "pair string, seq long")
    monkeypatch.setattr(type(rows.groupBy("pair")), "applyInPandasWithState", lambda self, f, *_: made.append(f))
    jobs.walked(rows, "pair", "seq", {"next": "boolean"}, {"last": "long"}, lambda held, row: ({"last": row.seq}, (row.seq == (held["last"] + 1 if held else 0),)))
    batches = (pd.DataFrame({"pair": "a", "seq": np.arange(i, i + 10_000) * 7919 % n}) for i in range(0, n, 10_000))
    tracemalloc.start()
    sizes = [(len(f), int(f["next"].sum())) for f in made[0](("a",), batches, state)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k for _, k in sizes) == n and max(k for k, _ in sizes) <= 10_000 and state.value == (n - 1,)
    assert peak < 15e6, peak


def test_snapshots_of_a_key_wait_outside_memory(spark, monkeypatch):
    """The aggregate ladder and the signal log of one series with 250,000 rows in one micro-batch."""
    import tracemalloc

    class State:
        exists = False

        def update(self, value):
            self.value = value

    n, made = 250_000, []
    rows = spark.createDataFrame([], "pair string, seq long, ts timestamp, received timestamp, equity double, is_mock boolean, close double")
    monkeypatch.setattr(type(rows.groupBy("pair")), "applyInPandasWithState", lambda self, f, schema, *_: made.append(f) or spark.createDataFrame([], schema))
    jobs.live_aggregate_ladder(rows)
    jobs.live_signals(rows)

    def batches():
        for i in range(0, n, 10_000):
            k = np.arange(i, i + 10_000) * 7919 % n
            at = pd.Timestamp(MONDAY) + pd.to_timedelta(k, "s")
            yield pd.DataFrame({"pair": "a", "seq": k, "ts": at, "received": at + pd.to_timedelta(k % 90, "s"), "equity": 100.0 + k % 7, "is_mock": k % 5 == 0, "close": 100.0 + k % 7})

    for f, columns, count in zip(made, (["pair", "seq", "ts", "received", "equity", "is_mock"], ["pair", "ts", "close"]), (n, n - 22)):
        tracemalloc.start()
        sizes = [len(x) for x in f(("a",), (b[columns] for b in batches()), State())]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) == count and peak < 35e6, (sum(sizes), peak)
        assert max(sizes) <= 10_000


def test_snapshots_of_many_runs_keep_their_order_and_state(spark, monkeypatch):
    """The aggregate ladder of one series over two micro-batches of 250,000 rows out of order, row by row against running maxima."""
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    n, made, state = 250_000, [], State()
    rows = spark.createDataFrame([], "pair string, seq long, ts timestamp, received timestamp, equity double, is_mock boolean")
    monkeypatch.setattr(type(rows.groupBy("pair")), "applyInPandasWithState", lambda self, f, schema, *_: made.append(f) or spark.createDataFrame([], schema))
    jobs.live_aggregate_ladder(rows)

    seq = np.arange(2 * n)
    at = pd.Timestamp(MONDAY) + pd.to_timedelta(seq - 40 * (seq % 11 == 0), "s")
    whole = pd.DataFrame({"pair": "a", "seq": seq, "ts": at, "received": at + pd.to_timedelta(seq * 7919 % 90, "s"), "equity": 100.0 + seq * 104729 % 9973 + seq // 5000, "is_mock": seq % 5 == 0})
    got = []
    for part in (whole[:n], whole[n:]):
        frames = (part.iloc[np.arange(i, i + 10_000) * 7919 % n] for i in range(0, n, 10_000))
        got += made[0](("a",), frames, state)
    stale = whole["received"] - whole["ts"] > pd.Timedelta(60, "s")
    late = whole["ts"] < whole["ts"].where(~stale).cummax().ffill().shift()
    reason = np.where(stale, "stale", np.where(late, "out of order", None))
    peak = whole["equity"].where(~stale & ~late & ~whole["is_mock"]).cummax().ffill()
    assert max(map(len, got)) <= 10_000
    got = pd.concat([f for f in got if len(f)])
    assert got["seq"].tolist() == seq.tolist() and got["reason"].tolist() == reason.tolist() and set(reason) == {None, "stale", "out of order"}
    assert got["peak"].astype(float).fillna(-1.0).tolist() == peak.fillna(-1.0).tolist() and peak.nunique() > 30


def test_sizers_ask_for_the_raw_signal(spark):
    rows = spark.createDataFrame([("a", MONDAY + timedelta(days=i), 100.0 + i, s, 2.0, 1.0) for i, s in enumerate([0.0, 0.4, 0.9, 0.0])], "pair string, ts timestamp, close double, signal double, atr double, spread_median_pips double")
    trade = simulate.priced_trades(rows, pip=0.01, sizer=costs.target_sizer(0.01, most=1e9, least=0.0)).collect()
    assert len(trade) == 1 and trade[0]["size"] == pytest.approx(0.4 * 0.01 * 10_000)
