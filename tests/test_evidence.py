"""Deflated Sharpe ratios, reality checks, event studies, sized trades and live jobs on small cases."""

import math
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, evidence, gate, joint, ledger, metrics, signals, simulate, statistics as stats
from tidemark.streaming import jobs

MONDAY = datetime(2024, 1, 8)
N = NormalDist()


def test_normal_distribution(spark):
    xs = [-38.0, -8.2, -7.07, -3.0, -0.5, 0.0, 1e-9, 0.7, 2.5, 7.5, 38.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{evidence.cdf_sql('x')} as p").collect()
    assert all(r["p"] == pytest.approx(N.cdf(r["x"]), rel=1e-9, abs=1e-14) for r in got)
    ps = [1e-9, 1e-4, 0.024, 0.3, 0.5, 0.976, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").selectExpr("p", f"{evidence.quantile_sql('p')} as x").collect()
    assert all(r["x"] == pytest.approx(N.inv_cdf(r["p"]), abs=1e-7) for r in got)


def dsr(sharpe, n, skew, kurt, trials, per_year=252):
    if sharpe <= 0:
        return 0.0
    s = sharpe / math.sqrt(per_year)
    var = 1 - skew * s + (kurt + 2) / 4 * s * s
    if var <= 0:
        return 0.0
    best = 0.0 if trials == 1 else ((1 - 0.5772156649015329) * N.inv_cdf(1 - 1 / trials) + 0.5772156649015329 * N.inv_cdf(1 - 1 / (trials * math.e))) / math.sqrt(n - 1)
    return N.cdf((s - best) * math.sqrt(n - 1) / math.sqrt(var))


def test_deflated_sharpe(spark):
    cases = [(1.5, 500, 0.2, 3.0, 10), (1.5, 500, 0.2, 3.0, 1), (0.0, 500, 0.0, 0.0, 10), (-1.0, 500, 0.0, 0.0, 10), (0.767, 4186, 0.196, 8.278, 31), (40.0, 50, 3.0, -1.9, 5)]
    got = evidence.deflated_sharpe(spark.createDataFrame(cases, "sharpe double, n long, skew double, kurt double, trials int")).collect()
    for r in got:
        assert r["dsr"] == pytest.approx(dsr(r["sharpe"], r["n"], r["skew"], r["kurt"], r["trials"]), abs=1e-7)
    assert evidence.deflated_sharpe(spark.createDataFrame([(1.0, 1, 0.0, 0.0, 3)], "sharpe double, n long, skew double, kurt double, trials int")).first()["dsr"] is None
    best = evidence.expected_max_sharpe(spark.createDataFrame([(10, 101), (1, 101), (5, 1)], "trials int, n long")).collect()
    assert [r["expected_max"] for r in best] == pytest.approx([0.1 * ((1 - 0.5772156649015329) * N.inv_cdf(0.9) + 0.5772156649015329 * N.inv_cdf(1 - 1 / (10 * math.e))), 0, 0], abs=1e-8)


def test_recompute_names_what_is_missing(spark):
    trials = spark.createDataFrame([("a", "complete", 1.0, 4), ("b", "complete", None, 4), ("c", "rejected", 1.0, 4), ("d", "spawned", 1.0, 4), ("e", "complete", 1.0, 4)], "trial_id string, status string, sharpe double, trials int")
    equity = spark.createDataFrame([("a", i, 100.0 + i * i % 7) for i in range(30)] + [("e", 0, 1.0), ("e", 1, 2.0)], "trial_id string, ts long, equity double")
    got = {r["trial_id"]: r for r in evidence.recompute_deflated(trials, equity, ["complete", "rejected"]).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"a": "ok", "b": "blocked-no-sharpe", "c": "blocked-no-equity-series", "e": "compute-error"}
    e = np.array([100.0 + i * i % 7 for i in range(30)])
    x = e[1:] / e[:-1] - 1
    d = x - x.mean()
    assert got["a"]["skew"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and got["a"]["kurt"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert 0 <= got["a"]["dsr"] <= 1 and got["c"]["dsr"] is None


def slow_block_length(x):
    """The rule, lag by lag."""
    n, e = len(x), np.asarray(x) - np.mean(x)
    cov = [float(e[k:] @ e[: n - k]) / n for k in range(n)]
    if cov[0] < 1e-14:
        return 1.0
    run, limit, last = max(5, math.ceil(math.log10(n))), 1.959963984540054 * math.sqrt(math.log10(n) / n), n - 1
    for k in range(1, n - run + 1):
        if all(abs(cov[j]) / cov[0] < limit for j in range(k, k + run)):
            last = max(1, k - 1)
            break
    m = min(2 * last, math.ceil(math.sqrt(n)) + run, n - 1)
    level = curve = 0.0
    for k in range(-m, m + 1):
        u = abs(k) / m
        w = 1.0 if u < 0.5 else 2 * (1 - u)
        level, curve = level + w * cov[abs(k)], curve + w * abs(k) * cov[abs(k)]
    best = 1.0 if 2 * level**2 < 1e-28 or abs(curve) < 1e-28 else (2 * curve**2 / (2 * level**2)) ** (1 / 3) * n ** (1 / 3)
    return min(max(best, 1.0), math.ceil(min(3 * math.sqrt(n), n / 3)))


def noise(rng, n, phi):
    x = rng.normal(size=n)
    for i in range(1, n):
        x[i] += phi * x[i - 1]
    return x


def table(spark, columns):
    return spark.createDataFrame([(p, i, float(v)) for p, x in columns.items() for i, v in enumerate(x)], "pair string, ts long, ret double")


def test_block_length_follows_the_memory(spark):
    rng = np.random.default_rng(1)
    columns = {"flat": np.ones(50), "white": noise(rng, 400, 0.0), "some": noise(rng, 400, 0.5), "much": noise(rng, 400, 0.9), "two": np.array([1.0, 2.0])}
    got = {r["pair"]: r["length"] for r in stats.block_lengths(table(spark, columns)).collect()}
    assert got == pytest.approx({k: slow_block_length(v) for k, v in columns.items()}, rel=1e-9)
    assert got["flat"] == 1 and got["white"] < got["some"] < got["much"]


def test_reality_check(spark):
    rng = np.random.default_rng(2)
    weak = {f"w{i}": rng.normal(size=200) for i in range(4)}
    strong = weak | {"s": rng.normal(size=200) + 0.4}
    a = joint.reality_check(table(spark, weak), 400).first()
    b = joint.reality_check(table(spark, strong), 400, 5.0).first()
    assert b["p_consistent"] < 0.01 and b["p_plain"] < 0.01 and b["series"] == 5 and b["length"] == 5 and a["p_consistent"] > 0.05
    assert b["p_upper"] >= b["p_consistent"] and b["observations"] == 200
    x = np.column_stack([strong[k] for k in sorted(strong)])
    hac = [metrics_se(x[:, j], 4) for j in range(5)]
    assert b["t_spa"] == pytest.approx(max(math.sqrt(200) * x.mean(axis=0) / hac)) and b["t_plain"] == pytest.approx(max(math.sqrt(200) * x.mean(axis=0)))
    drawn = joint.greatest(x, range(400), 5.0, 1)  # all columns at once, draw by draw
    assert joint.greatest(x, range(1, 3), 5.0, 1) == drawn[1:3]
    for name, t, at in (("p_consistent", "t_spa", 1), ("p_lower", "t_spa", 2), ("p_upper", "t_spa", 3), ("p_plain", "t_plain", 4)):
        assert b[name] == pytest.approx((1 + sum(d[at] >= b[t] for d in drawn)) / 401)
    whole = table(spark, strong)
    for size in (1, 3_500, 1 << 30):  # a block for each series, two a block, one block
        assert joint.reality_check(whole, 400, 5.0, block_bytes=size).first() == b
    gaps = whole.where("not (pair = 'w1' and ts < 20) and not (pair = 's' and ts = 70)").union(spark.createDataFrame([("w2", 999, None)], whole.schema))
    part = joint.reality_check(gaps, 300, 5.0).first()
    assert part["observations"] == 179 and part == joint.reality_check(whole.where("ts >= 20 and ts <> 70"), 300, 5.0).first()
    for none in (whole.limit(0), whole.where("ts = 5"), whole.where("(pair = 's') = (ts > 50)")):
        assert joint.reality_check(none, 50, 5.0).count() == 0
    best = evidence.best_by_studentised_mean(table(spark, strong), 5).first()
    assert best["pair"] == "s" and best["t"] == pytest.approx(max(math.sqrt(200) * x.mean(axis=0) / hac))


def metrics_se(x, h):
    e, n = x - x.mean(), len(x)
    s = e @ e / n
    for k in range(1, h + 1):
        s += 2 * (1 - k / (h + 1)) * (e[k:] @ e[:-k]) / n
    return math.sqrt(max(s, 1e-12) / n)


def test_standard_error_floor(spark):
    got = metrics.newey_west(table(spark, {"flat": np.ones(16), "alt": np.array([1.0, -1.0] * 8)}), "ret", 3).collect()
    assert {r["pair"]: r["se"] for r in got} == pytest.approx({"flat": math.sqrt(1e-12 / 16), "alt": metrics_se(np.array([1.0, -1.0] * 8), 3)})


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.01, False, 0.5, 0.4, 0.01), (0.01, True, 0.5, 0.4, 0.01), (0.2, False, 0.5, 0.4, 0.01), (0.01, False, 0.95, 0.4, 0.01), (0.01, False, 0.8, 0.4, 0.01), (0.01, False, 0.5, 0.4, 0.06)], "p double, flips boolean, percentile double, median_sharpe double, p_consistent double")
    assert [r["verdict"] for r in evidence.combined_verdict(rows).collect()] == ["PASS", "INCONCLUSIVE", "FAIL", "FAIL", "INCONCLUSIVE", "FAIL"]
    rows = spark.createDataFrame([(True, 0.0, 0.0, 1.0), (False, 0.05, 0.9, 1.0), (False, 0.01, 0.05, 1.0), (False, 0.01, 0.01, 0.96), (False, 0.01, 0.01, 0.9), (False, 0.0378, 0.01, 1.0), (False, 0.0422, 0.01, 1.0)], "failure boolean, p_late double, p_all double, dsr double")
    assert [int(r["rule"].split("_")[1]) for r in evidence.decide(rows).collect()] == [0, 1, 2, 3, 4, 4, 4]


def test_null_p(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.5), (1.0, 0.0, 0.0), (-1.0, 0.0, 0.0)], "sharpe double, null_mean double, null_std double")
    best = (1 - 0.5772156649015329) * N.inv_cdf(0.9) + 0.5772156649015329 * N.inv_cdf(1 - 1 / (10 * math.e))
    assert [r["p_adjusted"] for r in evidence.adjusted_null_p(rows, 10).collect()] == pytest.approx([1 - N.cdf(2 - best), 0, 1], abs=1e-8)
    assert evidence.adjusted_null_p(rows, 1).first()["p_adjusted"] == pytest.approx(1 - N.cdf(2))


def test_event_returns_and_their_bootstrap(spark):
    days = [MONDAY + timedelta(days=d) for d in range(8)]
    closes = {"ref": [10, 11, 12, 11, 10, 10, 12, 13], "own": [100, 100, 100, 110, 121, 100, 100, 100], "off": [1, 2, 4, 8, 16, 32, 64, 128]}
    bars = spark.createDataFrame([(p, t, float(x), 0.01, p == "off") for p, xs in closes.items() for t, x in zip(days, xs)], "pair string, ts timestamp, close double, cost double, wide boolean")
    members = spark.createDataFrame([("b", "ref", True), ("b", "own", False), ("b", "off", False)], "bank string, pair string, reference boolean")
    asked = spark.createDataFrame([("b", days[2] - timedelta(hours=5)), ("b", days[5]), ("b", days[3]), ("b", days[7])], "bank string, ts timestamp")
    got = {r["ts"]: r for r in evidence.event_returns(asked, members, bars, "cost", "wide").collect()}
    assert set(got) == {days[2] - timedelta(hours=5), days[3]}  # no move on the reference, and no bars after
    first = got[days[2] - timedelta(hours=5)]
    assert first["direction"] == 1 and first["mean"] == pytest.approx(((10 / 12 - 1) + (121 / 100 - 1)) / 2 - 0.01) and first["y"] == first["mean"]
    assert got[days[3]]["direction"] == -1 and got[days[3]]["y"] == pytest.approx(-(((10 / 11 - 1) + (100 / 110 - 1)) / 2 - 0.01))
    rng = np.random.default_rng(3)
    for shift, low, high in ((0.5, 0, 0.01), (0.0, 0.02, 1)):
        rows = spark.createDataFrame([(b, i, float(v)) for b, n in (("x", 60), ("y", 40), ("z", 1)) for i, v in enumerate(rng.normal(size=n) + shift)], "bank string, ts long, y double")
        r = joint.blocked_bootstrap(rows, 500).first()
        assert r["events"] == 101 and low <= r["p"] <= high
        own = {b: np.array([x["y"] for x in sorted(rows.where(f"bank = '{b}'").collect(), key=lambda x: x["ts"])]) for b in "xyz"}
        lengths = {b: max(1, math.ceil(slow_block_length(v))) if len(v) > 1 else 1 for b, v in own.items()}
        width, y = max(max(lengths.values()) - 1, 1), np.concatenate(list(own.values()))
        t = lambda z: math.sqrt(len(z)) * z.mean() / metrics_se(z, min(width, len(z) - 1))
        if width >= 1:
            weight = lambda z: math.sqrt(len(z)) * z.mean() / joint.hac_errors(z[:, None], width)[0]
            drawn = [weight(np.concatenate([v[joint.draw_rows(f"1|{b}|{d}", len(v), lengths[b])] - y.mean() for b, v in own.items()])) for d in range(500)]
            assert r["t"] == pytest.approx(t(y)) and r["p"] == pytest.approx((1 + sum(v >= r["t"] for v in drawn)) / 501)
    assert joint.blocked_bootstrap(rows.limit(0), 10).count() == 0


def test_errors_of_runs_put_together():
    rng = np.random.default_rng(8)
    for width in (1, 3, 9):
        z = rng.normal(size=40) + 0.3
        for cuts in ([], [7], [1, 2, 3, 39], [4, 8, 12, 30], list(range(1, 40))):
            total = None
            for part in np.split(z, cuts):
                s = joint.summed_up(part, width)
                total = s if total is None else joint.put_together(total, s, width)
            assert joint.mean_and_error(total, width) == pytest.approx((z.mean(), joint.hac_errors(z[:, None], width)[0]))


def test_every_series_has_its_own_block_length(spark):
    rng = np.random.default_rng(9)
    columns = {"white": noise(rng, 300, 0.0), "much": noise(rng, 300, 0.8)}
    got = {r["pair"]: r for r in stats.zero_mean_test(table(spark, columns), 400).collect()}
    for k, x in columns.items():
        own = float(max(1, math.ceil(slow_block_length(x))))
        assert got[k]["length"] == own
        again = stats.zero_mean_test(table(spark, {k: x}), 400, own).first()
        assert [again[c] for c in ("p", "p5", "p10", "p20", "flips")] == [got[k][c] for c in ("p", "p5", "p10", "p20", "flips")]
    assert got["much"]["length"] > got["white"]["length"]


def test_windows_as_long_as_the_part_after_the_cutoff(spark):
    rng = np.random.default_rng(10)
    rows = spark.createDataFrame([(p, MONDAY + timedelta(days=i), float(v)) for p, n in (("a", 60), ("b", 90), ("c", 5)) for i, v in enumerate(rng.normal(size=n))], "pair string, ts timestamp, ret double")
    cutoff = (MONDAY + timedelta(days=48)).isoformat(sep=" ")
    got = {r["pair"]: r for r in metrics.placement_after(rows, cutoff).collect()}
    assert set(got) == {"a", "b"}
    for p, size in (("a", 12), ("b", 42)):
        x = np.array([r["ret"] for r in rows.where(f"pair = '{p}'").orderBy("ts").collect()])
        s = [x[i : i + size].mean() / x[i : i + size].std(ddof=1) for i in range(len(x) - size + 1)]
        r = got[p]
        assert r["size"] == size and r["windows"] == len(s) and r["last_sharpe"] == pytest.approx(s[-1]) and r["percentile"] == pytest.approx(np.mean(np.array(s) <= s[-1])) and r["median_sharpe"] == pytest.approx(np.median(s) * 252**0.5)


def test_triggers_are_named_and_must_have_their_metric(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double")
    rules = spark.createDataFrame([("one", "a", ">", 5.0, 1), ("two", "b", ">=", 2.0, 3), ("three", "b", ">", 1.0, 2)], "label string, metric string, operator string, threshold double, priority int")
    assert {r["label"]: (r["fired"], r["named"]) for r in stats.evaluate(m, rules).collect()} == {"one": (False, False), "two": (True, False), "three": (True, True)}
    with pytest.raises(ValueError, match="missing"):
        stats.evaluate(m.where("metric = 'a'"), rules)


def test_ledger_counts(spark):
    rows = [("a", 1, "complete", "h1", 1.0, None), ("b", 2, "complete", "h1", 1.0, None), ("c", 3, "complete", "h2", 1.0, None), ("d", 4, "spawned", None, None, None), ("e", 5, "odd", None, None, None), ("f", 6, "complete", "h3", 2.0, False),
            ("f", 7, "complete", "h3", 2.0, None), ("g", 8, "withdrawn-pre-freeze", "h4", 1.0, None), ("k", 9, "complete", "h9", 9.0, None), ("m", 10, "complete", "h9", 9.0, None), ("x", 11, "complete", "h5", 5.0, None)]
    table_ = spark.createDataFrame(rows, "trial_id string, seq long, status string, config_hash string, sharpe double, counts boolean")
    classified = spark.createDataFrame([("k", True), ("x", False), ("old", True)], "trial_id string, counted boolean")
    got = {r["trial_id"]: r["how"] for r in ledger.deflation_denominator(table_, classified).collect()}
    assert got == {"k": "legacy", "old": "legacy", "a": "new", "c": "new", "e": "new"}
    record = spark.createDataFrame([(2, ["k", "old"])], "ratified_n int, counted array<string>")
    assert ledger.check_classification(record) == 2
    for bad in (record.limit(0), record.union(record), record.withColumn("ratified_n", F.lit(3))):
        with pytest.raises(ValueError):
            ledger.check_classification(bad)
    hyp = spark.createDataFrame([("a", 1, "c", "carry_v2", ""), ("b", 2, "c", "carry", ""), ("d", 3, "c", "carry", "pre/x"), ("e", 4, "c", None, None)], "trial_id string, seq long, status string, strategy string, pre_reg_path string")
    assert ledger.distinct_hypotheses(hyp, ["c"], ["_v2"]).first()["hypotheses"] == 3


def test_gate_rules(spark):
    rows = spark.createDataFrame([("EURUSD", 1.0), ("GBPUSD", 1.5), ("XAUUSD", 20.0), ("USDJPY", 1.5), ("CADJPY", 100.0), ("NOK", 0.0)], "pair string, spread double")
    got = {r["pair"]: (r["wide"], r["narrow"], r["off"]) for r in gate.cross_pair_flags(rows, 10.0).collect()}
    assert got == {"EURUSD": (False, True, False), "GBPUSD": (False, True, False), "XAUUSD": (True, False, False), "USDJPY": (False, False, False), "CADJPY": (False, False, True)}


def test_families_and_reversal(spark):
    hours = [MONDAY + timedelta(hours=h) for h in range(48)]
    rows = [("a", t, 10.0, 10.0 + (3 if h == 30 else 1), 9.0, 10.0 + (1 if h % 3 else -1 if h % 2 else 0), 1.0 + h % 2) for h, t in enumerate(hours)]
    bars = spark.createDataFrame(rows, "pair string, ts timestamp, open double, high double, low double, close double, spread_median_pips double")
    got = {}
    for r in signals.intraday_families(bars).collect():
        got.setdefault(r["family"], {})[r["ts"]] = r["signal"]
    close = [x[5] for x in rows]
    last = 0.0
    for h, t in enumerate(hours):
        move = float(np.sign(close[h] - 10))
        last = -move if move else last
        assert got["hourly_reversal"][t] == last
        assert got["session_open_momentum"][t] == (move if t.hour == 7 else 0)
        assert got["vol_breakout"][t] == (move if 24 <= h <= 30 else 0)  # the wide bar at 30 raises the bar after it
        assert got["spread_filtered_reversal"][t] == (last if h % 2 == 0 else 0)
        gap = float(np.sign(10 - close[h - h % 24 + 7])) if h % 24 >= 8 else 0.0
        assert got["london_drift"][t] == (gap if 8 <= t.hour <= 11 else 0)
        assert got["momentum_3"][t] == (float(np.sign(round(math.log(close[h] / close[h - 3]), 12))) if h >= 3 else 0)


SIZED = {
    "default": (costs.atr_sizer(), lambda e, p, atr, s: e * 0.01 / (atr * 2) if atr else e * 0.01 / (p * 0.02)),
    "fraction": (costs.fraction_sizer(), lambda e, p, atr, s: min(e * 0.01 * abs(s) / (atr * 2), e * 0.1 / p) if atr and e > 0 else 0),
    "continuous": (costs.continuous_sizer(confidence=0.9, ratchet=1.5, most=20, least=12), lambda e, p, atr, s: (lambda u: u if u >= 12 else 0)(min(e * 0.01 / (atr * 2) * abs(s) * 1.35, 20)) if atr and e > 0 else 0),
    "target": (costs.target_sizer(0.005, most=40, least=30), lambda e, p, atr, s: (lambda u: u if u >= 30 else 0)(min(min(s, 1) * 0.005 * e, 40)) if s > 0 and e > 0 else 0),
}


@pytest.mark.parametrize("name", SIZED)
@pytest.mark.parametrize("fold", [1, 2, 256])
def test_equity_trade_by_trade(spark, monkeypatch, name, fold):
    monkeypatch.setattr(simulate, "FOLD", fold)
    close, sig = [100.0, 101.0, 103.0, 102.0, 99.0, 98.0, 97.0, 100.0, 104.0, 101.0, 107.0], [0.0, 1.0, 1.0, -1.0, -0.7, 0.0, 0.5, 0.5, -0.5, 1.0, 1.0]
    atr = [2.0, 2.0, None, 3.0, 2.0, 2.0, 4.0, 4.0, 4.0, 3.0, 2.0]
    rows = spark.createDataFrame([("a", MONDAY + timedelta(days=i), c, s, a, 1.0) for i, (c, s, a) in enumerate(zip(close, sig, atr))], "pair string, ts timestamp, close double, signal double, atr double, spread_median_pips double")
    sizer, plain = SIZED[name]
    trades = simulate.priced_trades(rows, pip=0.01, slippage=0.25, commission=0.5, swap_long=-0.5, swap_short=0.25, sizer=sizer)
    got = {r["ts"]: r["equity"] for r in simulate.discrete_equity(rows, trades, 0.01).collect()}
    equity, held, want, sizes = 10_000.0, None, [], []
    last = len(close) - 1

    def closed(c, i):
        side, price, size, day = held
        pips = (c - price) * side / 0.01 - (0.5 + 0.25 + 0.5) - (0.5 if side > 0 else -0.25) * (i - day)
        return equity + pips * 0.01 * size

    for i, c in enumerate(close):
        pos = sig[i - 1] if i else 0.0
        if held and np.sign(pos) != held[0]:
            equity, held = closed(c, i), None
        if not held and pos:
            sizes.append(plain(equity, c, atr[i], pos))
            equity -= 0.75 * 0.01 * sizes[-1]
            held = (np.sign(pos), c, sizes[-1], i)
        want.append(closed(c, i) if held and i == last else equity + ((c - held[1]) * held[0] * held[2] if held else 0))
    assert [got[MONDAY + timedelta(days=i)] for i in range(len(close))] == pytest.approx(want)
    assert [r["size"] for r in trades.orderBy("entry_time").collect()] == pytest.approx(sizes) and len(set(sizes)) > 1


def test_a_trade_without_an_atr_has_the_default_size(spark):
    rows = spark.createDataFrame([("a", MONDAY + timedelta(days=i), 100.0 + i, 1.0, None, 1.0) for i in range(4)], "pair string, ts timestamp, close double, signal double, atr double, spread_median_pips double")
    trade = simulate.priced_trades(rows, pip=0.01, slippage=0.0).first()
    assert trade["size"] == pytest.approx(10_000 * 0.01 / (101 * 0.02)) and trade["pnl_dollars"] == pytest.approx((2 - 0.005) * trade["size"])
    assert simulate.priced_trades(rows, sizer=costs.fraction_sizer()).first()["size"] == 0


def test_volatility_regression(spark):
    rng = np.random.default_rng(5)
    x1, x2 = rng.integers(0, 20, 80).astype(float), rng.normal(size=80)
    y = 0.3 * x1 + rng.normal(size=80)
    rows = spark.createDataFrame([("a", *map(float, v)) for v in zip(y, x1, x2)] + [("b", 1.0, 1.0, 1.0)], "pair string, gross double, relvol double, relrng double")
    got = {r["pair"]: r for r in metrics.volatility_control(rows).collect()}
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    a = np.column_stack([np.ones(80), rank(x1), rank(x2)])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    rest = ((y - a @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rest / 77)
    r = got["a"]
    assert (r["b1"], r["t1"], r["b2"], r["t2"]) == pytest.approx((beta[1], beta[1] / se[1], beta[2], beta[2] / se[2]))
    assert r["r2"] == pytest.approx(1 - rest / ((y - y.mean()) ** 2).sum()) and r["passes"] and got["b"]["b1"] is None and not got["b"]["passes"]


def test_aggregate_ladder(spark):
    rows = [(1, 0, 1, 100.0, False), (2, 1, 2, 97.0, False), (3, 3, 4, 95.0, False), (4, 2, 5, 50.0, False), (5, 4, 100, 50.0, False), (6, 5, 6, 91.0, False), (7, 6, 7, 999.0, True), (8, 7, 8, 87.0, False), (9, 8, 9, 85.0, False)]
    at = lambda s: MONDAY + timedelta(seconds=s)
    snaps = spark.createDataFrame([("p", q, at(t), at(got), e, m) for q, t, got, e, m in rows], "pair string, seq long, ts timestamp, received timestamp, equity double, is_mock boolean")
    got = {r["seq"]: (r["reason"], r["level"], r["size"], r["dispatch"], r["flat"]) for r in jobs.aggregate_ladder(snaps).collect()}
    assert got[4][:2] == ("out of order", None) and got[5][:2] == ("stale", None)
    assert [got[i][1:] for i in (1, 2, 3, 6, 8, 9)] == [(0, 1, True, False), (0, 1, True, False), (1, 1, True, False), (2, 0.5, True, False), (3, 0, False, False), (4, 0, False, True)]


def test_live_signals_are_those_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    bars = spark.createDataFrame([(p, MONDAY + timedelta(hours=h), float(v)) for p in "ab" for h, v in enumerate(100 + rng.normal(size=40))], "pair string, ts timestamp, close double")
    for i, (a, b) in enumerate([(0, 15), (15, 16), (16, 40)]):  # three arrivals, the last with a repeat
        part = bars.where((F.col("ts") >= F.lit(MONDAY + timedelta(hours=a - (i == 2)))) & (F.col("ts") < F.lit(MONDAY + timedelta(hours=b))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.live_signals(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in")), 5)
        jobs.run_to_end(stream, str(tmp_path / "job"))
    got = spark.read.parquet(str(tmp_path / "job" / "out")).collect()
    want = jobs.signal_log(bars, 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 2 * (40 - 1 - 6)


def test_walk_forward_against_a_benchmark(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=120) + 0.2, rng.normal(size=120)
    r = stats.against_benchmark(table(spark, {"p": a}), table(spark, {"p": b}), 10, 30, 20).first()
    starts = [10 + 20 * w for w in range(5) if 10 + 20 * w + 30 <= 120]
    s = lambda x: x.mean() / x.std(ddof=1) * 252**0.5
    delta = [s(a[i : i + 30]) - s(b[i : i + 30]) for i in starts]
    assert r["windows"] == len(starts) and r["wins"] == np.mean(np.array(delta) > 0) and r["mean_delta"] == pytest.approx(np.mean(delta))
