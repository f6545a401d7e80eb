"""The mixture reaches its targets."""

from collections import Counter

import pytest

from tidemark.llm import mixing, queries


def held_at_level(wanted, held, budget):
    """Brute force: the level at which the capped shares add up to the budget."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(h, w * mid) for w, h in zip(wanted, held)) < budget else (low, mid)
    return [min(h, w * low) for w, h in zip(wanted, held)]


def shares(spark, values):
    return {m: spark.createDataFrame(list(v.items()), f"{m} string, share double") for m, v in values.items()}


CELLS = [("a", "x", "t", 10), ("a", "y", "t", 0), ("b", "x", "t", 90), ("b", "y", "t", 100)]


@pytest.fixture(params=[mixing.DRIVER_CELLS, 0], ids=["driver", "spark"])
def place(request, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", request.param)


def test_scarce_values_hand_their_rest_on(spark, place):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    fitted, report = mixing.rake(cells, 0.5, targets=shares(spark, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"t": 1.0}}))
    assert {(r["source"], r["lang"]): r["probability"] for r in fitted.collect()} == pytest.approx({("a", "x"): 1, ("b", "x"): 50 / 90, ("b", "y"): 0.4}, abs=1e-3)
    got = {(r["margin"], r["value"]): (r["wanted"], r["target"], r["reached"]) for r in report.collect()}
    want = {("source", "a"): (0.5, 0.1, 0.1), ("source", "b"): (0.5, 0.9, 0.9), ("lang", "x"): (0.6, 0.6, 0.6), ("lang", "y"): (0.4, 0.4, 0.4), ("topic", "t"): (1, 1, 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())


def test_a_value_without_a_target_is_an_error_and_share_0_is_not_drawn(spark, place):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="without a target"):
        mixing.rake(cells, 0.5, targets=shares(spark, {"source": {"a": 1.0}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"t": 1.0}}))
    fitted, report = mixing.rake(cells, 0.5, targets=shares(spark, {"source": {"a": 0.0, "b": 1.0}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"t": 1.0}}))
    assert {r["source"] for r in fitted.collect()} == {"b"}
    assert {r["value"]: r["reached"] for r in report.collect()} == pytest.approx({"a": 0, "b": 1, "x": 0.6, "y": 0.4, "t": 1}, abs=1e-3)


def test_goals_that_cannot_be_met_together_move(spark):
    cells = spark.createDataFrame([("a", "x", "t", 50), ("b", "y", "t", 50)], "source string, lang string, topic string, tokens long")
    _, report = mixing.rake(cells, 0.5, targets=shares(spark, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}, "topic": {"t": 1.0}}))
    for r in report.collect():
        assert r["reached"] == pytest.approx(r["target"], abs=1e-3)


@pytest.mark.parametrize("cells", [mixing.BROADCAST_CELLS, 0])
def test_targets_are_reached(spark, sf_dir, monkeypatch, cells):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    rows = queries.op7_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    total, drawn = sum(r["n_tokens"] for r in rows), sum(r["n_tokens"] * r["probability"] for r in rows)
    assert drawn == pytest.approx(0.5 * total, rel=1e-3)
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["n_tokens"] == len((texts[r["doc_id"]]["text"] or "").split()) and r["source"] == texts[r["doc_id"]]["source"] for r in rows)
    assert all(0 <= r["probability"] <= 1 and r["kept"] == (r["draw"] < r["probability"]) for r in rows)
    per_cell = {}
    assert all(per_cell.setdefault((r["source"], r["lang"], r["topic"]), r["probability"]) == r["probability"] for r in rows)
    margins = queries.op7_mixing_margins(spark, sf_dir).collect()
    for m in mixing.MARGINS:
        got, held = Counter(), Counter()
        for r in rows:
            got[r[m]] += r["n_tokens"] * r["probability"] / drawn
            held[r[m]] += r["n_tokens"] / drawn
        own = {r["value"]: r for r in margins if r["margin"] == m}
        z = sum(v**0.5 for v in held.values())
        capped = held_at_level([own[v]["wanted"] for v in own], [held[v] for v in own], 1.0)
        assert [own[v]["target"] for v in own] == pytest.approx(capped, abs=0.02)
        for v, r in own.items():
            assert r["wanted"] == pytest.approx(held[v] ** 0.5 / z, rel=1e-3)
            assert r["reached"] == pytest.approx(got[v], abs=1e-5) and r["reached"] == pytest.approx(r["target"], abs=3 * mixing.TOLERANCE)
    kept = mixing.sample(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in rows if r["kept"])
