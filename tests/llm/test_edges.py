"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import hashlib

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import decontaminate, fingerprints, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity, url_filter, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score double, component int, tid string, signal double, m int"
LONG = " ".join(f"word{i % 977} tale{i % 1009}" for i in range(30_000))
ROWS = [
    (1, "plain words that say nothing in particular at all", "en", "a"), (1, "plain words that say nothing in particular at all", "en", "a"),
    (2, None, None, None), (2, None, None, None), (None, "no key here but a text of some words", "en", "b"), (None, None, None, None), (3, "", "de", "a"), (4, "", "de", None),
    (5, "!!! ???", "fr", "b"), (6, "one", "fr", "b"), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "a"), (9, "Éa ﬁ  Ａ\u0000b\tc", "es", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "k", 1, 0.5, 2, "t", 0.0, 3) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def op_rows(name, docs, labels):
    bench = docs.sparkSession.createDataFrame([(1, "that say nothing in particular"), (2, None), (3, " .. "), (4, " ".join(LONG.split(" ")[100:140]))], "item_id long, text string")
    seen = lambda k: F.lit(True)
    if name == "tokens":
        import public_tokenizers

        return wavelet.token_report(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return {
        "quality": lambda: quality.score_quality(docs, quality.train(docs, labels, seen), F.col("doc_id") == 1),
        "toxicity": lambda: toxicity.toxicity_report(docs, toxicity.train(docs, labels, seen), F.col("doc_id") == 1),
        "near": lambda: near_dedup.near_duplicates(docs),
        "suffix": lambda: suffix_dedup.remove_repeats(docs),
        "mixing": lambda: mixing.mix(docs),
        "prints": lambda: fingerprints.fingerprint_report(docs),
        "shards": lambda: sharding.shard_records(docs, [1.0, 2.0, 0.5]),
        "bench": lambda: decontaminate.decontaminate(docs, bench),
    }[name]()


NAMES = ["tokens", "quality", "toxicity", "near", "suffix", "mixing", "prints", "shards", "bench"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_is_answered(name, docs, empty, labels):
    got = op_rows(name, docs, labels).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert op_rows(name, empty, labels).count() == 0
    if name == "near":
        classes = {(r["doc_id"], r["class_id"]) for r in got}
        assert {(7, 7), (8, 7), (3, 3), (4, 3), (5, 5), (6, 6), (2, 2), (None, None)} <= classes
    if name == "suffix":
        by = {r["doc_id"]: r for r in got}
        assert by[3]["kept_sha256"] == by[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
        assert by[7]["n_removed"] == len(LONG) and by[1]["n_removed"] == 0
    if name == "bench":
        by = {r["doc_id"]: r for r in got}
        assert (by[1]["n_hit"], by[1]["n_items"], by[1]["contaminated"]) == (5, 1, True)
        assert by[7]["n_items"] == 1 and not by[7]["contaminated"] and by[2]["n_words"] == 0
    if name == "tokens":
        assert sorted(r["start"] for r in got)[0] == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://NET"), (5, "http://a.net/x"), (5, "http://a.net/x"), (None, "x://b.example.net/en/1?q"), (6, "http://notnet/x"), (7, "http:///p#f")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    got = url_filter.url_filter(pages, url_filter.rules_table(spark, url_filter.RULES))
    found = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect())
    assert len(found) == len(rows)
    assert ("4", "net", "", None, "allow") in found and found.count(("5", "a.net", "/x", "net/", "block")) == 2
    assert ("None", "b.example.net", "/en/1", "example.net/en/", "allow") in found and ("6", "notnet", "/x", None, "allow") in found
    none = url_filter.url_filter(pages, url_filter.rules_table(spark, url_filter.RULES).limit(0))
    assert none.where("rule is null and verdict = 'allow'").count() == len(rows)
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_table(spark, url_filter.RULES)).count() == 0


def test_keep_one_keeps_one(docs, empty):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 2, None, None, 3, 5, 6, 7, 9]))
    assert near_dedup.keep_one(empty).count() == 0


def test_insults_are_scored_in_clauses():
    import pyarrow as pa

    lexicon = toxicity.Lexicon({})
    texts = ["you are such an idiot.", "he said nobody is an idiot.", "an idiot.", "i will kill the lights.", "i will kill you.", ""]
    x = toxicity.clause_features(pa.array(texts), lexicon)[:, 0]
    assert x[0] > x[2] > x[1] > 0 and x[3] == 0 and x[4] > 0 and x[5] == 0
    same = [
        ("you are not an idiot", "you aren't an idiot"), ("you are not an idiot", "you aren’t an idiot"), ("he is no idiot", "il n'est idiot"), ("they are idiot", "they are idiots"),
        ("not an idiot, such", "isn't an idiot, such"),
    ]
    for a, b in same:
        x, y = toxicity.clause_features(toxicity._lower(pa.array([a, b])), lexicon)[:, 0]
        assert x == y > 0, (a, b)
    plain, negated = toxicity.clause_features(pa.array(["an idiot, you", "not an idiot, you"]), lexicon)[:, 0]
    assert plain == 1.5 and negated == 0.75


CLASSES = dict(idiot=1, scum=1, kill=2, burn=2, you=3, they=3, **{"not": 4, "said": 5, "very": 6})


def walked(clause):
    """The grammar, word by word from its rules."""
    kinds = [CLASSES.get(w, 0) for w in clause]
    total, last, used = 0.0, None, None
    for i, k in enumerate(kinds):
        if k in (1, 2):
            factor = 1.0
            for kind, f, span in ((4, 0.5, 3), (5, 0.6, 6), (3, 1.3, 5), (6, 1.2, 2)):
                factor *= f if kind in kinds[max(i - span, 0) : i] else 1.0
            if k == 1 or 3 in kinds:
                total += factor
                used = factor
            last = i
        elif k == 3 and last is not None and i - last <= 4:
            total += 0.5 * (1.0 if used is None else used)
            last = None
    return total


def test_grammar_against_its_rules():
    import random

    import pyarrow as pa

    rnd, lexicon = random.Random(3), toxicity.Lexicon({})
    texts = [[[rnd.choice([*CLASSES, "a", "tree", "of"]) for _ in range(rnd.randrange(12))] for _ in range(rnd.randrange(4))] for _ in range(400)]
    x = toxicity.clause_features(pa.array([". ".join(" ".join(c) for c in t) for t in texts]), lexicon)
    for t, got in zip(texts, x):
        scores = [walked(c) for c in t if any(CLASSES.get(w, 0) in (1, 2) for w in c)]
        assert got[0] == pytest.approx(sum(scores)) and got[1] == pytest.approx(max(scores, default=0))
        assert got[2] == sum(s > 0 for s in scores) and got[4] == sum(bool(c) for c in t)


def test_listed_classes_stay():
    h = toxicity._hash_of
    lexicon = toxicity.Lexicon({h("not"): 5.0, h("idiot"): 0.2, h("zorp"): 3.0})
    found = dict(zip(lexicon.hashes.tolist(), zip(lexicon.kinds.tolist(), lexicon.weights.tolist())))
    assert found[h("not")][0] == toxicity.NEGATION and found[h("idiot")] == (toxicity.INSULT, 1.0) and found[h("zorp")] == (toxicity.INSULT, 3.0)


def test_factorisation_machine_is_the_pair_sum():
    import numpy as np

    rng = np.random.default_rng(4)
    d, stats = quality.BUCKETS + 3, rng.normal(size=(5, 3))
    model = quality.FactorisationMachine(np.zeros(3), np.ones(3), 0.3, rng.normal(size=d), rng.normal(size=(d, 4)))
    bucket, row = np.array([3, 9, 700, 5, 3]), np.array([0, 0, 0, 2, 4])
    got = model.raw(stats, bucket, row)
    for i in range(5):
        own = bucket[row == i]
        x = dict.fromkeys([*own, *range(quality.BUCKETS, d)], 0.0)
        x.update({b: 1 / np.sqrt(len(own)) for b in own} | {quality.BUCKETS + j: stats[i, j] for j in range(3)})
        pairs = sum(x[a] * x[b] * (model.v[a] @ model.v[b]) for a in x for b in x if a < b)
        assert got[i] == pytest.approx(0.3 + sum(model.w[a] * v for a, v in x.items()) + pairs)


def test_labels_of_any_key_and_clashing_labels(spark):
    docs = spark.createDataFrame([(f"k{i}", f"text {i % 2} " * (i % 2 * 20 + 5), 7) for i in range(60)], "doc_id string, text string, n_chars long")
    labels = spark.createDataFrame([(f"k{i}", i % 2, i % 2) for i in range(60)] + [("k1", 0, 0), ("k2", 1, 1), (None, 1, 1)], "doc_id string, quality int, toxic int")
    seen = lambda k: F.lit(True)
    sample = {r["text"][:6] for r in quality.labelled_sample(docs, labels, "quality", seen, 99, meta=("n_chars",)).collect()}
    assert sample == {"text 0", "text 1"} and quality.labelled_sample(docs, labels, "quality", seen, 99).count() == 58
    model = quality.train(docs, labels, seen, meta=("n_chars",))
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model, F.lit(False), meta=("n_chars",)).collect()}
    assert scored["k3"] > 0.5 > scored["k4"]
    assert toxicity.toxicity_report(docs, toxicity.train(docs, labels, seen), F.lit(False)).count() == 60


def test_long_words_are_told_apart():
    import pyarrow as pa

    from tidemark.llm import shared

    long = ["x" * 70_000 + "ab", "x" * 70_000 + "ba", "x" * 200_000 + "ab", "x" * 70_000 + "ab"]
    for hashes in (shared.word_hashes(*shared.text_bytes(pa.array(long)))[0], toxicity.word_forms(pa.array(long))[3][0]):
        assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[3]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, and columns named as the code names its own."""
    names = "tid string, row string, topic long, draw string, probability string, salt string, n_words long, contaminated string, score string, predicted string, c0 long, `__tid` string, k string, t long"
    rows = [(*r[:4], i % 3 if i % 3 else None, *["own"] * 2, 5, *["own"] * 3, 6, *["own"] * 3, 7, "own", "own", 8) for i, r in enumerate([*ROWS, *ROWS[:4]])]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").cache()


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_input(spark, sf_dir, odd, at):
    from collections import Counter

    name, stage = corpus_pipeline.STAGES[at]
    got = stage(spark, odd, sf_dir)
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    if name == "sharding":
        rows = got.collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
        return
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    before, after = Counter(bag(odd)), Counter(bag(got))
    assert not after - before
    if name in ("toxicity", "decontamination"):
        assert after == before
    if name == "near_dedup":
        assert all(n == 1 for r, n in after.items() if "text=None" not in r)
        assert {r for r in before if "text=None" in r} == {r for r in after if "text=None" in r}
    if name == "mixing":
        assert all(before[r] == n for r, n in after.items())


@pytest.mark.parametrize("limits", [{}, {"hashes": 0, "texts": 0, "window_bytes": 0}])
def test_decontamination_by_broadcast_and_by_shuffle(spark, limits):
    from tests.llm.test_operators import contaminated

    item = " ".join(f"w{i}" for i in range(40))
    texts = [f"before it {item} and after"] * 60 + [" ".join(f"w{i}" for i in range(5, 18)) + " x" * n for n in (0, 200, 300)] + ["w1 w2 w3", None, "", "a a a a a a a a a a a a a a a a a"]
    docs = spark.createDataFrame([(i, t, "own", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, tid string, hash double").repartition(3)
    items = [(1, item), (2, "w1 w2 w3"), (3, " ".join(["a"] * 15)), (4, None), (5, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    judged = decontaminate.decontaminate(docs, bench, **limits)
    assert judged.columns[:4] == docs.columns and judged.count() == len(texts)
    for r in judged.collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == contaminated(r["text"], [(i, t or "") for i, t in items]), r["doc_id"]
    clean = decontaminate.keep_clean(docs, bench, **limits)
    assert bag(clean) == bag(judged.where("not contaminated").select(docs.columns))
    assert decontaminate.keep_clean(docs, bench.limit(0), **limits).count() == len(texts)


def removed_of(bodies, length=200):
    from collections import Counter

    import numpy as np

    seen, out = Counter(), []
    for b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd, hot", [(suffix_dedup.CROWD, suffix_dedup.HOT), (2, 5000), (2, 3), (40, 20)])
def test_one_passage_in_many_texts(spark, monkeypatch, crowd, hot):
    """A passage with different surroundings, which makes as many different stretches around its outer anchors as there are texts."""
    import random

    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, other = word(420), word(230)
    texts = [word(rnd.randrange(300)) + passage[rnd.choice([0, 0, 30]) :] + word(rnd.randrange(300)) for _ in range(60)]
    texts += [word(50) + other + word(40), word(9) + other, word(500), "", None, texts[0], "z" * 900, "y" * 199 + "z" * 210]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == removed_of([(t or "").encode() for t in texts])


def test_share_is_exact(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(13)) + " x" * n) for n in (27, 30, 31)], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(docs, bench, share=0.3).collect()}
    assert got == {27: True, 30: True, 31: False}  # 13 of 40, of 43 and of 44 words


@pytest.mark.parametrize("size", [60, 2000, 16 << 20])
def test_next_documents_over_many_ranges(spark, size):
    texts = [None, "", "abc def", "Ab  C d", *(f"text {i} " + "x" * (i % 37) for i in range(40))]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i * 31 % 1009, texts[i * 7 % len(texts)], 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long").repartition(3)
    hashes = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("h", F.xxhash64("t")).collect()}
    order = sorted(((k is not None, k or 0, hashes[t or ""], t or "") for k, t, _ in rows), reverse=True)
    want = []
    for i, (has, k, _, t) in enumerate(order):
        following, half = order[(i + 1) % len(order)][3], len(t) // 2
        want.append((k if has else None, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    got = fingerprints.fingerprint_report(docs, size=size).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [url_filter.BROADCAST_RULES, 0])
def test_rules_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    pages = spark.createDataFrame([(1, "x://a.net/"), (2, "x://net/p"), (3, "x://b.org/")], "page_id long, url string")
    rules = url_filter.rules_table(spark, [("net", "/", "block"), ("net", "/", "allow"), ("net", "/", "block"), ("a.net", "/", "block")])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {1: ("a.net/", "block"), 2: ("net/", "allow"), 3: (None, "allow")}


def test_weighted_shards_and_growth(spark):
    weights, n = [1.0, 2.0, 0.0, 3.0], 6000
    docs = spark.range(n).selectExpr("id as doc_id", "'t' as text")
    rows = sharding.shard_records(docs, weights).collect()
    load = [sum(r["shard"] == s for r in rows) / n for s in range(4)]
    assert load == pytest.approx([1 / 6, 2 / 6, 0, 3 / 6], abs=0.02)
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {4} and len(moved) / n == pytest.approx(1.5 / 7.5, abs=0.02)
    # the winner of every shard's score, from Spark's hash alone
    scores = docs.select("doc_id", *[F.xxhash64("doc_id", F.lit(0), F.lit(s)).alias(f"h{s}") for s in range(4)]).collect()
    import math

    best = {r["doc_id"]: max(range(4), key=lambda s: (-weights[s] / math.log((((r[f"h{s}"] & (1 << 64) - 1) >> 11) + 0.5) * 2.0**-53), -s)) for r in scores}
    assert {r["doc_id"]: r["shard"] for r in rows} == best


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir).cache()
        assert 0 < rows.count() <= n
        n = rows.count()
        if name != "sharding":
            assert rows.columns == docs.columns
    assert n > 0.2 * docs.count()
