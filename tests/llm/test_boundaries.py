"""Results that may not hang on a batch, a size or a name; the canonical form re-derived."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, shared, suffix_dedup, toxicity


def test_contractions_end_at_the_text():
    lexicon = toxicity.Lexicon({})
    texts = ["t you idiot", "n", "don't", "isn't you idiot", "'t you idiot", "n' you idiot", "doesn", "'", "t"]
    alone = np.vstack([toxicity.clause_features(pa.array([t]), lexicon) for t in texts])
    for shift in range(len(texts)):
        order = texts[shift:] + texts[:shift]
        together = toxicity.clause_features(pa.array(order), lexicon)
        assert (together == np.vstack([alone[shift:], alone[:shift]])).all()
    assert (alone[0] != alone[3]).any()  # a contraction does weigh where there is one


@pytest.mark.parametrize("limits", [{}, {"texts": 0}, {"hashes": 0, "texts": 0, "window_bytes": 0}])
def test_any_name_and_any_type_beside_the_text(spark, limits):
    rows = [(i, " ".join(f"w{(i + j) % 40}" for j in range(30))) for i in range(6)] + [(9, None), (10, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "x y": F.lit("z"), "m": F.create_map(F.lit("k"), F.lit(2))})
    bench = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(3, 20))), (2, "nothing here"), (3, "w1 w2 w3")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, **limits)
    assert got.columns[:5] == ["doc_id", "text", "a.b", "x y", "m"]
    hits = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()}
    want = {}
    for k, text in rows:
        words, hit, items = (text or "").split(), set(), 0
        for item in ([f"w{j}" for j in range(3, 20)], ["nothing", "here"], ["w1", "w2", "w3"]):
            n, found = min(13, len(item)), set()
            windows = {tuple(item[s : s + n]) for s in range(len(item) - n + 1)}
            for s in range(len(words) - n + 1):
                if tuple(words[s : s + n]) in windows:
                    found |= set(range(s, s + n))
            hit, items = hit | found, items + bool(found)
        want[k] = (len(hit), items, bool(hit) and 20 * len(hit) >= len(words))
    assert hits == want
    clean = decontaminate.keep_clean(docs, bench, **limits)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {k for k, v in want.items() if not v[2]}


def plain_canonical(text):
    out = unicodedata.normalize("NFKC", text or "")
    for _ in range(2):
        out = unicodedata.normalize("NFKC", out.casefold())
    return re.sub(r"\s+", " ", re.sub("[\x1c-\x1f]", "\x1f", out)).strip(" ") if not re.search("[\x1c-\x1f]", out) else None


CANON = [
    "ΐ", "Ϊ́", "ΐ", "Straße", "STRASSE", "ﬁne  Ａ", "fine a", " x　 y ", "X Y", "İ", "i̇", "ẞ", "ǰ", "J̌", "ﬃ", "FFI", "ΑΣ", "ας", "ας ", "", None, "  ", "é", "é", "É",
    "ᾀ", "ᾈ", "ᾀ", "ͅ", "ı", "I", "K", "K", "Å", "Å", "ﬆ", "ſt", "½", "1⁄2", "①", "1",
]


def test_canonical_form_against_another_derivation(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(CANON)], "i int, t string").select("i", "t", fingerprints.canonical(F.col("t")).alias("c"), fingerprints.digest(fingerprints.canonical(F.col("t"))).alias("d")).collect()
    want = [plain_canonical(t) for t in CANON]
    assert [r["c"] for r in got] == want
    by_text, by_digest = {}, {}
    for r, w in zip(got, want):
        by_text.setdefault(w, set()).add(r["i"])
        by_digest.setdefault(r["d"], set()).add(r["i"])
    assert sorted(map(sorted, by_text.values())) == sorted(map(sorted, by_digest.values()))
    assert got[0]["d"] == got[1]["d"] == got[2]["d"] and got[3]["d"] == got[4]["d"]


def test_canonical_form_is_closed(spark):
    """Of every letter and mark, alone and with an accent: canonical form of the canonical form, and of what folding and composing make of the text."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = [chr(c) for c in range(0x41, 0x2fff) if unicodedata.category(chr(c))[0] in "LM"]
    texts = letters + [c + m for c in letters[::7] for m in marks[::9]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.canonical(F.col("t")).alias("c"))
    once = rows.select("t", "c", fingerprints.canonical(F.col("c")).alias("again")).collect()
    assert all(r["c"] == r["again"] for r in once)
    known = [r for r in once if unicodedata.category(r["t"][0]) != "Cn"]
    assert sum(r["c"] != plain_canonical(r["t"]) for r in known) == 0


def test_next_rows_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 23 if i % 11 else None, f"text {i % 7} " * (i % 5) if i % 13 else None) for i in range(120)], "doc_id long, text string").repartition(3)
    want = Counter(map(tuple, fingerprints.fingerprint_report(docs, size=200).collect()))
    monkeypatch.setattr(fingerprints, "BROADCAST_RANGES", 0)
    assert Counter(map(tuple, fingerprints.fingerprint_report(docs, size=200).collect())) == want


def test_suffix_dedup_without_its_broadcasts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    shared = ["".join(rng.choice(list("abcdef "), 260)) for _ in range(5)]
    docs = spark.createDataFrame([(i, "".join(rng.choice(list("xyz"), 50)) + shared[i % 5 if i < 40 else 0] + str(i)) for i in range(80)], "doc_id long, text string").repartition(4)
    want = Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    assert sum(r[2] for r in want) > 80 * 200
    monkeypatch.setattr(suffix_dedup, "BROADCAST_TEXTS", 0)
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want


def test_structured_words_have_hashes_of_their_own():
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [w for n in (512, 1024, 4096) for w in (thue[:n], thue[:n].translate(str.maketrans("ab", "ba")))] + ["ab", "ba", "a", "b", "aa"]
    hashes, counts = shared.word_hashes(*shared.text_bytes(pa.array([" ".join(words), "AB - ba"])))
    assert counts.tolist() == [len(words), 2] and len(set(hashes[: len(words)].tolist())) == len(words)
    assert hashes[len(words) :].tolist() == hashes[6:8].tolist()


@pytest.mark.parametrize("base", [suffix_dedup._P, suffix_dedup._Q])
@pytest.mark.parametrize("shortest", [8, 200])
def test_structured_ranges_have_hashes_of_their_own(base, shortest):
    thue = np.zeros(1, np.uint8)
    while len(thue) < 16384:
        thue = np.concatenate([thue, 1 - thue])
    data = np.concatenate([thue + 97, 98 - thue, np.zeros(64, np.uint8)]).astype(np.uint8)
    ranges = suffix_dedup.RangeHash(data, shortest, base)
    for n in (256, 512, 1024, 4096, 16384):
        one, two, again = ranges.of(np.array([0, 16384, 16384 - n if n < 16384 else 0]), np.array([n, 16384 + n, 16384 if n < 16384 else n])).tolist()
        assert one != two
        tail = (thue[16384 - n :] == thue[:n]).all() if n < 16384 else True
        assert (again == one) == tail
    zeros = ranges.of(np.full(50, 32768), 32768 + np.arange(8, 58))
    assert len(set(zeros.tolist())) == 50


@pytest.mark.parametrize("length, k", [(1500, 32), (1200, 5), (40, 1), (32, 32)])
def test_other_window_lengths(spark, length, k):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(2 * length)
    texts = [word(70) + passage[: length + 30] + word(90), passage + word(20), passage[25:] + "q", "z" * (length + 3), word(length), None, ""] + ["z" * (length - 1)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length, k=k).collect()
    bodies, seen = [(t or "").encode() for t in texts], Counter()
    for b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for doc_id, n_bytes, n_removed, *_ in got:
        gone = np.zeros(n_bytes, bool)
        for i in range(n_bytes - length + 1):
            if seen[bodies[doc_id][i : i + length]] > 1:
                gone[i : i + length] = True
        assert (len(bodies[doc_id]), gone.sum()) == (n_bytes, n_removed)
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(spark.createDataFrame([], "text string"), length=k - 1, k=k)
