"""Whitening, hard negatives and archives against brute force, and on odd input."""

import base64
import gzip
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, queries, warc, whitening
from tidemark.llm.shared import scratch_folder

NAN, INF = math.nan, math.inf
SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, deviation double, component int, is_anchor int, block string"
EXTRA = ("text " * 30_000, "k", 0.5, 2, 1, "b")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def odd(rng, n=90, width=5):
    rows = [(i, [float(v) for v in rng.integers(-40, 40, width) / 64], int(rng.integers(0, 3))) for i in range(n)]
    rows += rows[:7] + [(200 + i, rows[i][1], rows[i][2]) for i in range(9)]  # repeated rows, and ties
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0], 1), (302, [NAN, 0.0, 0.0, 0.0, 0.0], 1), (303, [INF, 0.0, 0.0, 0.0, 0.0], 1), (304, [1.0], 1), (305, [], 1)]
    return rows + [(None, [0.25] * width, 1), (306, [0.125] * width, None), (None, None, None)]


# ---- whitening -----------------------------------------------------------------------------------------------------------


def whole(rows, width):
    return [(k, np.array([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v], object)) for k, v, _ in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]


def held_against(got, rows, width, most=16):
    kept = whole(rows, width)
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    a = np.array([[float(n * v - s) / n for v, s in zip(x, sums)] for x in distinct])
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == len(kept) * k and {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    by_key = defaultdict(list)
    for key, x in kept:
        by_key[key].append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([float(n * c - s) / n for c, s in zip(x, sums)]) @ v[:, :k] / np.sqrt(e[:k])))
    signs = None
    for key in by_key:
        own = sorted((r["component"], r["deviation"], r["whitened"], r["explained"]) for r in got if r["vec_id"] == key)
        assert len(own) == k * len(by_key[key])
        assert sorted({r[1] for r in own}) == sorted({d for d, _ in by_key[key]})
        assert np.allclose([r[3] for r in own], np.repeat(e[:k] / e.sum(), len(by_key[key])), rtol=1e-9)
        for deviation, want in by_key[key][:1]:
            if len(by_key[key]) == 1:
                have = np.array([r[2] for r in own])
                signs = np.sign(have * want) if signs is None else signs
                assert np.allclose(have * signs, want, atol=1e-7)


def test_whitening_of_odd_rows(spark):
    rows = odd(np.random.default_rng(3))
    held_against(whitening.whiten(vectors(spark, rows), "vec_id", "embedding").collect(), rows, 5)


def test_dependent_dimensions_and_few_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-60, 60, (50, 3))
    rows = [(i, [float(c) / 64 for c in (*b, b[0], b[1] + b[2], 7)], 0) for i, b in enumerate(base)]  # three of six dimensions follow from others
    held_against(whitening.whiten(vectors(spark, rows), "vec_id", "embedding").collect(), rows, 6)
    held_against(whitening.whiten(vectors(spark, rows[:3]), "vec_id", "embedding").collect(), rows[:3], 6)


def test_badly_conditioned_rows_need_more_than_one_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 4)) * [1e9, 1e5, 10, 10]
    df = spark.createDataFrame([(np.round(r).astype(np.int64).tolist(),) for r in x], "x array<long>")
    model = whitening.fit(df, 4)
    a = np.round(x) - np.round(x).mean(0)
    assert model.passes > 2 and model.identity_error < 1e-10
    assert np.allclose(model.eigenvalues, np.linalg.svd(a, compute_uv=False) ** 2 / 400, rtol=1e-10)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], [(1, None, 1)]):
        assert whitening.whiten(vectors(spark, rows), "vec_id", "embedding").collect() == []


def test_whitening_query(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    held_against(queries.op11_whitening(spark, sf_dir).collect(), [(r["vec_id"], r["embedding"], 0) for r in t], 64)


def test_deviations_beyond_64_bits_are_an_error():
    model = whitening.Whitening(1 << 30, 2, np.zeros(2, np.int64), [0, 0], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[1, 1]])).tolist() == [2 << 60]
    with pytest.raises(ValueError):
        model.deviations(np.array([[1 << 10, 0]]))


# ---- hard negatives ------------------------------------------------------------------------------------------------------


def mined(rows, width, step=10, positives=5, negatives=3):
    grid = {(k, y, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for k, v, y in rows if k is not None and y is not None and v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for a, label, x in grid:
        if a % step == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, z)), k, y) for k, y, z in grid if k != a)
            for s, p, _ in [r for r in scored if r[2] == label][:positives]:
                found = [(n, t) for t, n, y in scored if y != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
                out += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **sizes):
    got = hard_negatives.mine(vectors(spark, rows), "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, **sizes)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "slab": 7}])
def test_negatives_of_odd_rows(spark, sizes):
    rows = odd(np.random.default_rng(8))
    want = mined(rows, 5)
    assert len(want) > 40 and run(spark, rows, **sizes) == want


def test_hot_vector_and_many_labels(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [0.5, 0.25, -0.25], 1) for i in range(60)] + [(100 + i, [float(v) for v in rng.integers(-64, 64, 3) / 64], i % 9) for i in range(90)]
    assert run(spark, rows, block=4, slab=16) == mined(rows, 3)


def test_nothing_to_mine(spark):
    for rows in ([], [(3, [1.0, 1.0], 1), (4, [1.0, 1.0], 2)], [(10, [1.0, 1.0], 1)], [(10, None, 1)]):
        assert run(spark, rows) == []


def test_bounds_spare_scores_and_lose_nothing():
    rng = np.random.default_rng(10)
    centres = rng.integers(-4000, 4000, (12, 16))
    a = (centres[rng.integers(0, 12, 200)] + rng.integers(-20, 20, (200, 16))).astype(np.int64)
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(np.int64)
    labels = rng.integers(0, 4, 3000)
    search = hard_negatives.Search(np.arange(200), np.arange(200) % 4, a, True, 5)
    for at in range(0, 3000, 500):
        search.meet(10_000 + np.arange(at, at + 500), labels[at : at + 500], x[at : at + 500])
    assert search.scored < 0.5 * search.pairs
    got = defaultdict(list)
    for node, _, key, score in search.results():
        got[node].append((-score, key))
    for node in range(200):
        scores = x @ a[node]
        want = sorted((-int(s), 10_000 + k) for k, s in enumerate(scores) if labels[k] == node % 4)[:5]
        assert sorted(got[node]) == want


def test_tree_spans_and_edges_are_right():
    x = np.random.default_rng(11).integers(-50, 50, (40, 3)).astype(float)
    levels = hard_negatives.spanning_tree(x)
    assert sorted(np.concatenate([n for n, _, _ in levels]).tolist()) == list(range(40))
    total = 0.0
    for (above, _, _), (nodes, parents, edges) in zip(levels, levels[1:]):
        assert np.allclose(edges, np.linalg.norm(x[nodes] - x[above[parents]], axis=1))
        total += edges.sum()
    tree, rest, want = {0}, set(range(1, 40)), 0.0  # Prim, row by row
    while rest:
        d, j = min((np.linalg.norm(x[i] - x[j]), j) for i in tree for j in rest)
        want, tree, rest = want + d, tree | {j}, rest - {j}
    assert abs(total - want) < 1e-6


def test_large_scores_are_exact_or_an_error():
    big = np.array([[1 << 25, 3], [1, 2]], np.int64)
    search = hard_negatives.Search(np.array([0]), np.array([0]), big[:1], True, 2)
    search.meet(np.array([1, 2]), np.array([0, 0]), np.array([[1 << 26, 1], [(1 << 26) - 1, 5]], np.int64))
    assert [r[2:] for r in search.results()] == [(1, (1 << 51) + 3), (2, (1 << 25) * ((1 << 26) - 1) + 15)]
    with pytest.raises(ValueError):
        search.meet(np.array([3]), np.array([0]), np.array([[1 << 40, 0]], np.int64))


# ---- archives ------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, page string, copy int, record string, path string, date int"
LONG = "".join(random.Random(1).choices("abcdefgh <>/é☃", k=400_000))
ROWS = [
    (1, "http://a.example.com/x?y=1#z", "<p>one</p>"), (2, "https://A.example.com:443/x?y=1", "<p>one</p>"), (3, "http://a.example.com:8080", ""), (3, "http://a.example.com:8080", ""), (4, None, None),
    (5, "no scheme { at all\n", "two"), (None, "http://b.example.org/", "<p>one</p>"), (None, None, None), (6, "http://user@b.example.org/?q", LONG), (7, "http://b.example.org/é ü", LONG), (8, "http://a.example.com/x?y=1", "tail \r\n\r\n\x00"),
    (9, "http://a.example.com/x?y=1", "<p>one</p>"), (9, "http://a.example.com/x?y=1", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "p", 7, "r", "q", 0) for r in ROWS], PAGES).repartition(3)


def expected(rows, least=0):
    groups = defaultdict(list)
    for k, _, h in rows:
        groups[(h or "").encode()].append(k)
    out = []
    for body, keys in groups.items():
        keys = sorted(keys, key=lambda k: (k is not None, k or 0))
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if len(body) < least:
            out += [(k, len(body), sha, "response", None) for k in keys]
        else:
            out += [(k, len(body), sha, "revisit", keys[-1]) for k in keys[:-1]] + [(keys[-1], len(body), sha, "response", None)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_of_odd_pages(spark, pages, least):
    got = warc.round_trip(pages, "page_id", "url", "html", scratch_folder(spark, "t"), least)
    assert dict(got.dtypes)["page_id"] == "bigint"
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS, least)


def test_empty_table_and_string_keys(spark, pages):
    assert warc.round_trip(pages.where("false"), "page_id", "url", "html", scratch_folder(spark, "t")).collect() == []
    named = pages.withColumn("page_id", F.concat(F.lit("a:<b>%\n "), F.col("page_id").cast("string")))
    got = warc.round_trip(named, "page_id", "url", "html", scratch_folder(spark, "t")).collect()
    assert {r["page_id"] for r in got} == {f"a:<b>%\n {k}" if k is not None else None for k, _, _ in ROWS}


def test_lookups_read_few_blocks(spark):
    rows = [(i, f"http://h{i % 97}.example.com/p{i % 7}", f"body {i % 301}") for i in range(1500)] + [(2000 + i, "http://h5.example.com/p5", f"own {i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "p", 7, "r", "q", 0) for r in rows], PAGES).repartition(4)
    folder = scratch_folder(spark, "t")
    warc.write_archives(df, "page_id", "url", "html", folder, archive_bytes=20_000)
    warc.build_index(spark, folder, block_lines=25, file_blocks=8)
    index = warc.CaptureIndex(spark, folder)
    assert len(index._paths) > 5 and warc.archives(spark, f"{folder}/warc").count() > 5
    for url in ("http://h3.example.com/p4", "http://h5.example.com/p5", "http://H96.example.com:80/p0#top", "http://aaa.example.com/", "http://zzz.zzz/", None):
        before = index.blocks_read
        found = index.lookup(url)
        want = [h for _, u, h in rows if warc.host_key(u) == warc.host_key(url)]
        assert len(found) == len(want) and index.blocks_read - before <= 3 + len(want) // 25
        held = [index.payload(c).decode() for c in found if c["type"] == "response"]
        assert set(held) <= set(want) and len(held) == len(set(held))
    assert warc.captures(spark, folder).count() == len(rows)


def test_archives_are_what_other_tools_read(spark, pages):
    folder = scratch_folder(spark, "t")
    warc.write_archives(pages, "page_id", "url", "html", folder)
    seen = 0
    for row in warc.archives(spark, f"{folder}/warc").collect():
        rest = gzip.decompress(bytes(row["content"]))  # plain gzip members, plain records
        while rest:
            head, _, rest = rest.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: re")
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))[15:])
            assert rest[size : size + 4] == b"\r\n\r\n"
            rest, seen = rest[size + 4 :], seen + 1
    assert seen == len(ROWS)


def test_members_and_damage():
    noise = random.Random(2).randbytes((16 << 20) + 5)  # the length at the end of its member does not end in zero
    packed = warc.member(b"first") + warc.member(noise) + warc.member(b"last")
    assert packed[-1] == 0 and warc.member(noise)[-1] == 0
    assert [d for _, _, d in warc.members(packed)] == [b"first", noise, b"last"]
    with pytest.raises(ValueError):
        list(warc.members(packed[:-3]))
    record = gzip.decompress(warc._record("response", warc.record_id("1", 0), "http://a/", "d", warc.digest_of(b"abc"), 3, b"abc"))
    assert warc.verified(record)[1] == 3
    with pytest.raises(ValueError):
        warc.verified(record.replace(b"abc\r\n", b"abd\r\n"))


def test_keys_of_hosts():
    assert warc.host_key("http://www.Example.com/A?b=1#c") == "com,example,www)/A?b=1"
    assert warc.host_key("https://example.com:443") == "com,example)/" and warc.host_key("http://example.com:81?q") == "com,example:81)/?q"
    assert warc.host_key(None) == "-" and warc.host_key("Mail") == "mail"
