"""The ten operators against brute-force versions on a small table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import near_dedup, queries, shared, wavelet

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DIR}/documents.parquet").to_pydict()


def by_doc(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A2Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(A2Z))


def test_url_filter(spark, sf_dir):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = pq.read_table(f"{DIR}/pages.parquet").to_pydict()
    got = {r["page_id"]: r for r in queries.op1_url_filters(spark, sf_dir).collect()}
    for pid, url in zip(pages["page_id"], pages["url"]):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
            host = host.translate(A2Z)
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        r = got[pid]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_token_output(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = by_doc(queries.op2_token_output(spark, sf_dir)), 0
    for d, text in sorted(zip(docs["doc_id"], docs["text"])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"]) == (start, len(ids))
        assert got[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("text", ["", " ", "a  b", " a b", "a b ", "a\n b", "a \nb", "a\n\n  b c", "x  y", "it's 5 o'clock <|endoftext|> now", "tab\t x \t y", "é ñ ß 日本 語", "a\t \tb", "a\n \nb c", "a\u3000 \u00a0b", "a   b", "x. 's y", "a<|endoftext|> b <|endoftext|>c d", "a \tb c\n d", " ", "\n \n"])
def test_pieces_encode_like_whole_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert wavelet.encode_texts([text], path, 2)[0].tolist() == [*want, 2]


def test_texts_are_encoded_alike_in_batches():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    marks = ["a", "be", "It's", "\n", "\t", "", "x.", "ñ", "\u2003", "<|endoftext|>", "12", "##"]
    texts = [" ".join(rng.choice(marks, n)) for n in rng.integers(0, 12, 3000)]
    want = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    for _ in range(2):  # fresh pieces, then remembered ones
        assert all(g.tolist() == [*w.ids, 2] for g, w in zip(wavelet.encode_texts(texts, path, 2), want))


@pytest.mark.parametrize("levels, top, n", [(9, 300, 5000), (16, 300, 200_000), (17, 1 << 17, 70_000), (1, 2, 9), (16, 5, 0)])
def test_wavelet_rank_and_select(levels, top, n):
    ids = np.random.default_rng(1).integers(0, top, n).astype(np.uint32)
    starts = np.array([0, n // 2])
    blob, reads = wavelet.encode_shard(ids, starts, np.array([7, 9]), np.array([True, False]), levels), []
    shard = wavelet.WaveletShard(lambda at, size: reads.append(size) or blob[at : at + size])
    for i in range(0, n, max(n // 9, 1)):
        assert shard.access(i) == ids[i]
        assert sum(reads) < len(blob) or n < 1000
    assert (shard.ids() == ids).all() and (wavelet.WaveletShard(blob).ids() == ids).all()
    assert [x.tolist() for x in shard.documents()] == [starts.tolist(), [7, 9], [True, False]]
    for token in (0, 1, top - 1, top, 1 << 20):
        at = np.flatnonzero(ids == token)
        assert shard.count(token) == len(at)
        assert shard.rank(token, n // 2) == (at < n // 2).sum()
        for k in range(0, len(at), max(len(at) // 9, 1)):
            assert shard.select(token, k) == at[k]
    for bad in (lambda: shard.select(top, 0), lambda: shard.access(n), lambda: shard.access(-1)):
        with pytest.raises(IndexError):
            bad()


def test_one_access_reads_few_blocks():
    ids = np.random.default_rng(1).integers(0, 50_000, 600_000).astype(np.uint32)
    blob, reads = wavelet.encode_shard(ids, np.array([0]), np.array([1]), np.array([True])), []
    shard = wavelet.WaveletShard(lambda at, size: reads.append(size) or blob[at : at + size])
    assert shard.access(123_456) == ids[123_456] and sum(reads) < 0.2 * len(blob)


def test_ids_beyond_the_planes_are_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        wavelet.encode_shard(np.array([70_000], np.uint32), np.array([0]), np.array([1]), np.array([True]))
    assert wavelet.levels_for(50_257) == 16 and wavelet.levels_for(65_537) == 17 and wavelet.levels_for(1) == 1


def test_shards_are_kept_at_a_path(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(i % 3 if i % 4 else None, f"one two {i}" if i % 5 else None) for i in range(50)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    report = wavelet.token_report(docs, path, 2, path=str(tmp_path / "shards"))
    files = wavelet.load_shards(spark, str(tmp_path / "shards"))
    again = wavelet.read_shards(files).collect()
    assert sorted(map(str, again)) == sorted(map(str, report.collect())) and len(again) == 50
    ordered = sorted(again, key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys) and ordered[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))


def test_classifiers_on_held_out_rows(spark):
    """At sf0.1, whose labels are enough to learn from: held-out accuracy above the share of the larger class."""
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas().set_index("doc_id")
    for query, label in ((queries.op3_quality, "quality"), (queries.op4_toxicity, "toxic")):
        rows = query(spark, "/root/testdata/sf0.1").where("held_out").toPandas().set_index("doc_id").join(labels, how="inner")
        assert rows["score"].between(0, 1).all()
        right = (rows["predicted"] == rows[label]).mean()
        assert right > 0.95, (label, right)
        assert len(rows) > 500


def near_classes(texts):
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter() for w in map(words, texts)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            every = sum((sets[i] | sets[j]).values())
            if (every and both >= 0.8 * every) or (texts[i] is not None and texts[i] == texts[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, sf_dir, docs):
    got = by_doc(queries.op5_near_dedup(spark, sf_dir))
    classes = near_classes(docs["text"])
    least = {}
    for d, c in zip(docs["doc_id"], classes):
        least[c] = min(d, least.get(c, d))
    assert {d: r["class_id"] for d, r in got.items()} == {d: least[c] for d, c in zip(docs["doc_id"], classes)}


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 6, 200) for _ in range(2))
    b = np.where(rng.random(200) < 0.6, a, b)
    h = shared.mix(np.arange(200, dtype=np.uint64))
    sigs = []
    for w in (a, b):
        keep = w > 0
        sigs.append(near_dedup.signatures(np.zeros(keep.sum(), int), h[keep], w[keep], 1, 4000)[0])
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sigs[0] == sigs[1]).mean() - true) < 0.03


def test_suffix_dedup(spark, sf_dir, docs):
    got = by_doc(queries.op6_suffix_dedup(spark, sf_dir))
    bodies = [(t or "").encode() for t in docs["text"]]
    seen = Counter()
    for b in bodies:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for d, b in zip(docs["doc_id"], bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(gone.sum()), spans), d
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_fingerprints(spark, sf_dir, docs):
    got = by_doc(queries.op8_fingerprints(spark, sf_dir))
    rows = sorted(zip(docs["doc_id"], docs["text"]), reverse=True)
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"])
        assert r["near_next"] == float(r["fingerprint"] == got[rows[(i + 1) % len(rows)][0]]["fingerprint"])
    prints = {}
    for d, t in rows:
        assert prints.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_sharding(spark, sf_dir, docs):
    got = by_doc(queries.op9_sharding(spark, sf_dir))
    slots = {}
    for d, t in zip(docs["doc_id"], docs["text"]):
        r, body = got[d], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 16, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(40))


def contaminated(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        if not n:
            continue
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, sf_dir, docs):
    bench = pq.read_table(f"{DIR}/benchmark.parquet").to_pydict()
    items = list(zip(bench["item_id"], bench["text"]))
    got = by_doc(queries.op10_decontamination(spark, sf_dir))
    for d, t in zip(docs["doc_id"], docs["text"]):
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == contaminated(t, items), d
