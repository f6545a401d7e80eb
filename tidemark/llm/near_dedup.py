"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, and a check of the true overlap.

Weights are whole counts. A shingle of count c owns the levels 1..c, which are cut into the ranges (0,1], (1,2], (2,4], (4,8] ..; a
Poisson process of the range's width runs over each, its points fall on random levels and random signature slots, and points on
levels above c are thrown away. Each slot keeps the earliest time. Two texts agree in a slot with the probability of their weighted
Jaccard similarity. A process stops once it has passed the latest time of its text's slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import _GOLDEN, free_names, materialise, mix, shingles, slices, text_key

#: Texts of similarity 0.8 share a band with probability 1 - (1 - 0.8**5)**26 = 0.99997.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 26, 5
#: Texts of each bucket that all others of the bucket are checked against first.
DRAWS = 4
#: 64-bit words of a text's shingle bitmap, which bounds what two texts can share before their words are compared.
BITMAP = 16


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """(n_rows, slots) earliest times; inf throughout for a row without elements."""
    sig = np.full((n_rows, slots), np.inf)
    flat, latest = sig.reshape(-1), np.full(n_rows, np.inf)
    # the ranges of each element
    depth = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64), 0) + 1
    source = np.repeat(np.arange(len(hashes)), depth)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(nth == 0, 0, 1 << np.maximum(nth - 1, 0))
    width = np.where(nth < 2, 1, 1 << np.maximum(nth - 1, 0))
    seed, row, count = mix(hashes[source] + nth.astype(np.uint64) * _GOLDEN), rows[source], counts[source]
    time, done, block = np.zeros(len(seed)), 0, 1
    while len(seed):
        j = np.arange(done + 1, done + block + 1, dtype=np.uint64) * _GOLDEN
        r = mix(seed[:, None] + j[None, :])
        gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        where = mix(r ^ np.uint64(0xA5A5A5A55A5A5A5A))
        slot = (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % slots
        level = low[:, None] + (((where >> np.uint64(32)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        ok = (level < count[:, None]) & (times < latest[row][:, None])
        np.minimum.at(flat, (row[:, None] * slots + slot)[ok], times[ok])
        time = times[:, -1]
        touched = np.unique(row)
        latest[touched] = sig[touched].max(axis=1)
        alive = time < latest[row]
        seed, row, count, low, width, time = (x[alive] for x in (seed, row, count, low, width, time))
        done, block = done + block, min(2 * block, 32) if done else 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) hashes of the slots of each band, distinct between bands."""
    parts = mix(np.ascontiguousarray(sig[:, : bands * rows]).view(np.uint64)).reshape(len(sig), bands, rows)
    place = (np.arange(bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(1, bands, rows)
    return mix((parts * place).sum(axis=2) + np.arange(bands, dtype=np.uint64) * _GOLDEN)


def banded(texts: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """(tid, n, keys) of a table (tid, text): shingles and band keys of each text, [] for a text without words."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"]):
                at, gram, n = shingles(batch["text"], k)
                keys = band_keys(signatures(at, gram, n, batch.num_rows, bands * rows), bands, rows)
                has = np.zeros(batch.num_rows, bool)
                has[at] = True
                offsets = np.append(0, np.cumsum(np.where(has, bands, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].reshape(-1).view(np.int64)))
                total = np.bincount(at, n, batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["tid"], pa.array(total), lists], names=["tid", "n", "keys"])

    return texts.mapInArrow(run, "tid binary, n long, keys array<long>")


def overlap(left, right, k: int) -> np.ndarray:
    """Weighted Jaccard similarity of two Arrow string columns, row by row; 0 where neither text has words."""
    n = len(left)
    total, shared = np.zeros(n), np.zeros(n)
    sides = [shingles(x, k) for x in (left, right)]
    for at, _, count in sides:
        total += np.bincount(at, count, n)
    at, gram, count = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((gram, at))
    at, gram, count = at[order], gram[order], count[order]
    same = (at[1:] == at[:-1]) & (gram[1:] == gram[:-1])
    shared += np.bincount(at[1:][same], np.minimum(count[1:], count[:-1])[same], n)
    return np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs (a, b) of text numbers whose texts have at least that similarity."""
    one = texts.select(F.col("rid").alias("a"), F.col("text").alias("left"))
    two = texts.select(F.col("rid").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["left", "right"]):
                yield batch.select(["a", "b"]).filter(pa.array(overlap(batch["left"], batch["right"], k) >= least))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def own_weight(texts: DataFrame, k: int) -> DataFrame:
    """(rid, own): of each text of a table (rid, text), how many of its shingles stand in no other text of the table; texts without
    any are left out."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"]):
                at, gram, n = shingles(batch["text"], k)
                yield pa.RecordBatch.from_arrays([pa.array(batch["rid"].to_numpy()[at]), pa.array(gram.view(np.int64)), pa.array(n)], names=["rid", "g", "c"])

    grams = texts.select("rid", "text").mapInArrow(run, "rid long, g long, c long")
    alone = grams.groupBy("g").agg(F.count("*").alias("texts"), F.max("rid").alias("rid"), F.max("c").alias("c")).where("texts = 1")
    return alone.groupBy("rid").agg(F.sum("c").alias("own"))


def bitmaps(texts: DataFrame, k: int) -> DataFrame:
    """(rid, bits): of each text of a table (rid, text), BITMAP longs in which every shingle sets the bit that its hash names."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"]):
                at, gram, _ = shingles(batch["text"], k)
                bits = np.zeros((batch.num_rows, BITMAP), np.uint64)
                np.bitwise_or.at(bits, (at, (gram >> np.uint64(6)) % np.uint64(BITMAP)), np.uint64(1) << (gram & np.uint64(63)))
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BITMAP)
                lists = pa.ListArray.from_arrays(offsets, pa.array(bits.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["rid"], lists], names=["rid", "bits"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, bits array<long>")


def apart_at_least(left: str, right: str) -> Column:
    """How many bits differ between two bitmaps (columns left0.., right0..): so many shingles at least are in one text only."""
    return sum((F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))) for i in range(BITMAP)), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of an edge table (a, b) of longs: large and small stars in turn until nothing changes, then
    every node hangs on the least of its component. Steps are written, not collected."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        met = both.join(least, F.col("a") == F.col("n"))
        out = met.where(F.col("b") > F.col("a")).select("b", "m") if large else met.select("b", "m").union(least.select("n", "m"))
        return out.toDF("a", "b").where("a <> b").distinct()

    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        now = materialise(stars(stars(now, True), False), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _torn(placed: DataFrame) -> DataFrame:
    """Rows of the buckets (h) that hold texts of more than one component (c)."""
    parts = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    return placed.join(parts, "h", "left_semi")


def near_duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(tid, component) of every distinct text: components of the graph of texts that share a band and have at least that weighted
    Jaccard similarity of their word-shingle multisets. Copies of a text count once.

    In each bucket every text is first checked against DRAWS texts drawn by hash, others in every bucket; texts of one bucket that
    are still in different components are then checked against each other, unless a bound on the shingles they share rules it
    out. So no pair that could join two components is left out, and most of a group of n near copies is
    joined by some n checks for each band.
    """
    base = docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("tid"), F.col(text).alias("text"))
    keyed = banded(base, bands, rows, k).groupBy("tid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    sigs = materialise(keyed.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    members = sigs.select("rid", F.explode("keys").alias("h"))
    drawn = [F.min_by("rid", F.xxhash64("rid", "h", F.lit(i))).alias(f"rep{i}") for i in range(DRAWS)]
    chosen = members.groupBy("h").agg(*drawn, F.count("*").alias("n")).where("n > 1")
    shared = members.join(chosen.select("h", F.array_distinct(F.array(*[f"rep{i}" for i in range(DRAWS)])).alias("reps")), "h")
    shared = materialise(shared, "buckets")
    pairs = shared.select("rid", F.explode("reps").alias("rep")).where("rid <> rep").select(F.least("rid", "rep").alias("a"), F.greatest("rid", "rep").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    wanted = sigs.join(shared.select("rid").distinct(), "rid", "left_semi").select("tid", "rid")
    texts = base.join(wanted, "tid").groupBy("rid").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    edges = materialise(verified(pairs, texts, k, least), "links")
    joined = components(edges)
    placed = shared.join(joined, F.col("rid") == F.col("node"), "left").select("h", "rid", F.coalesce("component", "rid").alias("c"))
    placed = materialise(placed, "placed")
    # What can still be alike: a pair shares at most the shingles that neither has alone, and its union has those of both that are
    # alone. So of n shingles with `own` alone, n - own must reach least * (n + the least `own` of the bucket).
    torn = _torn(placed)
    rids = torn.select("rid").distinct()
    alone = own_weight(texts.join(rids, "rid", "left_semi"), k)
    weights = rids.join(sigs.select("rid", "n"), "rid").join(alone, "rid", "left").select("rid", "n", F.coalesce("own", F.lit(0)).alias("own"))
    torn = materialise(torn.select("h", "rid", "c").join(materialise(weights, "weights"), "rid"), "torn")
    floor = torn.groupBy("h").agg(F.min("own").alias("floor"))
    torn = torn.join(floor, "h").where(F.col("n") - F.col("own") + 1e-9 >= least * (F.col("n") + F.col("floor"))).drop("floor")
    torn = materialise(_torn(torn), "torn")
    # Texts outside a bucket's largest component meet all others of the bucket; the shingles that a pair can share are bounded by
    # their bitmaps, inside the join.
    bits = materialise(bitmaps(texts.join(torn.select("rid").distinct(), "rid", "left_semi"), k), "bitmaps")
    largest = torn.groupBy("h", "c").count().groupBy("h").agg(F.max_by("c", F.struct("count", "c")).alias("largest"))
    torn = torn.join(largest, "h").join(bits, "rid").select("h", "largest", "rid", "c", "n", *[F.coalesce(F.col("bits")[i], F.lit(0)).alias(f"x{i}") for i in range(BITMAP)])
    torn = materialise(torn, "torn")
    one = torn.where("c <> largest").drop("largest")
    two = torn.select("h", "largest", *[F.col(c).alias(f"{c}_") for c in ("rid", "c", "n")], *[F.col(f"x{i}").alias(f"y{i}") for i in range(BITMAP)])
    # a pair is met once: from the text outside the largest component, or from the one of the lesser component
    once = ((F.col("c") < F.col("c_")) | (F.col("c_") == F.col("largest"))) & (F.col("c") != F.col("c_"))
    # similarity s of n and m shingles, d of them on one side only: s <= (n + m - d) / (n + m + d)
    possible = once & (apart_at_least("x", "y") * (1 + least) <= (F.col("n") + F.col("n_")) * (1 - least) + 1e-9)
    cross = one.alias("x").join(two.alias("y"), (F.col("x.h") == F.col("y.h")) & possible)
    cross = cross.select(F.least("rid", "rid_").alias("a"), F.greatest("rid", "rid_").alias("b")).distinct()
    cross = materialise(cross.join(pairs, ["a", "b"], "left_anti"), "cross")
    more = materialise(verified(cross, texts, k, least), "links")
    if not more.isEmpty():
        joined = components(edges.union(more))
    return sigs.join(joined, F.col("rid") == F.col("node"), "left").select("tid", F.coalesce("component", "rid").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row for each document: (key, class_id), class_id the least key of its class. A null text is in no class with others;
    texts without words are classed with their exact copies only. Equal rows share a class; an empty table gives no rows; other columns
    are ignored, whatever their names."""
    groups = materialise(near_duplicate_groups(docs, key, text, **settings), "groups")
    rows = docs.select(F.col(key).alias("__key"), F.when(F.col(text).isNotNull(), text_key(F.col(text))).alias("__tid"))
    rows = rows.join(groups, F.col("__tid") == F.col("tid"), "left").select("__key", "component")
    least = rows.where("component is not null").groupBy("component").agg(F.min("__key").alias("class_id"))
    return rows.join(least, "component", "left").select(
        F.col("__key").alias(key), F.when(F.col("component").isNull(), F.col("__key")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each class, the one of the least key (ties: the least row hash; equal rows leave one), with the input's columns,
    whatever their names; null texts all stay; an empty table gives no rows."""
    groups = materialise(near_duplicate_groups(docs, key, text, **settings), "groups")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tid, row = free_names(docs.columns, "tid", "row")
    rows = docs.where(F.col(text).isNotNull()).select(*columns, text_key(F.col(text)).alias(tid), F.xxhash64(*columns).alias(row))
    best = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("r"), F.col("t"))
    narrow = rows.select(F.col(key).alias("key"), F.col(tid).alias("t"), F.col(row).alias("r")).join(groups, F.col("t") == F.col("tid"))
    winners = narrow.groupBy("component").agg(F.min(best).alias("w")).select(F.col("w.t").alias(tid), F.col("w.r").alias(row))
    kept = rows.join(materialise(winners, "winners"), [tid, row], "left_semi").distinct()
    return kept.select(*columns).union(docs.where(F.col(text).isNull()))
