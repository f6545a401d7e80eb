"""Exact repeated-substring removal by a column-wise multi-document suffix order.

Each window of LENGTH bytes has an anchor, the k-gram of least hash in it (the leftmost of equals), which depends on the window's bytes
alone. So equal windows have equal anchors at the same place, and only stretches around one anchor k-gram have to be compared. Those
stretches, lined up at the anchor, are the documents of a collection: from the last column to the first, one symbol of every document
is inserted in each round; the order of the collection's suffixes (its Burrows-Wheeler order at that column) and the common prefixes
of neighbours are updated from the round before. A window is repeated if a neighbour's common prefix spans it. The rounds' inputs and
outputs are sequential files, Spark's sorted shuffle blocks and Parquet. Around an anchor with more than CROWD different stretches, as a
passage that very many texts share with different surroundings makes them, windows are counted one by one by a 128-bit hash instead,
map-side first, so no task holds more than CROWD stretches of one anchor. Equal stretches and those windows are equal by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import materialise, mix, release, slices, text_bytes, text_key

LENGTH, GRAM = 200, 32
#: Around one anchor k-gram, the windows of more different stretches than this are counted one by one.
CROWD, SALTS = 4096, 16
#: Texts with such an anchor whose numbers (8 bytes each) are broadcast; above that they are found by a shuffle join.
BROADCAST_TEXTS = 1_000_000
#: A key that more than one in so many rows have is broadcast to its rows; there are fewer such keys than this number.
HOT = 5000
#: Bytes of text that a task's arrays are made of at a time.
PART = 512 << 10
#: Stretches in one collection; a collection ends only between two anchors.
COLLECTION = 20_000

#: Bits of a stretch's number of windows and of its anchor's place, beside its start, in one long.
BITS = 17
_FIELD = (1 << BITS) - 1

_P, _Q = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F


def _power(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n + 1, base)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class RangeHash:
    """Hash of any byte range of a buffer, of `shortest` bytes at least, in constant time, by an odd base. What is summed at a place is mixed
    from the (up to 8) bytes that begin there: sums of single bytes by powers modulo 2**64 agree on structured ranges whatever the base."""

    def __init__(self, data: np.ndarray, shortest: int, base: int = _P) -> None:
        unit, self.unit = data.astype(np.uint64), 1
        while self.unit < 8 and 2 * self.unit <= shortest:
            unit = unit[: -self.unit] | (unit[self.unit :] << np.uint64(8 * self.unit))
            self.unit *= 2
        terms = mix((unit + np.uint64(1)) * np.uint64(base)) * _power(np.uint64(base), len(data))[: len(unit)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _power(np.uint64(pow(base, -1, 1 << 64)), len(data))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - (self.unit - 1)] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Stretches of a batch of texts: (row, anchor hash, content hash, first window's start in its text, windows - 1, anchor's place in
    the stretch). A stretch holds the consecutive windows of one text that have one anchor."""
    n, w = len(data), length - k + 1
    if n >> 28:  # places and hashes share 64 bits
        raise ValueError("texts of one batch, or one text, of 256 MB and more are not supported")
    starts_ok = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    long_enough = np.diff(offsets) >= length
    np.add.at(edge, offsets[:-1][long_enough], 1)
    np.add.at(edge, offsets[1:][long_enough] - length + 1, -1)
    starts_ok = np.cumsum(edge[:-1]) > 0
    s = np.flatnonzero(starts_ok)
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    ranges = RangeHash(data, k)
    m = n - k + 1
    grams = ranges.of(np.arange(m), np.arange(k, n + 1))
    keyed = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(m, dtype=np.uint64)
    full = np.full(-(-(m + w) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:m] = keyed
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(behind[s], ahead[s + w - 1]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, s, side="right") - 1
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    lo, span, a, row = s[first], s[last] - s[first], at[first], row[first]
    content = mix(ranges.of(lo, lo + span + length) + (a - lo).astype(np.uint64))
    return row, grams[a].view(np.int64), content.view(np.int64), lo - offsets[row], span, a - lo


def repeated_windows(group: np.ndarray, column: np.ndarray, pieces: list[np.ndarray], copies: np.ndarray, length: int, width: int) -> np.ndarray:
    """For stretches lined up at their anchors, which windows are repeated: (width of starts, n) booleans by column and stretch.

    group: dense ascending number of the anchor of each stretch. column: where the stretch starts. copies: how often it occurs.
    Rounds go from the last column to the first. `order` lists the stretches by (anchor, suffix from this column) and `common` has
    the common prefix of each with the one before it.
    """
    n = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    columns = width + length - 1
    symbols = np.full((columns, n), 256, np.int16)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + column[owner]
    symbols[place, owner] = np.concatenate(pieces) if n else []
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    last_start = column + sizes - length
    found = np.zeros((width, n), bool)
    base = group.astype(np.int64) * 257
    for c in range(columns - 1, -1, -1):
        key = base[order] + symbols[c, order]
        rank = np.argsort(key, kind="stable")
        key = key[rank]
        same = np.zeros(n + 1, bool)
        same[1:n] = (key[1:] == key[:-1]) & (key[1:] % 257 != 256)
        fresh = np.zeros(n + 1, np.int32)
        i = np.flatnonzero(same)
        if len(i):
            low, high = rank[i - 1] + 1, rank[i] + 1
            near = high - low == 1
            fresh[i[near]] = common[low[near]] + 1
            far = ~near
            if far.any():  # least common prefix of all that stood between the two
                cuts = np.stack([low[far], high[far]], axis=1).reshape(-1)
                fresh[i[far]] = np.minimum.reduceat(common, cuts)[::2] + 1
        order, common = order[rank], fresh
        if c < width:
            spans = (common[:n] >= length) | (common[1:] >= length) | (copies[order] > 1)
            spans &= (column[order] <= c) & (c <= last_start[order])
            found[c, order[spans]] = True
    return found


def _collect(batches: Iterator) -> Iterator[dict[str, list]]:
    """Rows sorted by anchor, cut between two anchors once there are COLLECTION of them; one anchor has CROWD at most."""
    held = None
    for batch in batches:
        held = batch if held is None else _concat(held, batch)
        if held.num_rows >= COLLECTION:
            ah = held["ah"].to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(ah, ah[-1], side="left"))
            if cut:
                yield held.slice(0, cut)
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _concat(a, b):
    import pyarrow as pa

    return pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]


def packed_texts(texts: DataFrame) -> DataFrame:
    """(tid, n, size, z): texts compressed one by one, as they move through two joins."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in slices(whole, ["text"], most=PART):
                bodies = [t.encode() for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["tid"], batch["n"], pa.array([len(b) for b in bodies], pa.int64()), pa.array([pack(b) for b in bodies], pa.binary())], names=["tid", "n", "size", "z"])

    return texts.select("tid", "n", "text").mapInArrow(run, "tid binary, n long, size long, z binary")


def unpacked(column):
    """Texts of a packed column, as an Arrow array of bytes."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(z) for z in column.to_pylist()], pa.large_binary())


def occurring_again(rows: DataFrame, key: list[str], count: str) -> DataFrame:
    """The rows of a written table whose key has a total `count` over 1. Keys that more than one in HOT rows have are broadcast, so that
    their rows stay where they are; the others meet their totals in a shuffle join."""
    totals = materialise(rows.groupBy(*key).agg(F.sum(count).alias("c")).where("c > 1"), "totals")
    most = (rows.agg(F.sum(count)).first()[0] or 0) / HOT
    hot = totals.where(F.col("c") > most).select(*key)
    if hot.isEmpty():
        return rows.join(totals.select(*key), key, "left_semi")
    hot = F.broadcast(hot)
    rest = rows.join(hot, key, "left_anti").join(totals.where(F.col("c") <= most).select(*key), key, "left_semi")
    return rows.join(hot, key, "left_semi").unionByName(rest)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(tid, size, z, spans) of every distinct text: spans = starts [from, to) of its windows that occur elsewhere too, as
    array<struct<f:int,t:int>>, not in order. length: k bytes at least, and less than 2**BITS - 1 more; else an error."""
    width = length - k + 1
    if not 1 <= width <= _FIELD:
        raise ValueError(f"a window of {length} bytes has to be as long as the anchor's {k}, and longer by less than {_FIELD}")
    texts = docs.select(text_key(F.col(text)).alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    texts = materialise(packed_texts(texts).withColumn("rid", F.monotonically_increasing_id()), "distinct")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["z"], "size", PART):
                row, anchor, content, lo, span, place = anchors(*text_bytes(unpacked(batch["z"])), length, k)
                rid, n = (batch[c].to_numpy()[row] if len(row) else np.zeros(0, np.int64) for c in ("rid", "n"))
                packed = (lo << 2 * BITS) | (span << BITS) | place
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (rid, n, anchor, content, packed)], names=["rid", "n", "ah", "ch", "packed"])

    every = materialise(texts.select("rid", "n", "size", "z").mapInArrow(cut, "rid long, n long, ah long, ch long, packed long"), "anchors")
    found = materialise(occurring_again(every, ["ah"], "n"), "repeated")
    release(every)
    stretches = found.groupBy("ah", "ch").agg(F.sum("n").alias("m"), F.min("rid").alias("rid"), F.min_by("packed", "rid").alias("packed"))
    stretches = materialise(stretches, "stretches")
    # few against the stretches, so copied to SALTS tasks: one anchor's stretches are dealt over them
    crowded = stretches.groupBy("ah").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("ah", F.lit(True).alias("crowd"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = stretches.withColumn("salt", F.pmod("ch", F.lit(SALTS)).cast("int")).join(crowded, ["ah", "salt"], "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    asked = materialise(asked.select("rid", "ah", "ch", "m", "packed", "crowd"), "asked")
    # stretches that very many texts hold
    most = (stretches.agg(F.sum("m")).first()[0] or 0) / HOT
    hot = materialise(stretches.where(F.col("m") > most).select("ah", "ch"), "hot")
    release(stretches)
    lists = asked.groupBy("crowd", "rid").agg(F.collect_list(F.struct("ah", "ch", "m", "packed")).alias("asked"))
    crowds = asked.where("crowd").select("rid").distinct()
    few = crowds.count()

    def bring(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["z"], "size", PART):
                data, offsets = text_bytes(unpacked(batch["z"]))
                lists = batch["asked"]
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                ah, ch, m, packed = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                lo, span, place = packed >> 2 * BITS, (packed >> BITS) & _FIELD, packed & _FIELD
                column = width - 1 - place
                start = offsets[row] + lo
                end = start + span + length
                body = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ah), pa.array(ch), pa.array(m), pa.array(column), pa.array([body[x:y] for x, y in zip(start, end)], pa.binary())], names=["ah", "ch", "m", "column", "piece"],
                )

    pieces = texts.join(lists.where("not crowd"), "rid").select("size", "z", "asked").mapInArrow(bring, "ah long, ch long, m long, column long, piece binary")
    pieces = pieces.repartition("ah").sortWithinPartitions("ah")

    def apart(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["z"], "size", PART):
                data, offsets = text_bytes(unpacked(batch["z"]))
                lists = batch["asked"]
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                ah, ch, m, packed = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                number = ((packed >> BITS) & _FIELD) + 1
                own = np.repeat(np.arange(len(row)), number)
                f = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
                start = (offsets[row] + (packed >> 2 * BITS))[own] + f
                one, two = (RangeHash(data, length, base).of(start, start + length).view(np.int64) for base in (_P, _Q))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, ah[own], ch[own], m[own], f.astype(np.int32))], names=["one", "two", "ah", "ch", "m", "f"])

    def rounds(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _collect(batches):
            ah = batch["ah"].to_numpy()
            group = np.cumsum(np.append(0, ah[1:] != ah[:-1]))
            data, offsets = text_bytes(batch["piece"])
            column = batch["column"].to_numpy()
            parts = [data[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
            hit = repeated_windows(group, column, parts, batch["m"].to_numpy(), length, width)
            flank = np.zeros((1, hit.shape[1]), np.int8)
            edge = np.diff(np.concatenate([flank, hit.astype(np.int8), flank]), axis=0).T
            row, start = np.nonzero(edge == 1)
            end = np.nonzero(edge == -1)[1]
            origin = column[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch[c].to_numpy()[row]) for c in ("ah", "ch")] + [pa.array((x - origin).astype(np.int32)) for x in (start, end)], names=["ah", "ch", "f", "t"]
            )

    spans = materialise(pieces.mapInArrow(rounds, "ah long, ch long, f int, t int"), "spans")
    if few:
        own = texts.join(F.broadcast(crowds) if few <= BROADCAST_TEXTS else crowds, "rid", "left_semi")
        windows = own.join(lists.where("crowd"), "rid").select("size", "z", "asked")
        windows = materialise(windows.mapInArrow(apart, "one long, two long, ah long, ch long, m long, f int"), "windows")
        again = materialise(occurring_again(windows, ["one", "two"], "m").select("ah", "ch", "f", (F.col("f") + 1).alias("t")), "again")
        release(windows)
        spans = spans.unionByName(again)
    release(asked)
    spans = materialise(spans.groupBy("ah", "ch").agg(F.collect_list(F.struct("f", "t")).alias("ft")), "spans")
    lo = F.shiftright("packed", 2 * BITS).cast("int")
    held, key = found.select("rid", "ah", "ch", "packed"), ["ah", "ch"]
    if hot.isEmpty():
        placed = held.join(spans, key)
    else:  # such a stretch's spans go to its texts by broadcast: HOT of them at most, of a window's width each
        hot = F.broadcast(hot)
        placed = held.join(hot, key, "left_anti").join(spans.join(hot, key, "left_anti"), key).unionByName(held.join(F.broadcast(spans.join(hot, key, "left_semi")), key))
    placed = placed.select("rid", F.transform("ft", lambda s: F.struct((s["f"] + lo).alias("f"), (s["t"] + lo).alias("t"))).alias("ft"))
    placed = placed.groupBy("rid").agg(F.flatten(F.collect_list("ft")).alias("spans"))
    return texts.join(placed, "rid", "left").select("tid", "size", "z", "spans")


def removed(docs: DataFrame, text: str = "text", length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(tid, n_bytes, n_removed, n_spans, kept_sha256, kept) of every distinct text; kept: the bytes left, joined together."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["z"], "size", PART):
                out = []
                for body, spans in zip(unpacked(batch["z"]).to_pylist(), batch["spans"]):
                    left, gone, runs, at = [], 0, 0, 0
                    if spans.is_valid:
                        flat = spans.values
                        f, e = flat.field(0).to_numpy(), flat.field(1).to_numpy() + (length - 1)
                        order = np.argsort(f, kind="stable")
                        f, e = f[order], np.maximum.accumulate(e[order])
                        new = np.append(True, f[1:] > e[:-1])
                        for x, y in zip(f[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(f) - 1)]):
                            left.append(body[at:x])
                            gone, runs, at = gone + int(y - x), runs + 1, int(y)
                    left.append(body[at:])
                    rest = b"".join(left)
                    out.append((len(body), gone, runs, hashlib.sha256(rest).hexdigest(), rest))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch["tid"], *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3]), pa.array(cols[4], pa.binary())], names=["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = repeated_spans(docs, text, length, k)
    return spans.mapInArrow(run, "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """One row for each document: (key, n_bytes, n_removed, n_spans, kept_sha256[, kept]).

    Each byte covered by a string of `length` bytes that also starts anywhere else, in the same document or another, is removed;
    overlaps count; texts are UTF-8 bytes, null is empty; matches never cross documents. Copies of a document repeat each other. Every row
    is answered, repeated ones too; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    results = removed(docs, text, length, k)
    if not keep_bytes:
        results = results.drop("kept")
    results = materialise(results, "removed")
    rows = docs.select(F.col(key).alias("__key"), text_key(F.col(text)).alias("__tid"))
    return rows.join(results, F.col("__tid") == F.col("tid")).drop("__tid", "tid").withColumnRenamed("__key", key)
