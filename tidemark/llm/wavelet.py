"""Token-id output: one compressed wavelet matrix per shard, with rank and select on its bit-planes.

A shard file (one binary value) holds the bit-planes of its ids, most significant first; ids are put in stable order of each plane's bit
before the next plane is cut. Planes are packed 8 bits a byte and compressed in blocks of BLOCK_BYTES on their own; the file also stores
where each block lies and the count of ones before every RANK_BYTES of each plane. So access(i), rank(id, i), select(id, k) and
count(id) read the directory and a few blocks a plane, not the whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from tidemark.llm.shared import materialise, slices, text_bytes

MAGIC, RANK_BYTES, BLOCK_BYTES, SHARD_TOKENS = b"TWM2", 512, 8192, 1 << 20
_HEADER = struct.Struct("<4s3q3q")  # magic; ids, documents, levels; sizes of starts, keys and known
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def levels_for(size: int) -> int:
    """Bit-planes that ids below `size` need."""
    return max(1, (size - 1).bit_length())


def encode_shard(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, levels: int = 16) -> bytes:
    """File of one shard: ids of its documents, where each document starts, its id and whether that is known (not null). An id that
    does not fit the levels is an error."""
    import zstandard

    if len(ids) and int(ids.max()) >> levels:
        raise ValueError(f"id {int(ids.max())} does not fit {levels} bit-planes")
    pack = zstandard.ZstdCompressor(level=1).compress
    current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, ranks, blocks = [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (current & current.dtype.type(1 << level)) != 0
        plane = np.packbits(bit)
        ones = np.add.reduceat(_ONES[plane], np.arange(0, len(plane), RANK_BYTES), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<i8"))
        body = plane.tobytes()
        blocks += [pack(body[at : at + BLOCK_BYTES]) for at in range(0, len(body), BLOCK_BYTES)]
        zeros.append(len(ids) - int(ranks[-1][-1]))
        current = np.concatenate([current[~bit], current[bit]])
    ends = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8")
    docs = [pack(x) for x in (starts.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes(), np.packbits(known).tobytes())]
    head = _HEADER.pack(MAGIC, len(ids), len(starts), levels, *map(len, docs))
    return b"".join([head, np.asarray(zeros, "<i8").tobytes(), *(r.tobytes() for r in ranks), ends.tobytes(), *docs, *blocks])


class WaveletShard:
    """Reader of one shard file: its bytes, or a function (offset, size) -> bytes that reads parts of it. Blocks are read when they are
    first met."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]) -> None:
        self._read = source if callable(source) else lambda at, size: source[at : at + size]
        magic, self.n, self.n_docs, self.levels, *self._doc_sizes = _HEADER.unpack(self._read(0, _HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.plane_bytes = (self.n + 7) // 8
        self.per_plane = -(-self.plane_bytes // BLOCK_BYTES)
        counts = 1 + -(-self.plane_bytes // RANK_BYTES)
        at, shape = _HEADER.size, [self.levels, self.levels * counts, self.levels * self.per_plane + 1]
        whole = np.frombuffer(self._read(at, 8 * sum(shape)), "<i8")
        self.zeros, ranks, self._ends = np.split(whole, np.cumsum(shape[:2]))
        self._ranks = ranks.reshape(self.levels, counts)
        self._docs_at = at + 8 * sum(shape)
        self._blocks_at = self._docs_at + sum(self._doc_sizes)
        self._blocks: dict[int, np.ndarray] = {}

    def _unpacked(self, at: int, size: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._read(at, size))

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ids of documents, whether each is known)."""
        at = self._docs_at + np.concatenate([[0], np.cumsum(self._doc_sizes)])
        starts, keys, known = (self._unpacked(int(a), int(s)) for a, s in zip(at, self._doc_sizes))
        return np.frombuffer(starts, "<i8"), np.frombuffer(keys, "<i8"), np.unpackbits(np.frombuffer(known, np.uint8), count=self.n_docs).astype(bool)

    def _block(self, level: int, number: int) -> np.ndarray:
        at = level * self.per_plane + number
        if at not in self._blocks:
            body = self._unpacked(self._blocks_at + int(self._ends[at]), int(self._ends[at + 1] - self._ends[at]))
            self._blocks[at] = np.frombuffer(body, np.uint8)
        return self._blocks[at]

    def ids(self) -> np.ndarray:
        """All ids in order: the planes are undone from the least significant up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = [self._block(level, b) for b in range(self.per_plane)]
            bit = np.unpackbits(np.concatenate(plane) if plane else np.zeros(0, np.uint8), count=self.n).astype(bool)
            above = np.empty(self.n, kind)
            above[~bit] = value[: self.zeros[level]]
            above[bit] = value[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            value = above
        return value

    def _ones_before(self, level: int, i: int) -> int:
        byte = i >> 3
        known = byte // RANK_BYTES
        ones, inside = int(self._ranks[level, known]), byte % BLOCK_BYTES
        if byte % RANK_BYTES == 0 and not i & 7:
            return ones
        block = self._block(level, byte // BLOCK_BYTES)
        ones += int(_ONES[block[inside - byte % RANK_BYTES : inside]].sum())
        return ones + (int(_ONES[block[inside] >> (8 - (i & 7))]) if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            byte = i >> 3
            bit = (int(self._block(level, byte // BLOCK_BYTES)[byte % BLOCK_BYTES]) >> (7 - (i & 7))) & 1
            ones = self._ones_before(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        low = 0
        for level in range(self.levels):
            if token >> (self.levels - 1 - level) & 1:
                low, i = (int(self.zeros[level]) + self._ones_before(level, x) for x in (low, i))
            else:
                low, i = (x - self._ones_before(level, x) for x in (low, i))
        return low, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before position i."""
        if token >> self.levels:
            return 0
        low, high = self._walk(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        low, high = self._walk(token, self.n) if not token >> self.levels else (0, 0)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            target = i - int(self.zeros[level]) if one else i
            a, b = 0, self.n - 1  # the least position whose bit is the target-th of its kind
            while a < b:
                m = (a + b) // 2
                ones = self._ones_before(level, m + 1)
                a, b = (a, m) if (ones if one else m + 1 - ones) > target else (m + 1, b)
            i = a
        return i


#: Texts are cut at single spaces. Around a space with white space on both sides, and at a text's ends, a tokenizer's piece can reach
#: over the space; such texts are encoded whole.
BLANK = r"[\s\x0b\x{85}\p{Z}\x1c-\x1f]"
UNCUT = f"{BLANK} {BLANK}|^ | $"
#: What one worker remembers of pieces: so many different ones, of up to so many bytes. More only cost time.
CACHE_PIECES, CACHE_PIECE_BYTES = 600_000, 32
#: Fresh pieces are encoded in texts of so many.
JOINED = 2000
ENCODE_BYTES = 8 << 20


class PieceEncoder:
    """Encodes texts through their space-separated pieces: each different piece of a batch is looked up or encoded once, and the ids of
    all texts are laid out by index arithmetic."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")  # the byte-level sign of a space
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of pieces that have a space before them, and the number of ids of each, both in parts. The pieces have no white space at
        their ends and are not empty; they are joined, as each then starts with a token that starts with a space, and no other does."""
        ids, sizes = [], []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            found = [self.whole([" " + " ".join(some)])[0]]
            cuts = np.flatnonzero(self.starts[found[0]])
            if len(cuts) != len(some):  # a vocabulary with a space inside a token
                found = self.whole([" " + p for p in some])
                cuts = np.cumsum([0, *map(len, found[:-1])])
            ids += found
            sizes.append(np.diff(np.append(cuts, sum(map(len, found)))))
        return ids, sizes

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces; those met for the first time are encoded and kept."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(at < 0).tolist()
        plain = [i for i in fresh if (p := pieces[i]) and not p[0].isspace() and not p[-1].isspace()]
        ids, sizes = self._spaced([pieces[i] for i in plain])
        if len(plain) < len(fresh):
            single = sorted(set(fresh).difference(plain))
            alone = self.whole([" " + pieces[i] for i in single])
            plain, ids, sizes = plain + single, ids + alone, [*sizes, np.array([*map(len, alone)])]
        if plain:
            numbers = range(len(self.ends) - 1, len(self.ends) - 1 + len(plain))
            self.flat = np.concatenate([self.flat, *ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
            at[plain] = numbers
            self.known.update((pieces[i], n) for i, n in zip(plain, numbers) if len(pieces[i]) <= CACHE_PIECE_BYTES)
        return at

    def encode(self, texts, end: int) -> list[np.ndarray]:
        """Ids of an Arrow array of texts, each with the end id."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.ends) > CACHE_PIECES:
            self.forget()
        tail = np.asarray([end], np.uint32)
        uncut = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False).astype(bool)
        slow = iter(self.whole(texts.filter(pa.array(uncut)).to_pylist()))
        rows = texts.filter(pa.array(~uncut))
        n = len(rows)
        lists = pc.split_pattern(rows, " ")
        lo = np.asarray(lists.offsets) - lists.offsets[0].as_py() if n else np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        number = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)] if n else np.zeros(0, np.int64)
        first = self.whole(coded.take(pa.array(lo[:-1])).to_pylist() if n else [])
        # elements: the pieces of the memory, then the first pieces, which have no space before them, then the end id
        pool = np.concatenate([self.flat, *first, tail])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([*map(len, first), 1], dtype=np.int64)])
        element = np.empty(len(number) + n, np.int64)
        row = np.repeat(np.arange(n), np.diff(lo))
        element[np.arange(len(number)) + row] = number
        begins = lo[:-1] + np.arange(n)
        element[begins] = len(self.ends) - 1 + np.arange(n)
        element[lo[1:] + np.arange(n)] = len(ends) - 2
        start, size = ends[element], ends[element + 1] - ends[element]
        out = np.cumsum(size)
        flat = pool[np.repeat(start - (out - size), size) + np.arange(out[-1] if n else 0)]
        fast = iter(np.split(flat, out[lo[1:] + np.arange(n)][:-1])) if n else iter(())
        return [np.append(next(slow), tail) if u else next(fast) for u in uncut]


_ENCODERS: dict[str, PieceEncoder] = {}


def encode_texts(texts, path: str, end: int) -> list[np.ndarray]:
    """Ids of whole texts (an Arrow array or a list) with the end id."""
    import pyarrow as pa

    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path].encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end)


def write_shards(docs: DataFrame, tokenizer: str, end: int, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard files of all documents in ascending key order (null keys first; ties by hash of the text, then by text): (part, seq,
    n_docs, n_tokens, file). A file closes after shard_tokens ids, so memory is bounded by that and the longest text. Null texts are
    ''. Bit-planes follow the tokenizer's vocabulary and the end id. The tokenizer file has to be readable on every executor under the
    given path. An empty table gives no files; other columns are ignored, whatever their names."""
    from tokenizers import Tokenizer

    levels = levels_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    # the hash deals the rows of one key, or of null keys, to several ranges
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t", F.spark_partition_id().alias("part"))

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        part, seq, held = 0, 0, 0

        def close():
            starts = np.cumsum([0, *map(len, ids)])[:-1]
            flat = np.concatenate(ids)
            blob = encode_shard(flat, starts, np.array([x or 0 for x in keys]), np.array([x is not None for x in keys]), levels)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()), "file": pa.array([blob], pa.binary())})

        for batch in batches:
            for piece in slices(batch, ["t"], most=ENCODE_BYTES):
                part = piece["part"][0].as_py()
                for k, e in zip(piece["k"].to_pylist(), encode_texts(piece["t"], tokenizer, end)):
                    ids.append(e)
                    keys.append(k)
                    held += len(e)
                    if held >= shard_tokens:
                        yield close()
                        seq, held = seq + 1, 0
                        ids.clear()
                        keys.clear()
        if ids:
            yield close()

    return rows.mapInArrow(shards, "part int, seq int, n_docs long, n_tokens long, file binary")


def save_shards(docs: DataFrame, path: str, tokenizer: str, end: int, **settings) -> DataFrame:
    """Writes the shard files as a table at `path`, which must not exist yet, and reads it back."""
    write_shards(docs, tokenizer, end, **settings).write.option("compression", "none").parquet(path)
    return load_shards(docs.sparkSession, path)


def load_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_docs long, n_tokens long, file binary").parquet(path)


def read_shards(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of shard files: (key, start, n_tokens, ids_crc32). start counts the ids of all documents before it, over all files;
    the running total takes one narrow row for each file."""
    def documents(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            for part, seq, blob in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["file"]):
                shard = WaveletShard(blob.as_py())
                ids = shard.ids().astype("<u4")
                starts, keys, known = shard.documents()
                ends = np.append(starts, shard.n)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(shard.n_docs, part, np.int32)), "seq": pa.array(np.full(shard.n_docs, seq, np.int32)),
                    "k": pa.array(keys, mask=~known), "own": pa.array(starts), "n": pa.array(np.diff(ends)),
                    "crc": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                })

    rows = files.select("part", "seq", "file").mapInArrow(documents, "part int, seq int, k long, own long, n long, crc long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("__in"))
    bases = bases.join(parts, F.col("part") == F.col("__part")).select("part", "seq", (F.col("__base") + F.col("__in")).alias("__before"))
    return rows.join(bases, ["part", "seq"]).select(
        F.col("k").alias(key), (F.col("__before") + F.col("own")).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def token_report(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes shard files to `path`, or to the shared folder for the time of the run, and reports each document as read back from them.
    Every row is answered, repeated ones too; null texts have the end id only; an empty table gives no rows; other columns are
    ignored, whatever their names."""
    if path:
        return read_shards(save_shards(docs, path, tokenizer, end, key=key, text=text), key)
    return read_shards(materialise(write_shards(docs, tokenizer, end, key=key, text=text), "shards"), key)
