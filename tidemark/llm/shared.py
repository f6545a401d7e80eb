"""What the operators of this subpackage share: materialised steps, canonical word rules, vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Separators of words: every ASCII character that is not a digit or a lower-case letter (A-Z are lower-cased first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (tests), and
    an error on a cluster, whose executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a step as Parquet in the shared folder and reads it back: lineage ends there, so a lost executor costs only the
    running step. The files go when the driver's JVM ends; shuffle files of finished steps are released at once."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._step = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return out


def release(*steps: DataFrame) -> None:
    """Deletes steps that no later step reads; what was made of them is written already."""
    for step in steps:
        step._step.getFileSystem(step.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(step._step, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names of columns to work with: the wanted ones, with underscores before those that are taken."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Array of the words of a text: A-Z lower-cased, ASCII other than letters and digits separates. Null and '' give []."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def text_key(text: Column) -> Column:
    """16-byte key of a text's content; null has the key of ''."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# ---- vectorised hashing of a batch of texts (Arrow buffers) -------------------------------------------------------------

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A pseudo-random 64-bit value for each byte; lower-casing and separators are folded into WORD_BYTE (0: separator).
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_at = np.arange(256)
_low = np.where((_at >= 65) & (_at <= 90), _at + 32, _at)
_is_word = ((_low >= 48) & (_low <= 57)) | ((_low >= 97) & (_low <= 122)) | (_low >= 128)
WORD_BYTE = np.where(_is_word, BYTE[_low], np.uint64(0))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (bytes, offsets); nulls are empty."""
    import pyarrow as pa

    big = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(big.buffers()[1], dtype=np.int64)[big.offset : big.offset + len(big) + 1]
    data = big.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch of texts, in order, and the number of words of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    value = WORD_BYTE[data]
    inside = value != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    # a word's hash: sum over its bytes of what byte and place in the word are mixed to; separators add 0. Not a polynomial: modulo 2**64
    # those agree on structured words whatever their base
    value = value[starts[0] :]
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    mixed = np.where(value != 0, mix(value + place.astype(np.uint64) * _GOLDEN), np.uint64(0))
    return mix(np.add.reduceat(mixed, starts - starts[0])), counts


_STEP, _TABLE = 0xD6E8FEB86659FD93, 1 << 16


def _accumulated(step: int) -> np.ndarray:
    steps = np.full(_TABLE, np.uint64(step))
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOW, _HIGH = _accumulated(_STEP), _accumulated(pow(_STEP, _TABLE, 1 << 64))


def powers(place: np.ndarray) -> np.ndarray:
    """The odd constant to the power of each place, below 2**32, modulo 2**64."""
    out = _LOW[place & (_TABLE - 1)]
    far = np.flatnonzero(place >= _TABLE)
    out[far] *= _HIGH[place[far] >> 16]
    return out


def row_of(counts: np.ndarray) -> np.ndarray:
    """The row number of each element, from the number of elements of each row."""
    return np.repeat(np.arange(len(counts)), counts)


#: Texts are taken from Arrow batches in slices of about so many bytes, which bounds what numpy holds for a task.
SLICE_BYTES = 2 << 20


def slices(batch, columns: list[str], size: str | None = None, most: int = SLICE_BYTES):
    """Parts of a record batch whose texts in `columns` have about `most` bytes together, one row at least. size: a column that holds
    the bytes of each row instead."""
    import pyarrow.compute as pc

    sizes = batch[size].to_numpy() if size else sum(pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shingles(column, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of word k-grams of an Arrow string column: (row, hash, count) in order of row. A text with fewer than k words, but
    not none, is one shingle."""
    hashes, counts = word_hashes(*text_bytes(column))
    rows = row_of(counts)
    if not len(hashes):
        return rows, hashes, np.zeros(0, np.int64)
    # place of each word counted back from the end of its text
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
    gram = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        shifted = hashes[j:] if j else hashes
        part = mix(shifted + np.array([j + 1], np.uint64) * _GOLDEN)
        ok = left[: len(part)] > j
        gram[: len(part)] += np.where(ok, part, np.uint64(0))
    starts = np.cumsum(counts) - counts
    first = np.zeros(len(hashes), bool)
    first[starts[counts > 0]] = True
    gram, rows = gram[keep := (left >= k) | first], rows[keep]
    order = np.lexsort((gram, rows))
    gram, rows = mix(gram[order]), rows[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], gram[at], np.diff(np.append(at, len(gram)))
