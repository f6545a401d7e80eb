"""Quality classifier: a factorisation machine over hashed words and structure statistics, scored in linear time.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]).
It is fitted on a bounded sample of labelled documents (SAMPLE rows, drawn by hash of the key); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import row_of, slices, text_bytes, word_hashes

BUCKETS, FACTORS, SAMPLE, STEPS = 1024, 6, 6000, 150

# classes of bytes: 0 other letters, 1 upper case, 2 lower case, 3 digit, 4 blank, 5 line end, 6 stop, 7 comma and such, 8 mark
_CLASS = np.full(256, 8, np.uint8)
_CLASS[128:], _CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[46, 63]], _CLASS[[44, 59, 58, 39, 45]] = 4, 5, 6, 7
N_STATS = 15


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string column: (n, N_STATS) statistics, and the distinct words' buckets with their rows."""
    data, offsets = text_bytes(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    row = row_of(size)
    kinds = np.bincount(row * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9) if len(data) else np.zeros((n, 9), np.int64)
    words, counts = word_hashes(data, offsets)
    at = row_of(counts)
    again = np.zeros(n)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
        again = np.bincount(at[1:][same], minlength=n)
    order = np.lexsort((words, at))
    words, at = words[order], at[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, at[first], np.diff(np.append(first, len(words))))
    distinct = np.bincount(at[first], minlength=n)
    w, b = np.maximum(counts, 1), np.maximum(size, 1)
    stats = np.column_stack([
        kinds[:, [0, 1, 3, 5, 6, 7, 8]] / b[:, None], np.log1p(kinds[:, 8]), distinct / w, again / w, most / w, np.log1p(size), np.log1p(counts), size / w, kinds[:, 1] / np.maximum(kinds[:, 2], 1),
    ])
    return np.nan_to_num(stats), (words[first] % np.uint64(BUCKETS)).astype(np.int64), at[first]


class FactorisationMachine:
    """Weights over BUCKETS words (value 1/sqrt of the text's distinct words) and standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.mean, self.scale, self.w0, self.w, self.v = mean, scale, w0, w, v

    def raw(self, stats: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        n = len(stats)
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
        total = self.w0 + x @ self.w[BUCKETS:] + np.bincount(row, self.w[bucket] * value, n)
        for f in range(self.v.shape[1]):
            words, own = self.v[:BUCKETS, f], self.v[BUCKETS:, f]
            s = np.bincount(row, words[bucket] * value, n) + x @ own
            q = np.bincount(row, (words[bucket] * value) ** 2, n) + (x * x) @ (own * own)
            total += 0.5 * (s * s - q)
        return total

    def score(self, stats: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(stats, bucket, row), -40, 40)))


def fit(stats: np.ndarray, buckets: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> FactorisationMachine:
    """Full-batch Adam on the logistic loss with a small ridge; classes keep their shares. Without both labels the score is constant."""
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2)
    n_stats = stats.shape[1]
    d = BUCKETS + n_stats
    if n == 0 or labels.min() == labels.max():
        return FactorisationMachine(np.zeros(n_stats), np.ones(n_stats), float(np.log(share / (1 - share))), np.zeros(d), np.zeros((d, FACTORS)))
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    x = np.zeros((n, d), np.float32)
    for i, b in enumerate(buckets):
        np.add.at(x[i], b, 1 / np.sqrt(max(len(b), 1)))
    x[:, BUCKETS:] = np.clip((stats - mean) / scale, -5, 5)
    squares = x * x
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(d), rng.normal(0, 0.02, (d, FACTORS))]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1):
        w0, w, v = (p.astype(np.float32) for p in params)
        s = x @ v
        z = w0 + x @ w + 0.5 * ((s * s).sum(axis=1) - squares @ (v * v).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels).astype(np.float32) / n
        grads = [np.array([g.sum()]), x.T @ g + 1e-4 * w, x.T @ (g[:, None] * s) - v * (squares.T @ g)[:, None] + 1e-3 * v]
        for p, m, u, gr in zip(params, first, second, grads):
            m *= 0.9
            m += 0.1 * gr
            u *= 0.999
            u += 0.001 * gr * gr
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(mean, scale, float(params[0][0]), params[1], params[2])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, seen, rows: int, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ()) -> DataFrame:
    """At most `rows` labelled documents (k, text, label, then the input's other columns under `meta`) whose key passes `seen`, drawn by hash
    of the key; k is that hash, so keys may be of any type. Keys without a label, null keys and keys with clashing labels teach nothing; of
    documents of one key the least text counts."""
    known = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__label")).where(F.col("__k").isNotNull() & F.col("__label").isNotNull() & seen(F.col("__k")))
    known = known.groupBy("__k").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most").drop("__most")
    named = known.join(docs.select(F.col(key).alias("__k")).distinct(), "__k", "left_semi")
    drawn = named.orderBy(F.xxhash64("__k"), "__k").limit(rows)
    out = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(meta)]).join(F.broadcast(drawn), "__k")
    first = F.min(F.struct("text", *[f"m{i}" for i in range(len(meta))])).alias("d")
    return out.groupBy("__k").agg(first, F.first("__label").alias("label")).select(F.xxhash64("__k").alias("k"), "d.*", "label")


def _with_meta(stats: np.ndarray, batch, n_meta: int) -> np.ndarray:
    """stats and, for each metadata column, the logarithm of its size (0 for null and NaN)."""
    extra = [np.log1p(np.abs(np.nan_to_num(batch[f"m{i}"].cast("float64").to_numpy(zero_copy_only=False), posinf=0, neginf=0))) for i in range(n_meta)]
    return np.column_stack([stats, *extra])


def train(docs: DataFrame, labels: DataFrame, seen, rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality", meta: tuple[str, ...] = ()) -> FactorisationMachine:
    """Fits on labelled_sample(). meta: numeric columns of docs that are inputs beside the words and statistics of the text."""
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"]):
                stats, bucket, row = features(batch["text"])
                stats = _with_meta(stats, batch, len(meta))
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(stats)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["k"], batch["label"], pa.array([x.tobytes() for x in stats]), pa.array([bucket[a:b].astype(np.int16).tobytes() for a, b in zip(ends[:-1], ends[1:])])], names=["k", "label", "stats", "words"]
                )

    sample = labelled_sample(docs, labels, label, seen, rows, key, text, meta)
    found = sorted(sample.mapInArrow(cut, "k long, label int, stats binary, words binary").collect())
    stats = np.array([np.frombuffer(r["stats"]) for r in found]).reshape(len(found), N_STATS + len(meta))
    return fit(stats, [np.frombuffer(r["words"], np.int16).astype(np.int64) for r in found], np.array([r["label"] for r in found], np.float64))


def score_quality(docs: DataFrame, model: FactorisationMachine, held_out: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.7, meta: tuple[str, ...] = ()) -> DataFrame:
    """(key, held_out, score, predicted) of every row. Null texts are scored as ''; null metadata as 0. Repeated rows are answered one by
    one; an empty table gives no rows; other columns are ignored, whatever their names."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["t"]):
                stats, bucket, row = features(batch["t"])
                score = model.score(_with_meta(stats, batch, len(meta)), bucket, row)
                yield pa.RecordBatch.from_arrays([batch["k"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["k", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col(key).alias("k"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(meta)]
    )
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, held_out boolean, score double, predicted int").withColumnRenamed("k", key)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(key.cast("string")) % folds
