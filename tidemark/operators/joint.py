"""Joint resampling tests, split by series.

All series are resampled with the same rows. A draw's rows follow from the seed and the number of the draw alone, so tasks that hold different
series make the same ones and nothing has to be handed around: each task takes one block of series and a run of draws and returns one small
row a draw; the rows of a draw are then put together. No row or task holds all times of all series.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.joins import common_times
from tidemark.operators.statistics import CHUNK, block_length, block_lengths, resampled, series_arrays

#: Bytes of the values of one block of series, about.
BLOCK_BYTES = 4 << 20


def draw_rows(tag: str, n: int, length: float) -> np.ndarray:
    """Row numbers of one circular resample of n rows, from the md5 of the tag."""
    u = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.md5(tag.encode()).digest()))).random((2, n))
    return resampled(u[0], u[1], length)


def hac_errors(x: np.ndarray, bandwidth: int) -> np.ndarray:
    """Newey-West standard errors of the means of the columns of x."""
    n = len(x)
    e = x - x.mean(axis=0)
    total = (e * e).sum(axis=0) / n
    for k in range(1, min(max(bandwidth, 1), n - 1) + 1):
        total += 2 * (1 - k / (max(bandwidth, 1) + 1)) * (e[k:] * e[:-k]).sum(axis=0) / n
    return np.maximum(np.sqrt(np.maximum(total, 1e-12) / n), 1e-12)


# ---- reality check ---------------------------------------------------------------------------------------------------------------


def column_blocks(rows: DataFrame, x: str, n: int, k: int, block_bytes: int) -> DataFrame:
    """(series, body) of k series of n values each: some of them in one row, side by side."""
    blocks = max(1, -(-8 * n * k // block_bytes))

    def pack(key, table):
        import pyarrow as pa

        table = table.sort_by("pair")
        held = np.concatenate([np.asarray(v.values, "<f8") for v in table["x"].combine_chunks()])
        return pa.table({"series": pa.array([table.num_rows], pa.int32()), "body": [held.tobytes()]})

    arrays = series_arrays(rows, x).withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(blocks)))
    return arrays.groupBy("block").applyInArrow(pack, "series int, body binary")


def greatest(x: np.ndarray, draws: range, length: float, seed: int) -> list[tuple]:
    """(draw, consistent, lower, upper, plain): greatest statistics over the columns of x in joint circular resamples of its rows. Means are
    recentred at their positive parts, at themselves and at 0, in standard errors of the resample; plain is recentred at themselves
    without errors. Draw -1 is x itself: (studentised, .., .., plain), not recentred."""
    n, mean, root = len(x), x.mean(axis=0), math.sqrt(len(x))
    width = max(int(length) - 1, 1)
    out = []
    for draw in draws:
        if draw < 0:
            t = float((root * mean / hac_errors(x, width)).max())
            out.append((draw, t, t, t, float((root * mean).max())))
            continue
        y = x[draw_rows(f"{seed}|spa|{draw}", n, length)]
        m, error = y.mean(axis=0), hac_errors(y, width)
        out.append((draw, *(float((root * (m - c) / error).max()) for c in (np.maximum(mean, 0), mean, 0.0)), float((root * (m - mean)).max())))
    return out


def reality_check(rows: DataFrame, n: int, length: float | None = None, seed: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(series, observations, length, t_spa, t_plain, p_consistent, p_lower, p_upper, p_plain) of the best of all series (pair, ts, ret) at the
    times that all share; other times are left out, never filled. length: by default the greatest automatic one. Series lie in blocks of
    about block_bytes; every task takes one block and CHUNK draws and returns the greatest statistics of its series in each, which a
    maximum over the blocks joins. Without series, or with fewer than 2 shared times, no rows."""
    held = rows.where("ret is not null").select("pair", "ts", "ret")
    k = held.select("pair").distinct().count()
    shared = common_times(held, k)
    observations = shared.select("ts").distinct().count()
    if not k or observations < 2:
        return rows.sparkSession.createDataFrame([], "series long, observations long, length double, t_spa double, t_plain double, p_consistent double, p_lower double, p_upper double, p_plain double")
    if length is None:
        length = float(max(1, math.ceil(block_lengths(shared).agg(F.max("length")).first()[0] or 1)))
    chunks = -(-n // CHUNK)
    blocks = column_blocks(shared, "ret", observations, k, block_bytes).withColumn("chunk", F.explode(F.sequence(F.lit(-1), F.lit(chunks - 1))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for series, body, chunk in zip(batch["series"].to_pylist(), batch["body"], batch["chunk"].to_pylist()):
                x = np.frombuffer(body.as_buffer(), "<f8").reshape(series, -1).T
                draws = range(-1, 0) if chunk < 0 else range(chunk * CHUNK, min(n, (chunk + 1) * CHUNK))
                out = greatest(x, draws, length, seed)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*zip(*out), [series] * len(out))], names=["draw", "c", "l", "u", "w", "series"])

    parts = blocks.repartition(max(1, chunks), F.xxhash64("body"), "chunk").mapInArrow(run, "draw bigint, c double, l double, u double, w double, series bigint")
    drawn = parts.groupBy("draw").agg(*(F.max(c).alias(c) for c in "cluw"), F.sum("series").alias("series"))

    def p(x: str, t: str) -> Column:
        return (1 + F.count_if((F.col("draw") >= 0) & (F.col(x) >= F.col(t)))) / (n + 1)

    seen = {"t_spa": F.max(F.when(F.col("draw") < 0, F.col("c"))), "t_plain": F.max(F.when(F.col("draw") < 0, F.col("w")))}
    lists = drawn.agg(F.max("series").alias("series"), *(v.alias(c) for c, v in seen.items()))  # one row
    both = drawn.drop("series").crossJoin(F.broadcast(lists))
    return both.groupBy("series", "t_spa", "t_plain").agg(
        F.lit(observations).cast("long").alias("observations"), F.lit(length).alias("length"), p("c", "t_spa").alias("p_consistent"), p("l", "t_spa").alias("p_lower"), p("u", "t_spa").alias("p_upper"), p("w", "t_plain").alias("p_plain")
    ).select("series", "observations", "length", "t_spa", "t_plain", "p_consistent", "p_lower", "p_upper", "p_plain")


# ---- groups with blocks of their own ---------------------------------------------------------------------------------------------


def summed_up(z: np.ndarray, width: int) -> tuple:
    """What a run of values adds to the Newey-West error of a longer one that it is part of: its size, its sum, its lagged products up to
    `width`, and its first and last `width` values."""
    lags = range(min(width, len(z) - 1) + 1) if len(z) else range(0)
    products = np.zeros(width + 1)
    products[: len(lags)] = [z[k:] @ z[: len(z) - k] for k in lags]
    return len(z), float(z.sum()), products, z[:width], z[max(0, len(z) - width) :]


def put_together(a: tuple, b: tuple, width: int) -> tuple:
    """summed_up() of two runs, one after the other: products across the border come from the end of one and the start of the other."""
    tail, head = a[4], b[3]
    products = a[2] + b[2]
    for k in range(1, width + 1):
        here = tail[max(0, len(tail) - k) :]  # value i of these is k before value k - len(here) + i of what follows
        follow = head[k - len(here) : k] if len(here) <= k else head[:0]
        products[k] += here[: len(follow)] @ follow
    return a[0] + b[0], a[1] + b[1], products, np.concatenate([a[3], b[3]])[:width], np.concatenate([a[4], b[4]])[-width:]


def mean_and_error(s: tuple, width: int) -> tuple[float, float]:
    """Mean and its Newey-West error, of summed_up()."""
    n, total, products, head, tail = s
    m = total / n
    at = np.arange(min(width, n - 1) + 1)
    first, last = np.concatenate([[0.0], np.cumsum(head)])[at], np.concatenate([[0.0], np.cumsum(tail[::-1])])[at]
    cov = products[at] - m * (total - last) - m * (total - first) + (n - at) * m * m
    level = (cov[0] + 2 * ((1 - at[1:] / (width + 1)) * cov[1:]).sum()) / n
    return m, max(math.sqrt(max(level, 1e-12) / n), 1e-12)


def blocked_bootstrap(returns: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(events, t, p) of event returns (bank, ts, y): the studentised mean of all against n resamples within each bank, in blocks of the
    bank's own automatic length, less the mean of all. A task takes one bank and CHUNK draws; per draw it returns what the bank adds to
    the pooled error, and the banks of a draw are put together in order of their names. Without events no rows."""
    events = returns.where("y is not null").select("bank", "ts", "y")
    lengths = block_lengths(events.select(F.col("bank").alias("pair"), "ts", F.col("y").alias("ret")))
    width = max(math.ceil(lengths.agg(F.max("length")).first()[0] or 1) - 1, 1)
    chunks = -(-n // CHUNK)
    dealt = series_arrays(events, "y", "bank").withColumn("chunk", F.explode(F.sequence(F.lit(-1), F.lit(chunks - 1)))).repartition(max(1, chunks), "bank", "chunk")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        listed = pa.list_(pa.float64())
        for batch in batches:
            for bank, x, chunk in zip(batch["bank"].to_pylist(), batch["x"], batch["chunk"].to_pylist()):
                y = np.asarray(x.values, float)
                length = max(1, math.ceil(block_length(y))) if len(y) > 1 else 1
                draws = [-1] if chunk < 0 else range(chunk * CHUNK, min(n, (chunk + 1) * CHUNK))
                out = [(d, bank, *summed_up(y if d < 0 else y[draw_rows(f"{seed}|{bank}|{d}", len(y), length)], width)) for d in draws]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), listed, listed, listed]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["draw", "bank", "n", "total", "products", "head", "tail"])

    def join(key, table):
        import pyarrow as pa

        totals: dict[int, tuple] = {}
        for r in table.sort_by([("draw", "ascending"), ("bank", "ascending")]).to_pylist():
            part = (r["n"], r["total"], *(np.array(r[c]) for c in ("products", "head", "tail")))
            totals[r["draw"]] = put_together(totals[r["draw"]], part, width) if r["draw"] in totals else part
        found = [(t[0], *mean_and_error(t, width)) for t in totals.values()]
        return pa.table({"draw": pa.array(list(totals), pa.int64()), **{k: pa.array(c) for k, c in zip(("events", "mean", "error"), zip(*found))}})

    parts = dealt.mapInArrow(run, "draw bigint, bank string, n bigint, total double, products array<double>, head array<double>, tail array<double>")
    drawn = parts.withColumn("some", F.floor(F.col("draw") / CHUNK)).groupBy("some").applyInArrow(join, "draw bigint, events bigint, mean double, error double")
    # one struct for draw -1, all events as they are; the others are counted against it
    seen = F.max(F.when(F.col("draw") < 0, F.struct("events", "mean", "error"))).alias("s")
    rest = F.collect_list(F.when(F.col("draw") >= 0, F.struct("mean", "error"))).alias("r")  # n pairs of numbers
    root = F.sqrt("s.events")
    t = root * F.col("s.mean") / F.col("s.error")
    beyond = F.size(F.filter("r", lambda d: root * (d["mean"] - F.col("s.mean")) / d["error"] >= t))
    return drawn.agg(seen, rest).where("s is not null").select("s.events", t.alias("t"), ((1 + beyond) / (n + 1)).alias("p"))
