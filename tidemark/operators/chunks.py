"""Path-dependent recursions over time chunks of a series.

A series is cut into chunks by a fixed span of time, and within it after so many rows, so that no task needs a whole series. What a chunk does to the state
that enters it is a small value; those of one series are composed in order (one row a chunk), and each chunk is then worked through
from the state that enters it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: Rows of a chunk at most, and seconds of its span of time.
ROWS, SPAN = 4096, 90 * 86_400
#: How far back what enters a chunk is composed, and the greatest decay within a chunk, as logarithms: e**-(FAR - DECAY) is nothing beside a
#: double.
FAR, DECAY = 361, 300.0
CHUNK = ["pair", "__bucket", "__part"]


def chunked(rows: DataFrame, length: int = ROWS, span: int = SPAN) -> DataFrame:
    """Rows with their chunk (__bucket, __part) and their place in it (__q)."""
    stamp = F.unix_timestamp("ts") if rows.schema["ts"].dataType.simpleString().startswith(("timestamp", "date")) else F.col("ts").cast("long")
    rows = rows.withColumn("__bucket", F.floor(stamp / span))
    n = F.row_number().over(W.partitionBy("pair", "__bucket").orderBy("ts")) - 1
    return rows.withColumn("__n", n).withColumns({"__part": F.floor(F.col("__n") / length), "__q": F.col("__n") % length}).drop("__n")


def _in_order():
    return W.partitionBy("pair").orderBy("__bucket", "__part")


def running_sum(rows: DataFrame, x: str, out: str, length: int = ROWS, span: int = SPAN) -> DataFrame:
    """Rows (pair, ts, ..) with the sum of x up to each row: within chunks, plus the sums of the chunks before."""
    held = chunked(rows, length, span)
    totals = held.groupBy(CHUNK).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("__own"))
    before = F.coalesce(F.sum("__own").over(_in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    held = held.join(totals.select(*CHUNK, before.alias("__before")), CHUNK)
    inside = F.coalesce(F.sum(x).over(W.partitionBy(CHUNK).orderBy("__q").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    return held.withColumn(out, F.col("__before") + inside).select(*rows.columns, out)


def numbered(rows: DataFrame, out: str = "i", length: int = ROWS, span: int = SPAN) -> DataFrame:
    """Rows (pair, ts, ..) with their number in their series, from 0: their place in a chunk, plus the rows of the chunks before."""
    held = chunked(rows, length, span)
    sizes = held.groupBy(CHUNK).agg(F.count("*").alias("__size"))
    start = F.coalesce(F.sum("__size").over(_in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.join(sizes.select(*CHUNK, start.alias("__start")), CHUNK).withColumn(out, F.col("__start") + F.col("__q")).select(*rows.columns, out)


def recursive_means(rows: DataFrame, spans: dict[str, tuple[str, float, int]], length: int = ROWS, span: int = SPAN) -> DataFrame:
    """Rows (pair, ts, ..) with recursive means {out: (column, alpha, least observations)}: y = (1 - alpha) * y before + alpha * x, started by
    the first value. Null (or NaN) values repeat y; the next value weighs as if y had decayed over them. Null until there are so many
    values.

    A step is the map y -> A * y + B, and so is a chunk: within it, y is the product of the factors so far times (what enters + the sum
    of B over the products), which are windows over the chunk. What enters is composed from the chunks before, as far back as
    their product still counts in a double."""
    slow = {out: s for out, s in spans.items() if s[1] < 1}
    if slow:
        length = min([length, *(max(1, int(DECAY / -math.log1p(-a))) for _, a, _ in slow.values())])
    columns = sorted({c for c, _, _ in spans.values()})
    name = {c: f"__{i}" for i, c in enumerate(columns)}
    x = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    held = chunked(rows, length, span).withColumns({name[c]: x[c] for c in columns})

    # rows, values and the last value's place of the chunks before
    table = held.groupBy(CHUNK).agg(F.count("*").alias("n"), *(e for i in name.values() for e in (F.count(i).alias(f"{i}k"), F.max(F.when(F.col(i).isNotNull(), F.col("__q"))).alias(f"{i}z"))))
    before = _in_order().rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = {f"{i}seen": F.coalesce(F.sum(f"{i}k").over(before), F.lit(0)) for i in name.values()} | {f"{i}last": F.last(F.col("__start") + F.col(f"{i}z"), True).over(before) for i in name.values()}
    table = table.withColumns(carried).select(*CHUNK, "__start", *carried)
    held = held.join(table, CHUNK)

    w = W.partitionBy(CHUNK).orderBy("__q")
    upto, past = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    at = F.col("__start") + F.col("__q")
    gaps = {f"{i}gap": at - F.coalesce(F.last(F.when(F.col(i).isNotNull(), at), True).over(past), F.col(f"{i}last")) for i in name.values()}
    held = held.withColumns(gaps | {f"{i}now": F.col(f"{i}seen") + F.count(i).over(upto) for i in name.values()})

    def log_factor(i: str, a: float) -> Column:
        gap, rest = F.col(f"{i}gap"), math.log1p(-a)
        far = F.greatest(gap * rest - F.log(F.exp(gap * rest) + a), F.lit(-DECAY))
        return F.when(F.col(i).isNull() | gap.isNull(), 0.0).when(gap == 1, rest).otherwise(far)

    def added(i: str, a: float) -> Column:
        gap = F.col(f"{i}gap")
        share = F.when(gap.isNull(), 1.0).when(gap == 1, a).otherwise(a / (F.exp(gap * math.log1p(-a)) + a))
        return F.coalesce(F.col(i) * share, F.lit(0.0))

    outs = {out: (f"__y{j}", name[c], a) for j, (out, (c, a, _)) in enumerate(slow.items())}
    held = held.withColumns({f"{y}s": F.sum(log_factor(i, a)).over(upto) for y, i, a in outs.values()})
    held = held.withColumns({f"{y}u": F.sum(added(i, a) * F.exp(-F.col(f"{y}s"))).over(upto) for y, i, a in outs.values()})
    if outs:
        ends = held.groupBy(CHUNK).agg(*(F.max_by(F.struct(F.col(f"{y}s").alias("s"), F.col(f"{y}u").alias("u")), "__q").alias(y) for y, _, _ in outs.values()))
        ends = ends.withColumn("__ord", F.row_number().over(_in_order()))
        for y, _, _ in outs.values():
            step = F.struct("__ord", F.col(f"{y}.s").alias("s"), (F.exp(F.col(f"{y}.s")) * F.col(f"{y}.u")).alias("b"))
            ends = ends.withColumn(f"{y}d", F.floor(-F.sum(f"{y}.s").over(_in_order()))).withColumn(f"{y}e", step)
        for y, _, _ in outs.values():
            # chunks further back than that add nothing; the decay so far orders the chunks of a series
            near = F.collect_list(f"{y}e").over(W.partitionBy("pair").orderBy(f"{y}d").rangeBetween(-FAR, 0))
            earlier = F.array_sort(F.filter(near, lambda e: e["__ord"] < F.col("__ord")))
            ends = ends.withColumn(f"{y}in", F.aggregate(earlier, F.lit(0.0), lambda v, e: F.exp(e["s"]) * v + e["b"]))
        held = held.join(ends.select(*CHUNK, *(f"{y}in" for y, _, _ in outs.values())), CHUNK)
    values = {out: F.when(F.col(f"{i}now") >= spans[out][2], F.exp(F.col(f"{y}s")) * (F.col(f"{y}in") + F.col(f"{y}u"))) for out, (y, i, _) in outs.items()}
    for out, (c, a, least) in spans.items():
        if a >= 1:  # the last value itself
            values[out] = F.when(F.col(f"{name[c]}now") >= least, F.last(name[c], True).over(W.partitionBy("pair").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)))
    return held.withColumns(values).select(*rows.columns, *[o for o in spans if o not in rows.columns])


def automaton(rows: DataFrame, x: str, states: int, step, out: str, length: int = ROWS, span: int = SPAN) -> DataFrame:
    """(pair, ts, x, out): a machine of `states` states, walked along each series from state 0. step(state, x) -> (state, number).

    A chunk is a map from the state that enters to the one that leaves; runs from different states that meet go on as one. The maps
    of a series are composed in order, and each chunk is walked once from the state that enters it."""
    held = chunked(rows.select("pair", "ts", F.col(x).cast("double").alias(x)), length, span)

    def end_states(key, table):
        import pyarrow as pa

        runs = {s: [s] for s in range(states)}
        for v in table.sort_by("__q")[x].to_pylist():
            met: dict[int, list[int]] = {}
            for s, starts in runs.items():
                met.setdefault(step(s, v)[0], []).extend(starts)
            runs = met
        ends = [0] * states
        for s, starts in runs.items():
            for k in starts:
                ends[k] = s
        return pa.table({"pair": [key[0].as_py()], "__bucket": pa.array([key[1].as_py()], pa.int64()), "__part": pa.array([key[2].as_py()], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int32()))})

    def composed(key, table):
        import pyarrow as pa

        table, state, entering = table.sort_by([("__bucket", "ascending"), ("__part", "ascending")]), 0, []
        for ends in table["ends"].to_pylist():
            entering.append(state)
            state = ends[state]
        return table.drop(["ends"]).append_column("entering", pa.array(entering, pa.int32()))

    def walk(key, table):
        import pyarrow as pa

        table = table.sort_by("__q")
        state, values = table["entering"][0].as_py(), []
        for v in table[x].to_pylist():
            state, value = step(state, v)
            values.append(value)
        return table.select(["pair", "ts", x]).append_column(out, pa.array(values, pa.float64()))

    maps = held.groupBy(CHUNK).applyInArrow(end_states, "pair string, __bucket long, __part long, ends array<int>")
    starts = maps.groupBy("pair").applyInArrow(composed, "pair string, __bucket long, __part long, entering int")
    kind = rows.schema["ts"].dataType.simpleString()
    return held.join(starts, CHUNK).groupBy(CHUNK).applyInArrow(walk, f"pair string, ts {kind}, `{x}` double, `{out}` double")
