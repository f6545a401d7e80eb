"""Streaming twins of batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window as W

from tidemark.functions.shipping import ship


def tick_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def live_bars(ticks: DataFrame, unit: str = "hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (pair, ts, mid, ask_vol, spread_pips, seq), each sent once, when the watermark has passed its end."""
    at = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("pair", F.window("ts", f"1 {unit}").alias("w")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.coalesce(F.sum("ask_vol"), F.lit(0.0)).alias("volume"),
    )
    return bars.select("pair", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def first_bars(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Keeps the first bar of each (pair, ts); repeats within the watermark go."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pair", "ts"])


def run_to_end(stream: DataFrame, folder: str) -> None:
    """Works through all that is there and writes Parquet to folder/out; a restart goes on from folder/state, so no row is written twice."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


#: Rows of a sorted run, of a block in which it is read back, and of a frame that is sent.
RUN, BLOCK, SENT = 100_000, 1_000, 10_000


def ordered(batches, order: str, run: int = RUN, block: int = BLOCK):
    """The rows of pandas frames, as named tuples in order; equal ones as they came, nulls last. In memory are one run of rows and one block of
    each run: sorted runs wait in a file of Spark's local folder that has no name and goes with the task."""
    import heapq
    import os
    import pickle
    import tempfile

    import pandas as pd

    def rank(row):
        at = getattr(row, order)
        return at != at, at

    def arranged():
        frame = pd.concat(held).sort_values(order, kind="stable")
        held.clear()
        return frame

    def put(frame):
        for i in range(0, len(frame), block):
            yield file.tell()
            pickle.dump(frame.iloc[i : i + block], file)

    def read(places):
        for place in places:
            file.seek(place)
            yield from pickle.load(file).itertuples(index=False)

    runs, held = [], []
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= run:
                runs.append(list(put(arranged())))
        rest = [arranged().itertuples(index=False)] if held else []
        yield from heapq.merge(*map(read, runs), *rest, key=rank)


def walked(rows: DataFrame, key: str, order: str, made: dict[str, str], kept: dict[str, str], step) -> DataFrame:
    """A stateful stream: the rows of each key in order, each with the columns `made`. step(state, row) -> (state, values); state is a dict of
    `kept` (None at first), values None drops the row. The state is kept with the query's checkpoint, so a restart goes on from it. However
    many rows of a key a micro-batch has, they are sorted outside memory and sent on in frames of SENT rows."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = rows.columns

    def run(_, batches, state):
        import pandas as pd

        held, out = dict(zip(kept, state.get)) if state.exists else None, []
        for row in ordered(batches, order):
            held, values = step(held, row)
            if values is not None:
                out.append((*row, *values))
            if len(out) == SENT:
                yield pd.DataFrame(out, columns=[*names, *made])
                out = []
        state.update(tuple(held[c] for c in kept))
        yield pd.DataFrame(out, columns=[*names, *made])

    ship(rows.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{c}` {t}" for c, t in made.items()])
    return rows.groupBy(key).applyInPandasWithState(run, schema, ", ".join(f"{c} {t}" for c, t in kept.items()), "append", GroupStateTimeout.NoTimeout)


def _rungs(rows: DataFrame, levels: tuple[float, ...], sizes: tuple[float, ...]) -> DataFrame:
    """Level and size of rows with a drawdown; without one, neither."""
    level = F.when(F.col("drawdown").isNotNull(), sum(((F.col("drawdown") >= x).cast("int") for x in levels), F.lit(0)))
    return rows.withColumn("level", level).withColumn("size", F.get(F.array(*map(F.lit, sizes)), F.col("level")))


LADDER, LADDER_SIZES = (0.10, 0.15, 0.20), (1.0, 1.0, 0.5, 0.0)


def _drawn(rows: DataFrame, levels: tuple[float, ...], sizes: tuple[float, ...]) -> DataFrame:
    from tidemark.operators.signals import clip

    return _rungs(rows.withColumn("drawdown", F.coalesce(clip(1 - F.col("equity") / F.col("peak"), 0.0, 1.0), F.lit(0.0))), levels, sizes)


def ladder(rows: DataFrame, levels: tuple[float, ...] = LADDER, sizes: tuple[float, ...] = LADDER_SIZES) -> DataFrame:
    """Rows (pair, ts, equity, is_mock) with peak, drawdown, level and size: at the first level no new positions are opened, at the second
    they are halved, at the third flat. Mock rows never raise the peak. The batch twin of live_ladder()."""
    from tidemark.operators.indicators import by_ts

    return _drawn(rows.withColumn("peak", F.max(F.when(~F.col("is_mock"), F.col("equity"))).over(by_ts())), levels, sizes)


def live_ladder(rows: DataFrame, levels: tuple[float, ...] = LADDER, sizes: tuple[float, ...] = LADDER_SIZES) -> DataFrame:
    """ladder() of a stream: the state of a series is its peak and last stamp. Rows that are not newer than that are dropped."""
    def step(held, row):
        at, peak = int(row.ts.value // 1000), held["peak"] if held else float("-inf")
        if held and at <= held["last"]:
            return held, None
        if not row.is_mock and row.equity == row.equity:
            peak = max(peak, float(row.equity))
        return {"last": at, "peak": peak}, (peak if peak > float("-inf") else None,)

    narrow = rows.select("pair", "ts", "equity", "is_mock")
    return _drawn(walked(narrow, "pair", "ts", {"peak": "double"}, {"last": "long", "peak": "double"}, step), levels, sizes)


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, ts, size, flat): the smaller size, flat when either is, of two ladders at shared times; of streams too, with a watermark on
    each."""
    rows = a.select("pair", "ts", F.col("size").alias("x")).join(b.select("pair", "ts", F.col("size").alias("y")), ["pair", "ts"])
    return rows.select("pair", "ts", F.least("x", "y").alias("size"), ((F.col("x") == 0) | (F.col("y") == 0)).alias("flat"))


def reconcile(cycles: DataFrame, most: float, share: float) -> DataFrame:
    """Cycles (strategy, seq, pair, mid, held, cost, swap, broker, is_mock) with modelled, residual, tolerance, breach, double_breach and in_a_row.

    Modelled equity starts at the broker's of the first cycle and adds what is held times the change of the pair's mid since the pair's last
    cycle (held in units of account currency: over that mid for pairs in JPY), plus swap, less cost. A breach is a residual over the
    tolerance, the greater of `most` and `share` of the broker's peak; a double breach is one over twice that. in_a_row counts breaches
    since the last cycle without one. Mock cycles move the model, but neither the peak nor the count. The batch twin of
    live_reconcile()."""
    w, own = W.partitionBy("strategy").orderBy("seq"), W.partitionBy("strategy", "pair").orderBy("seq")
    before, real = F.lag("mid").over(own), ~F.col("is_mock")
    units = F.when(F.col("pair").contains("JPY"), F.col("held") / F.nullif(before, F.lit(0.0))).otherwise(F.col("held"))
    rows = cycles.withColumn("step", F.when((before > 0) & (F.col("held") > 0), units * (F.col("mid") - before)).otherwise(0.0) + F.col("swap") - F.col("cost"))
    rows = rows.withColumn("modelled", F.first("broker").over(w) + F.sum("step").over(w)).withColumn("residual", F.col("broker") - F.col("modelled"))
    rows = rows.withColumn("tolerance", F.greatest(F.lit(most), F.coalesce(F.max(F.when(real, F.col("broker"))).over(w), F.lit(0.0)) * share))
    rows = rows.withColumns({"breach": real & (F.abs("residual") > F.col("tolerance")), "double_breach": real & (F.abs("residual") > F.col("tolerance") * 2)})
    rows = rows.withColumn("island", F.count_if(real & ~F.col("breach")).over(w))
    return rows.withColumn("in_a_row", F.count_if("breach").over(W.partitionBy("strategy", "island").orderBy("seq"))).drop("step", "island")


def live_reconcile(cycles: DataFrame, most: float, share: float) -> DataFrame:
    """reconcile() of a stream. The state of a strategy: its modelled equity, the broker's peak, breaches in a row, the last cycle's number and
    the last mid of each pair. Cycles that are not newer than the last one are dropped; a negative holding is an error."""
    def step(held, row):
        if held and row.seq <= held["last"]:
            return held, None
        if row.held < 0:
            raise ValueError("holdings are long only")
        now = held or {"last": 0, "modelled": float(row.broker), "peak": 0.0, "in_a_row": 0, "pairs": [], "mids": []}
        mids = dict(zip(now["pairs"], now["mids"]))
        mid = mids.get(row.pair, 0.0)
        gain = (row.held / mid if "JPY" in row.pair else row.held) * (row.mid - mid) if mid > 0 and row.held > 0 else 0.0
        modelled = now["modelled"] + gain + row.swap - row.cost
        peak = now["peak"] if row.is_mock else max(now["peak"], float(row.broker))
        residual, tolerance = row.broker - modelled, max(most, share * peak)
        breach, twice = (not row.is_mock and abs(residual) > k * tolerance for k in (1, 2))
        in_a_row = now["in_a_row"] if row.is_mock else (now["in_a_row"] + 1) * breach
        mids[row.pair] = float(row.mid)
        state = {"last": int(row.seq), "modelled": float(modelled), "peak": peak, "in_a_row": int(in_a_row), "pairs": list(mids), "mids": list(mids.values())}
        return state, (modelled, residual, tolerance, bool(breach), bool(twice), int(in_a_row))

    made = {"modelled": "double", "residual": "double", "tolerance": "double", "breach": "boolean", "double_breach": "boolean", "in_a_row": "long"}
    kept = {"last": "long", "modelled": "double", "peak": "double", "in_a_row": "long", "pairs": "array<string>", "mids": "array<double>"}
    return walked(cycles.select("strategy", "seq", "pair", "mid", "held", "cost", "swap", "broker", "is_mock"), "strategy", "seq", made, kept, step)


def swap_accrual(positions: DataFrame, per_day: float, suffix: str | None = None, price: str = "close") -> DataFrame:
    """Rows with the swap earned since the row before: days passed * rate * units held over them; pairs quoted in `suffix` are turned into
    the account's currency by the price."""
    from tidemark.operators.indicators import by_ts

    days = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_ts()))) / 86400
    earned = days * per_day * F.lag("held").over(by_ts())
    if suffix:
        earned = F.when(F.col("pair").endswith(suffix), earned / F.col(price)).otherwise(earned)
    return positions.withColumn("accrued", F.coalesce(earned, F.lit(0.0)))


AGGREGATE, AGGREGATE_SIZES = (0.04, 0.08, 0.12, 0.15), (1.0, 1.0, 0.5, 0.0, 0.0)


def _aggregate(rows: DataFrame, levels: tuple[float, ...], sizes: tuple[float, ...]) -> DataFrame:
    """Rows with reason and peak, with the rest of aggregate_ladder()."""
    rows = rows.withColumn("accepted", F.col("reason").isNull())
    drop = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("equity") / F.col("peak")), F.lit(0.0))
    rows = _rungs(rows.withColumn("drawdown", F.when(F.col("accepted"), drop)).drop("peak"), levels, sizes)
    return rows.withColumns({"dispatch": F.col("level") < 3, "flat": F.col("level") == 4})


def aggregate_ladder(snapshots: DataFrame, levels: tuple[float, ...] = AGGREGATE, sizes: tuple[float, ...] = AGGREGATE_SIZES, budget: float = 60.0) -> DataFrame:
    """Rows (pair, seq, ts, received, equity, is_mock) of snapshots in order of arrival (seq), with accepted, reason, drawdown, level, size,
    dispatch and flat. A snapshot older than one accepted before is out of order, one received more than `budget` seconds after its stamp
    is stale; neither changes the peak, and both get no level. New positions stop at the third level; the fourth is flat. The batch
    twin of live_aggregate_ladder()."""
    arrival = W.partitionBy("pair").orderBy("seq")
    stale = (F.col("received").cast("double") - F.col("ts").cast("double")) > budget
    before = F.max(F.when(~stale, F.col("ts"))).over(arrival.rowsBetween(W.unboundedPreceding, -1))
    late = F.coalesce(F.col("ts") < before, F.lit(False))
    rows = snapshots.withColumn("reason", F.when(stale, "stale").when(late, "out of order"))
    return _aggregate(rows.withColumn("peak", F.max(F.when(F.col("reason").isNull() & ~F.col("is_mock"), F.col("equity"))).over(arrival)), levels, sizes)


def live_aggregate_ladder(snapshots: DataFrame, levels: tuple[float, ...] = AGGREGATE, sizes: tuple[float, ...] = AGGREGATE_SIZES, budget: float = 60.0) -> DataFrame:
    """aggregate_ladder() of a stream: the state of a series is its peak, the newest stamp that was not stale and the last number. Numbers
    that came before are repeats, and dropped; stale and late snapshots stay as rows that name their reason."""
    def step(held, row):
        now = held or {"last": -(1 << 62), "newest": -(1 << 62), "peak": float("-inf")}
        if row.seq <= now["last"]:
            return now, None
        at, stale = int(row.ts.value // 1000), (row.received.value - row.ts.value) / 1e9 > budget
        reason = "stale" if stale else "out of order" if at < now["newest"] else None
        newest = now["newest"] if stale else max(now["newest"], at)
        peak = max(now["peak"], float(row.equity)) if reason is None and not row.is_mock else now["peak"]
        return {"last": int(row.seq), "newest": newest, "peak": peak}, (reason, peak if peak > float("-inf") else None)

    narrow = snapshots.select("pair", "seq", "ts", "received", "equity", "is_mock")
    return _aggregate(walked(narrow, "pair", "seq", {"reason": "string", "peak": "double"}, {"last": "long", "newest": "long", "peak": "double"}, step), levels, sizes)


def signal_log(bars: DataFrame, n: int = 20) -> DataFrame:
    """(pair, ts, close, momentum, signal, position) of every closed bar with n + 1 closed bars before it at least; the newest bar of a series
    may still be forming and is left out. The batch twin of live_signals()."""
    from tidemark.operators.indicators import by_ts

    rows = bars.withColumns({"next": F.lead("ts").over(by_ts()), "momentum": F.col("close") / F.lag("close", n).over(by_ts()) - 1, "i": F.row_number().over(by_ts())})
    return _logged(rows.where(F.col("next").isNotNull() & (F.col("i") >= n + 2)))


def _logged(rows: DataFrame) -> DataFrame:
    signal = F.when(F.col("momentum") > 0, 1.0).when(F.col("momentum") < 0, -1.0).otherwise(0.0)
    rows = rows.withColumn("signal", signal)
    return rows.select("pair", "ts", "close", "momentum", "signal", F.when(F.col("signal") > 0, "LONG").when(F.col("signal") < 0, "SHORT").otherwise("FLAT").alias("position"))


def live_signals(bars: DataFrame, n: int = 20) -> DataFrame:
    """One record for each bar of a stream (pair, ts, close) once a later bar of its series has come: the state holds the last n + 1 closed
    bars and the forming one. Bars that are not newer than the forming one are repeats or late, and are dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        import pandas as pd

        seen, stamps, closes = state.get if state.exists else (0, [], [])
        stamps, closes, out = list(stamps), list(closes), []
        for row in ordered(batches, "ts"):
            at = int(row.ts.value // 1000)
            if stamps and at <= stamps[-1]:
                continue
            if stamps:  # the bar before is closed now
                seen += 1
                if seen >= n + 2:
                    out.append((key[0], pd.Timestamp(stamps[-1] * 1000), closes[-1], closes[-1] / closes[-1 - n] - 1))
                    if len(out) == SENT:
                        yield pd.DataFrame(out, columns=["pair", "ts", "close", "momentum"])
                        out = []
            stamps, closes = [*stamps[-n:], at], [*closes[-n:], float(row.close)]
        state.update((seen, stamps, closes))
        yield pd.DataFrame(out, columns=["pair", "ts", "close", "momentum"])

    ship(bars.sparkSession)
    narrow = bars.select("pair", "ts", "close")
    found = narrow.groupBy("pair").applyInPandasWithState(
        run, "pair string, ts timestamp, close double, momentum double", "seen long, stamps array<long>, closes array<double>", "append", GroupStateTimeout.NoTimeout
    )
    return _logged(found)
