"""Readers and sinks of bar, ledger and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TIME_NAMES = ("datetime", "date", "time", "timestamp")
PRICES = ("open", "high", "low", "close")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir or else the warehouse; it goes when the driver ends."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files named PAIR.csv, or in folders pair=PAIR. Headers in any case; the time column is the first named in TIME_NAMES, else the first column; a
    missing volume is 0; a missing price column is an error."""
    raw = spark.read.csv(path, header=True)
    raw = raw.select("*", F.col("_metadata.file_name").alias("__file"))
    names = {c.lower().strip(): c for c in raw.columns}
    if missing := [c for c in PRICES if c not in names]:
        raise ValueError(f"columns missing: {missing}")
    ts = next((names[t] for t in TIME_NAMES if t in names), raw.columns[0])
    volume = F.coalesce(F.col(f"`{names['volume']}`").cast("double"), F.lit(0.0)) if "volume" in names else F.lit(0.0)
    pair = F.col(f"`{names['pair']}`").cast("string") if "pair" in names else F.regexp_replace("__file", r"\.csv$", "")
    return raw.select(
        F.upper(pair).alias("pair"), F.to_timestamp(F.col(f"`{ts}`")).alias("ts"),
        *(F.col(f"`{names[c]}`").cast("double").alias(c) for c in PRICES), volume.alias("volume"),
    )


def parquet_bars(spark: SparkSession, path: str, pair: str, timeframe: str, start: str, end: str) -> DataFrame:
    """Bars of one pair and timeframe in [start, end]; the folders of other pairs are not read."""
    at = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return spark.read.parquet(path).where((F.col("pair") == pair) & (F.col("timeframe") == timeframe) & at)


def write_bars(bars: DataFrame, path: str) -> None:
    """A store of bars in folders by timeframe and pair; a pair's years are written by different tasks."""
    bars.repartition("timeframe", "pair", F.year("ts")).write.mode("overwrite").partitionBy("timeframe", "pair").parquet(path)


BROKER = T.ArrayType(T.StructType([T.StructField("Time", T.TimestampType())] + [T.StructField(f"{c}{s}", T.DoubleType()) for c in ("Open", "High", "Low", "Close") for s in ("Bid", "Ask")]))


def broker_bars(replies: DataFrame, body: str = "body") -> DataFrame:
    """(pair, ts, open, high, low, close, close_bid, close_ask) from JSON replies (pair, seq, body): the mean of bid and ask; of repeated
    stamps the last of the latest reply stays."""
    rows = replies.select("pair", "seq", F.posexplode(F.from_json(body, BROKER)).alias("pos", "b")).select("pair", "seq", "pos", "b.*")
    mids = [((F.col(f"{c.title()}Bid") + F.col(f"{c.title()}Ask")) / 2).alias(c) for c in PRICES]
    rows = rows.select("pair", F.col("Time").alias("ts"), "seq", "pos", *mids, F.col("CloseBid").alias("close_bid"), F.col("CloseAsk").alias("close_ask"))
    last = rows.groupBy("pair", "ts").agg(F.max_by(F.struct(*PRICES, "close_bid", "close_ask"), F.struct("seq", "pos")).alias("r"))
    return last.select("pair", "ts", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; (file, seq) gives the order of lines within a partition of a file."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_name").alias("file"))
    return lines.select("file", "seq", F.from_json("value", schema).alias("r")).select("file", "seq", "r.*")


def append_log(rows: DataFrame, path: str, at: Column | None = None) -> None:
    """Appends predictions, fills or trial records, in one folder a month."""
    month = F.date_format(F.col("ts") if at is None else at, "yyyy-MM")
    rows.withColumn("month", month).write.mode("append").partitionBy("month").parquet(path)


TICK = "pair string, ts timestamp, mid double, ask_vol double, bid_vol double, spread_pips double, crossed boolean, seq long"
MANY = 100_000


def compressed_ticks(files: DataFrame, scale: float, pip: float) -> DataFrame:
    """Ticks of (pair, hour timestamp, content): LZMA of 20-byte big-endian records (ms, ask, bid as uint32; volumes as float32). The spread
    of a crossed tick is 0. One file is an hour of one pair; small ones are decoded together, MANY ticks at a time."""
    def decode(batches):
        import lzma

        import numpy as np
        import pandas as pd

        kind = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("av", ">f4"), ("bv", ">f4")])

        def frame(held):
            pairs, hours, arrays = zip(*held)
            a, sizes = np.concatenate(arrays), np.array([len(x) for x in arrays])
            ask, bid = a["ask"] / scale, a["bid"] / scale
            return pd.DataFrame({
                "pair": np.repeat(np.array(pairs, object), sizes), "ts": pd.Series(hours).repeat(sizes).reset_index(drop=True) + pd.to_timedelta(a["ms"].astype("int64"), unit="ms"), "mid": (ask + bid) / 2,
                "ask_vol": a["av"].astype(float), "bid_vol": a["bv"].astype(float), "spread_pips": np.maximum(ask - bid, 0) / pip, "crossed": ask < bid,
                "seq": np.arange(len(a), dtype="int64") - np.repeat(np.cumsum(sizes) - sizes, sizes),
            })

        for batch in batches:
            held, n = [], 0
            for pair, hour, content in zip(batch["pair"], batch["hour"], batch["content"]):
                raw = lzma.decompress(content) if content else b""
                held.append((pair, hour, np.frombuffer(raw[: len(raw) // 20 * 20], kind)))
                n += len(raw) // 20
                if n >= MANY:
                    yield frame(held)
                    held, n = [], 0
            if n:
                yield frame(held)

    return files.select("pair", "hour", "content").mapInPandas(decode, TICK)


def tick_files(ticks: DataFrame, scale: float) -> DataFrame:
    """(pair, hour, content) that compressed_ticks() reads, from ticks (pair, ts, ask, bid, ask_vol, bid_vol, seq): one row for each hour of a pair, in
    order of time and seq; stamps are cut to milliseconds."""
    fields, hour = ("ask", "bid", "ask_vol", "bid_vol"), F.date_trunc("hour", "ts")
    ms = ((F.unix_micros(F.col("ts")) - F.unix_micros(hour)) / 1000).cast("int")
    held = ticks.select("pair", hour.alias("hour"), F.struct(ms.alias("ms"), "seq", *fields).alias("t")).groupBy("pair", "hour").agg(F.sort_array(F.collect_list("t")).alias("ticks"))

    def encode(batches):
        import lzma

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ends, rows, bodies = batch["ticks"].offsets.to_numpy(), batch["ticks"].values, []
            a = np.empty(len(rows), [("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_vol", ">f4"), ("bid_vol", ">f4")])
            for name in a.dtype.names:
                column = rows.field(name).to_numpy(zero_copy_only=False)
                a[name] = np.rint(column * scale) if name in ("ask", "bid") else column
            for x, y in zip(ends[:-1], ends[1:]):
                bodies.append(lzma.compress(a[x:y].tobytes(), preset=0))
            yield pa.RecordBatch.from_arrays([batch["pair"], batch["hour"], pa.array(bodies, pa.binary())], names=["pair", "hour", "content"])

    return held.mapInArrow(encode, "pair string, hour timestamp, content binary")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(timeframe, pair, files) of a store that write_bars() made, from the names of its folders: files are listed and none is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    value = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    return listed.select(value("timeframe").alias("timeframe"), value("pair").alias("pair")).groupBy("timeframe", "pair").agg(F.count("*").alias("files"))


def assemble_months(chunks: DataFrame, order: Column | None = None) -> DataFrame:
    """Bars of month chunks read together (pair, ts, ..), of repeated stamps the first by `order`: by default the file's name."""
    order = F.col("_metadata.file_name") if order is None else order
    columns = chunks.columns
    first = chunks.select(F.struct(*columns).alias("r"), order.alias("o")).groupBy("r.pair", "r.ts").agg(F.min_by("r", "o").alias("r"))
    return first.select("r.*")


def _hash(values: Column) -> Column:
    """12 hex digits of a map's entries in order of their keys."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.map_entries(values))), 256), 1, 12)


def log_predictions(rows: DataFrame, path: str) -> None:
    """Appends (ts, pair, strategy, signal, source, params: map) with the hash of the parameters."""
    append_log(rows.withColumn("params_hash", _hash(F.col("params"))).drop("params"), path)


def log_fills(rows: DataFrame, path: str, own: list[str]) -> None:
    """Appends fills; columns that are not in `own` go into the map ctx, as text, without nulls."""
    free = [c for c in rows.columns if c not in own]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in free]) if free else F.array().cast("array<struct<k:string,v:string>>")
    ctx = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    append_log(rows.select(*own, ctx.alias("ctx")), path)


def log_trials(rows: DataFrame, path: str) -> None:
    """Appends trials (ts, trial_id, strategy, metrics: map, params: map, tags: array) with the hash of strategy and parameters."""
    config = _hash(F.map_concat(F.transform_values("params", lambda k, v: v.cast("string")), F.create_map(F.lit("__strategy"), F.col("strategy"))))
    append_log(rows.withColumn("config_hash", config), path)


def query_log(
    log: DataFrame, start: str | None = None, end: str | None = None, strategy: str | None = None, pair: str | None = None, source: str | None = None,
    least_sharpe: float | None = None, tags: list[str] | None = None,
) -> DataFrame:
    """Rows of a log in [start, end) by strategy, pair, source, least Sharpe (metrics['sharpe'], or sharpe) and all of the tags. Months
    outside the span are not read."""
    for bound, op in ((start, ">="), (end, "<")):
        if bound is not None:
            stamp = F.lit(bound).cast("timestamp")
            log = log.where(F.col("ts") >= stamp if op == ">=" else F.col("ts") < stamp)
            if "month" in log.columns:
                month = F.date_format(stamp, "yyyy-MM")
                log = log.where(F.col("month") >= month if op == ">=" else F.col("month") <= month)
    for name, value in (("strategy", strategy), ("pair", pair), ("source", source)):
        if value is not None:
            log = log.where(F.col(name) == value)
    if least_sharpe is not None:
        log = log.where((F.col("metrics")["sharpe"] if "metrics" in log.columns else F.col("sharpe")) >= least_sharpe)
    return log.where(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains("tags", t))) if tags else log


def holdout(rows: DataFrame, cutoff: str, at: str = "ts", after: bool = False) -> DataFrame:
    """Rows before the cutoff, or those on and after it; trades are cut by their entry_time."""
    stamp = F.lit(cutoff).cast("timestamp")
    return rows.where(F.col(at) >= stamp if after else F.col(at) < stamp)


def guard_holdout(rows: DataFrame, cutoff: str, burnt: DataFrame | None = None, after: bool = False) -> DataFrame:
    """rows, if they keep to their side of the cutoff. Before it (the standard), any row on or after is an error. After it, a (pair,
    timeframe) that is in `burnt`, the record of those used once, is an error; record_use() adds to that record."""
    if not after:
        late = rows.agg(F.bool_or(F.col("ts") >= F.lit(cutoff).cast("timestamp"))).first()[0]
        if late:
            raise ValueError(f"rows on or after {cutoff} in a run that must not see them")
        return rows
    used = rows.select("pair", "timeframe").distinct().join(burnt, ["pair", "timeframe"], "left_semi").limit(3).collect() if burnt is not None else []
    if used:
        raise ValueError(f"held-out data was used before: {[tuple(r) for r in used]}")
    return holdout(rows, cutoff, after=True)


def record_use(rows: DataFrame, path: str) -> None:
    """Appends the (pair, timeframe) of held-out rows that are used now, and when, to the record of a store at `path`."""
    rows.select("pair", "timeframe").distinct().withColumn("used_at", F.current_timestamp()).write.mode("append").parquet(path)


def used_before(spark: SparkSession, path: str) -> DataFrame:
    """(pair, timeframe, first_use, uses) of the record; no rows where nothing was used yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    kind = "pair string, timeframe string, used_at timestamp"
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    record = spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)
    return record.groupBy("pair", "timeframe").agg(F.min("used_at").alias("first_use"), F.count("*").alias("uses"))
