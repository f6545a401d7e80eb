"""Readers, sinks and stateful jobs on small hand-made tables."""

import datetime as dt
import lzma
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import jobs


def test_csv_and_partitioned_bars(spark, tmp_path):
    (tmp_path / "eurusd.csv").write_text("Date,OPEN,High,Low,Close\n2024-01-02,1,3,0.5,2\n2024-01-03,2,4,1,\n")
    bars = files.csv_bars(spark, f"file://{tmp_path}/eurusd.csv")
    rows = bars.orderBy("ts").collect()
    assert [(r.pair, r.ts.day, r.close, r.volume) for r in rows] == [("EURUSD", 2, 2.0, 0.0), ("EURUSD", 3, None, 0.0)]
    files.write_bars(bars.withColumn("timeframe", F.lit("day")), f"file://{tmp_path}/store")
    assert files.parquet_bars(spark, f"file://{tmp_path}/store", "EURUSD", "day", "2024-01-03", "2024-01-04").count() == 1
    (tmp_path / "bad.csv").write_text("date,open\n2024-01-02,1\n")
    with pytest.raises(ValueError):
        files.csv_bars(spark, f"file://{tmp_path}/bad.csv")


def test_json_lines_and_log(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"trial_id": 1, "ts": "2024-01-31T00:00:00Z"}\n\n{"trial_id": 2, "ts": "2024-02-01T00:00:00Z"}\n')
    rows = files.json_lines(spark, f"file://{tmp_path}/l.jsonl", "trial_id long, ts timestamp")
    assert [r.trial_id for r in rows.orderBy("seq").collect()] == [1, 2]
    for _ in range(2):
        files.append_log(rows, f"file://{tmp_path}/log")
    back = spark.read.parquet(f"file://{tmp_path}/log")
    assert sorted((r.month, r["count"]) for r in back.groupBy("month").count().collect()) == [("2024-01", 2), ("2024-02", 2)]


def test_compressed_ticks(spark):
    body = lzma.compress(b"".join(struct.pack(">IIIff", *t) for t in [(0, 110002, 110000, 1.0, 2.0), (1500, 110000, 110003, 1.0, 1.0)]))
    rows = [("EURUSD", dt.datetime(2024, 1, 2, 5), body), ("EURUSD", dt.datetime(2024, 1, 2, 6), b"")]
    got = files.compressed_ticks(spark.createDataFrame(rows, "pair string, hour timestamp, content binary"), 1e5, 1e-4).orderBy("seq").collect()
    assert [(round(t.mid, 6), round(t.spread_pips, 4), t.crossed) for t in got] == [(1.10001, 0.2, False), (1.100015, 0.0, True)]
    assert got[1].ts - got[0].ts == dt.timedelta(milliseconds=1500)


def test_first_bar_of_each_stamp_stays(spark, tmp_path):
    one = [("P", dt.datetime(2024, 1, 1), 1.0), ("P", dt.datetime(2024, 1, 1, 1), 2.0)]
    for n in range(2):
        spark.createDataFrame(one, "pair string, ts timestamp, close double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("pair string, ts timestamp, close double").parquet(f"file://{tmp_path}/in")
    jobs.run_to_end(jobs.first_bars(stream), f"file://{tmp_path}/run")
    assert spark.read.parquet(f"file://{tmp_path}/run/out").count() == 2


def test_ladders_and_reconciliation(spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    eq = spark.createDataFrame([("S", day[0], 100.0, False), ("S", day[1], 200.0, True), ("S", day[2], 84.0, False)], "pair string, ts timestamp, equity double, is_mock boolean")
    steps = jobs.ladder(eq)
    assert [(r.level, r.size) for r in steps.orderBy("ts").collect()] == [(0, 1.0), (0, 1.0), (2, 0.5)]
    both = jobs.compose(steps, steps.withColumn("size", F.lit(0.5))).orderBy("ts").collect()
    assert [(r.size, r.flat) for r in both] == [(0.5, False), (0.5, False), (0.5, False)]
    rows = [("S", i, "EURUSD", mid, 10.0, 0.0, 0.0, broker, False) for i, (mid, broker) in enumerate([(1.0, 100.0), (2.0, 110.0), (3.0, 150.0), (3.0, 150.0), (3.0, 120.0)])]
    got = jobs.reconcile(spark.createDataFrame(rows, "strategy string, seq long, pair string, mid double, held double, cost double, swap double, broker double, is_mock boolean"), 5.0, 0.01).orderBy("seq").collect()
    assert [(r.residual, r.breach, r.in_a_row) for r in got] == [(0.0, False, 0), (0.0, False, 0), (30.0, True, 1), (30.0, True, 2), (0.0, False, 0)]


def test_tick_files_come_back(spark):
    at = dt.datetime(2024, 1, 2, 5, 59, 59, 999_700)
    rows = [("P", at, 1.10002, 1.1, 3.0, 1.0, 2), ("P", at, 1.10001, 1.10003, 2.0, 1.0, 1), ("P", at + dt.timedelta(milliseconds=1), 5e-5, 0.0, 0.0, 0.0, 0), ("Q", dt.datetime(2024, 1, 2), 42949.67295, 1.0, 1.5, 0.5, 9)]
    ticks = spark.createDataFrame(rows, "pair string, ts timestamp, ask double, bid double, ask_vol double, bid_vol double, seq long")
    made = files.tick_files(ticks, 1e5)
    assert sorted((r.pair, r.hour.hour) for r in made.collect()) == [("P", 5), ("P", 6), ("Q", 0)]
    got = sorted((r.pair, r.ts, r.seq, round(r.mid, 6), r.ask_vol, r.bid_vol, r.crossed) for r in files.compressed_ticks(made, 1e5, 1e-4).collect())
    cut = at.replace(microsecond=999_000)
    assert got == [
        ("P", cut, 0, 1.10002, 2.0, 1.0, True), ("P", cut, 1, 1.10001, 3.0, 1.0, False), ("P", dt.datetime(2024, 1, 2, 6), 0, 0.000025, 0.0, 0.0, False), ("Q", dt.datetime(2024, 1, 2), 0, 21475.336475, 1.5, 0.5, False),
    ]
    assert files.compressed_ticks(files.tick_files(ticks.limit(0), 1e5), 1e5, 1e-4).count() == 0


def test_csv_in_folders_by_pair(spark, tmp_path):
    for pair, day in (("eurusd", 2), ("usdjpy", 3)):
        (tmp_path / "csv" / f"pair={pair}").mkdir(parents=True)
        (tmp_path / "csv" / f"pair={pair}" / "any.csv").write_text(f"time,open,high,low,close,Volume\n2024-01-0{day} 05:00:00,1,3,0.5,2,7\n")
    rows = files.csv_bars(spark, f"file://{tmp_path}/csv").orderBy("pair").collect()
    assert [(r.pair, r.ts, r.volume) for r in rows] == [("EURUSD", dt.datetime(2024, 1, 2, 5), 7.0), ("USDJPY", dt.datetime(2024, 1, 3, 5), 7.0)]


def test_held_out_rows_are_used_once(spark, tmp_path):
    path = f"file://{tmp_path}/burnt"
    rows = spark.createDataFrame([("A", "day", dt.datetime(2024, 5, 1), 1.0), ("A", "day", dt.datetime(2024, 5, 2), 2.0), ("B", "day", dt.datetime(2023, 5, 2), 2.0)], "pair string, timeframe string, ts timestamp, close double")
    assert files.used_before(spark, path).count() == 0
    first = files.guard_holdout(rows, "2024-01-01", files.used_before(spark, path), after=True)
    assert first.count() == 2
    files.record_use(first, path)
    files.record_use(first, path)
    assert [(r.pair, r.timeframe, r.uses) for r in files.used_before(spark, path).collect()] == [("A", "day", 2)]
    with pytest.raises(ValueError, match="used before"):
        files.guard_holdout(rows, "2024-01-01", files.used_before(spark, path), after=True)
    assert files.guard_holdout(rows.where("pair = 'B'"), "2024-01-01", files.used_before(spark, path), after=True).count() == 0


def test_ladders_of_two_logs_meet_in_a_stream(spark, tmp_path):
    """Two logs that grow at different speeds; the join keeps what waits for its partner through a restart."""
    kind, day = "pair string, ts timestamp, size double", [dt.datetime(2024, 1, d) for d in range(1, 7)]
    arrivals = [([(d, 1.0) for d in day[:4]], [(day[0], 0.5)]), ([(day[4], 0.0)], [(d, 0.5) for d in day[1:4]]), ([(day[5], 0.5)], [(day[4], 1.0), (day[5], 0.0)])]
    for one, two in arrivals:
        for name, rows in (("one", one), ("two", two)):
            spark.createDataFrame([("S", *r) for r in rows], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
        logs = [spark.readStream.schema(kind).parquet(f"file://{tmp_path}/{name}").withWatermark("ts", "7 days") for name in ("one", "two")]
        jobs.run_to_end(jobs.compose(*logs), f"file://{tmp_path}/run")
    got = [(r.ts, r.size, r.flat) for r in spark.read.parquet(f"file://{tmp_path}/run/out").orderBy("ts").collect()]
    assert got == [(d, 0.5, False) for d in day[:4]] + [(day[4], 0.0, True), (day[5], 0.0, True)]
