"""Calendar events against bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.indicators import by_ts, true_range


def admissible(events: DataFrame, tiers: list[str], banks: list[str]) -> DataFrame:
    """(date, bank, tier): verified events of the chosen banks, one a date: the alphabetically first bank, then tier."""
    kept = events.where(F.col("tier").isin(*tiers) & F.col("bank").isin(*banks))
    return kept.groupBy("date").agg(F.min(F.struct("bank", "tier")).alias("e")).select("date", "e.bank", "e.tier")


def date_window(events: DataFrame, start: str | None, end: str | None, flag_from: str) -> DataFrame:
    """Both bounds count; a missing one is open. `late` marks events from `flag_from`."""
    if start:
        events = events.where(F.col("date") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.where(F.col("date") <= F.lit(end).cast("timestamp"))
    return events.withColumn("late", F.col("date") >= F.lit(flag_from).cast("timestamp"))


def expand(events: DataFrame, pairs: dict[str, list[str]]) -> DataFrame:
    """One row for each pair of the event's bank; banks without pairs go."""
    table = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return events.withColumn("pair", F.explode(F.try_element_at(table, F.col("bank"))))


def widest_bar(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(pair, day, ts, tr): on each event day, the bar of greatest true range, the earliest of equals."""
    rows = bars.withColumn("tr", true_range()).withColumn("day", F.date_trunc("day", "ts")).join(days, ["pair", "day"], "left_semi")
    top = rows.groupBy("pair", "day").agg(F.max(F.struct("tr", (-F.unix_timestamp("ts")).alias("k"), "ts")).alias("b"))
    return top.select("pair", "day", "b.ts", "b.tr")


def bounded_exit(bars: DataFrame, h: int, stop: float, target: float) -> DataFrame:
    """For an entry at each close: the first of the next h bars that touches stop or target, else the last of them. The frame holds h rows
    at most, so no range join is needed."""
    rows = bars.withColumn("ahead", F.collect_list(F.struct("ts", "high", "low", "close")).over(by_ts().rowsBetween(1, h)))
    hit = F.filter("ahead", lambda b: (b["low"] <= F.col("close") - stop) | (b["high"] >= F.col("close") + target))
    rows = rows.withColumn("hit", F.get(hit, F.lit(0))).withColumn("x", F.coalesce("hit", F.try_element_at("ahead", F.lit(-1))))
    reason = F.when(F.col("hit").isNotNull(), "touch").when(F.col("x").isNotNull(), "time").otherwise("none")
    return rows.select("pair", "ts", F.col("x.ts").alias("exit_ts"), F.col("x.close").alias("exit_close"), reason.alias("reason"))


def entry_exit(bars: DataFrame, hold: int = 2) -> DataFrame:
    """Rows with the next open as entry and the close `hold` bars on as exit: (entry, exit)."""
    return bars.withColumns({"entry": F.lead("open").over(by_ts()), "exit": F.lead("close", hold).over(by_ts())})


def summary(rows: DataFrame, group: str, x: str) -> DataFrame:
    """(group, events, sharpe, continued) and the pooled row (null group): rollup in one pass."""
    s = rows.rollup(group).agg(F.count(x).alias("events"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.avg((F.col(x) > 0).cast("double")).alias("continued"))
    return s.select(group, "events", F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0).alias("sharpe"), "continued")


def drift_trades(
    bars: DataFrame, days: DataFrame, hold: int = 12, surprise: float = 1.5, trailing: int = 250, stop: float = 1.5, atr_n: int = 14, pip: float = 0.0001, overhead: float = 0.8
) -> DataFrame:
    """Trades after announcements: (pair, day, bar_ts, entry_ts, exit_ts, direction, reason, gross, cost, net) for event days (pair, day).

    The announcement bar is the day's bar of greatest true range (of equals the first); it counts if that is over `surprise` times the
    median of the `trailing` bars before. Entered at the open of the next bar in the announcement bar's direction; left at the close of
    the first of the `hold` bars after it that goes beyond the stop, `stop` ATRs of the entry bar away (no ATR: no stop), else of the
    last of them, or of the last bar there is. Bars without direction give no trade, nor do entry or exit bars without a usable spread."""
    w = by_ts()
    bar = F.struct("ts", "open", "high", "low", "close", "spread_median_pips", "atr")
    rows = bars.withColumn("tr", true_range()).withColumn("day", F.date_trunc("day", "ts"))
    past, held = w.rowsBetween(-trailing, -1), w.rowsBetween(-(atr_n - 1), 0)
    rows = rows.withColumns({
        "usual": F.when(F.count("tr").over(past) == trailing, F.percentile("tr", 0.5).over(past)),
        "atr": F.when(F.count("tr").over(held) == atr_n, F.avg("tr").over(held)), "move": F.signum(F.col("close") - F.col("open")),
    })
    rows = rows.withColumns({"e": F.lead(bar).over(w), "after": F.collect_list(bar).over(w.rowsBetween(2, hold + 1))})
    rows = rows.join(days.select("pair", "day").distinct(), ["pair", "day"], "left_semi")
    top = rows.groupBy("pair", "day").agg(F.max_by(F.struct("ts", "tr", "usual", "move", "e", "after"), F.struct("tr", (-F.unix_timestamp("ts")).alias("k"))).alias("b")).select("pair", "day", "b.*")
    top = top.where((F.col("usual") > 0) & (F.col("tr") > F.col("usual") * surprise) & (F.col("move") != 0) & (F.col("e.spread_median_pips") > 0))
    level = F.col("e.open") - F.col("move") * F.col("e.atr") * stop
    beyond = lambda b: F.when(F.col("move") > 0, b["low"] < F.col("level")).otherwise(b["high"] > F.col("level"))
    top = top.withColumn("level", level).withColumn("hit", F.get(F.filter("after", beyond), F.lit(0)))
    top = top.withColumn("x", F.coalesce("hit", F.try_element_at("after", F.lit(-1)), "e")).where("x.spread_median_pips > 0")
    reason = F.when(F.col("hit").isNotNull(), "stop").when(F.size("after") == hold, "hold").otherwise("end_of_data")
    top = top.withColumns({"gross": F.col("move") * (F.col("x.close") - F.col("e.open")) / pip, "cost": F.col("e.spread_median_pips") + F.col("x.spread_median_pips") + overhead})
    return top.select(
        "pair", "day", F.col("ts").alias("bar_ts"), F.col("e.ts").alias("entry_ts"), F.col("x.ts").alias("exit_ts"), F.col("move").alias("direction"), reason.alias("reason"), "gross", "cost", (F.col("gross") - F.col("cost")).alias("net")
    )


def drift_verdict(trades: DataFrame, kill: float, least: int = 15) -> DataFrame:
    """(pair, fires, gross, cost, margin, spread, stops, verdict) of drift_trades(): FAIL with fewer than `least` trades or a mean gross of at
    most `kill` pips, STRETCH up to a quarter over it, else PASS."""
    s = trades.groupBy("pair").agg(F.count("*").alias("fires"), F.avg("gross").alias("gross"), F.avg("cost").alias("cost"), F.stddev_samp("gross").alias("spread"), F.count_if(F.col("reason") == "stop").alias("stops"))
    verdict = F.when((F.col("fires") < least) | (F.col("gross") <= kill), "FAIL").when(F.col("gross") <= kill / 0.8, "STRETCH").otherwise("PASS")
    return s.select("pair", "fires", "gross", "cost", (F.col("gross") - F.col("cost")).alias("margin"), "spread", "stops", verdict.alias("verdict"))


def participation_trades(rows: DataFrame, hours: tuple[int, ...] = (7, 13), least_volume: float = 1.5, pip: float = 0.0001, overhead: float = 0.8) -> DataFrame:
    """(pair, ts, entry_ts, exit_ts, direction, relvol, relrng, gross, cost, net) of bars (.., relvol, relrng) at session opens with a relative volume
    of at least `least_volume`: with the bar's own move, entered at the next open, left at the close after that. Bars without a move give no
    trade, nor do entry or exit bars without a usable spread."""
    bar = F.struct("ts", "open", "close", "spread_median_pips")
    r = rows.withColumns({"e": F.lead(bar, 1).over(by_ts()), "x": F.lead(bar, 2).over(by_ts()), "direction": F.signum(F.col("close") - F.col("open"))})
    r = r.where(F.hour("ts").isin(*hours) & (F.col("relvol") >= least_volume) & (F.col("direction") != 0) & (F.col("e.spread_median_pips") > 0) & (F.col("x.spread_median_pips") > 0))
    r = r.withColumns({"gross": F.col("direction") * (F.col("x.close") - F.col("e.open")) / pip, "cost": F.col("e.spread_median_pips") + F.col("x.spread_median_pips") + overhead})
    return r.select("pair", "ts", F.col("e.ts").alias("entry_ts"), F.col("x.ts").alias("exit_ts"), "direction", "relvol", "relrng", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"))
