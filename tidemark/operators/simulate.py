"""Costs, sizes, positions, trades and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.operators.costs import Sizer, atr_sizer
from tidemark.operators.indicators import by_ts


def position() -> Column:
    """A signal acts one bar later."""
    return F.lag("signal", 1, 0.0).over(by_ts())


def turnover_cost(rows: DataFrame, spread: str, overhead: float) -> DataFrame:
    """abs(change of position) * (spread + overhead) in pips; a bar without a usable spread carries no spread."""
    rows = rows.withColumn("position", position())
    s = F.when(F.col(spread) > 0, F.col(spread)).otherwise(0.0)
    return rows.withColumn("cost_pips", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(by_ts())) * (s + overhead))


def net_returns(rows: DataFrame, spread: str = "spread_median_pips", pip: float = 0.0001, overhead: float = 0.8) -> DataFrame:
    """position * log return - turnover cost in price / close."""
    rows = turnover_cost(rows, spread, overhead)
    gross = F.col("position") * F.log(F.col("close") / F.lag("close").over(by_ts()))
    return rows.withColumn("ret", F.coalesce(gross, F.lit(0.0)) - F.col("cost_pips") * pip / F.col("close"))


def rollovers(entry: Column, exit_: Column) -> Column:
    """Financing days between two stamps: 22:00 UTC boundaries in (entry, exit], none on Friday to Sunday, Wednesday's counts three."""
    # boundary n is 22:00 of day n since 1970-01-01, a Thursday
    def upto(ts: Column) -> Column:
        return F.floor((F.unix_timestamp(ts) - 22 * 3600) / 86400)

    def weight(n: Column) -> Column:  # boundaries up to day n in whole weeks of 6 financing days, then the days of the last week
        weeks, day = F.floor((n + 3) / 7), F.pmod(n + 3, F.lit(7))  # day 0 is Monday
        part = F.when(day == 0, 1).when(day == 1, 2).when(day == 2, 5).otherwise(6)
        return weeks * 6 + part

    return (weight(upto(exit_)) - weight(upto(entry))).cast("long")


def fixed_fraction(equity: Column, atr: Column, close: Column, signal: Column, risk: float = 0.01, mult: float = 2.0, cap: float = 0.1) -> Column:
    """equity * risk * |signal| over the stop distance, at most cap * equity of notional."""
    return F.when(atr > 0, F.least(equity * risk * F.abs(signal) / (atr * mult), equity * cap / close)).otherwise(0.0)


def trades(rows: DataFrame, spread: str = "spread_median_pips", pip: float = 0.0001) -> DataFrame:
    """One trade for each run of one position sign: (pair, direction, entry_time, exit_time, entry_price, exit_price, bars,
    pnl_pips). It closes on the first bar of another sign, or the last bar; exit costs half the spread."""
    rows = rows.where("close is not null").withColumn("side", F.signum(position()))
    rows = rows.withColumn("turn", F.coalesce(F.col("side") != F.lag("side").over(by_ts()), F.lit(True)).cast("int"))
    rows = rows.withColumns({"run": F.sum("turn").over(by_ts()), "n": F.row_number().over(by_ts())})
    # the bar that ends a run is the first of the next
    nxt = W.partitionBy("pair").orderBy("run")
    runs = rows.groupBy("pair", "run", "side").agg(
        F.min("ts").alias("entry_time"), F.min_by("close", "ts").alias("entry_price"), F.max("ts").alias("last_time"), F.max_by("close", "ts").alias("last_price"),
        F.max_by(spread, "ts").alias("last_spread"), F.min_by(spread, "ts").alias("first_spread"), F.min("n").alias("from_n"), F.count("*").alias("bars"),
    )
    runs = runs.withColumns({
        "exit_time": F.coalesce(F.lead("entry_time").over(nxt), F.col("last_time")), "exit_price": F.coalesce(F.lead("entry_price").over(nxt), F.col("last_price")),
        "exit_spread": F.coalesce(F.lead("first_spread").over(nxt), F.col("last_spread")),
    }).where("side <> 0 and from_n > 1")
    pnl = F.col("side") * (F.col("exit_price") - F.col("entry_price")) / pip - F.col("exit_spread") / 2
    return runs.select("pair", F.col("side").cast("int").alias("direction"), "entry_time", "exit_time", "entry_price", "exit_price", "bars", pnl.alias("pnl_pips"))


def buy_and_hold(bars: DataFrame, capital: float = 10_000.0) -> DataFrame:
    first = F.first("close").over(by_ts())
    return bars.withColumn("equity", F.lit(capital) / first * F.col("close"))


#: Trades of one step of the fold over a series' trades.
FOLD = 256


def entry_equities(trades: Column, capital: float, sizer: Sizer) -> Column:
    """Array of the equity before each trade of a sorted array of (price, atr, signal, gain of one unit). Sizes with caps and minima are
    not in proportion to equity, so it is carried from trade to trade; in slices, as an array grows by being copied."""
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(trades) - 1) / FOLD).cast("int")), lambda i: F.slice(trades, i * FOLD + 1, FOLD))
    none = F.array().cast("array<double>")

    def trade(acc: Column, t: Column) -> Column:
        after = acc["e"] + sizer(acc["e"], t["price"], t["atr"], t["signal"]) * t["gain"]
        return F.struct(after.alias("e"), F.array_append(acc["path"], acc["e"]).alias("path"))

    def some(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["e"].alias("e"), none.alias("path")), trade)
        return F.struct(inner["e"].alias("e"), F.array_append(acc["paths"], inner["path"]).alias("paths"))

    start = F.struct(F.lit(float(capital)).alias("e"), F.array().cast("array<array<double>>").alias("paths"))
    return F.aggregate(slices, start, some, lambda acc: F.flatten(acc["paths"]))


def priced_trades(
    rows: DataFrame, spread: str = "spread_median_pips", pip: float = 0.0001, slippage: float = 0.3, commission: float = 0.0, swap_long: float = 0.0, swap_short: float = 0.0,
    capital: float = 10_000.0, sizer: Sizer | None = None, multiplier: str | None = None,
) -> DataFrame:
    """One trade for each run of one position sign in rows (pair, ts, close, signal, atr, spread): (pair, direction, entry_time, exit_time,
    entry_price, exit_price, size, entry_equity, entry_pips, pnl_pips, cost_pips, pnl_dollars, cost_dollars).

    pnl_pips: signed pips less half the spread, slippage and commission at the exit and the swap of whole days held. size: the sizer's (by
    default costs.atr_sizer()) for the equity before the trade; the entry cost is taken from the equity too. multiplier: a column,
    constant in a series, that scales all costs.
    """
    by = F.col(multiplier) if multiplier else F.lit(1.0)
    rows = rows.where("close is not null").withColumn("raw", position()).withColumn("side", F.signum("raw"))
    rows = rows.withColumn("turn", F.coalesce(F.col("side") != F.lag("side").over(by_ts()), F.lit(True)).cast("int"))
    rows = rows.withColumns({"run": F.sum("turn").over(by_ts()), "n": F.row_number().over(by_ts()), "s": F.when(F.col(spread) > 0, F.col(spread)).otherwise(0.0)})
    at = F.struct(F.col("ts").alias("time"), F.col("close").alias("price"), "s", "atr", "raw", by.alias("by"))
    runs = rows.groupBy("pair", "run", "side").agg(F.min_by(at, "ts").alias("a"), F.max_by(at, "ts").alias("z"), F.min("n").alias("from_n"))
    runs = runs.withColumn("e", F.coalesce(F.lead("a").over(W.partitionBy("pair").orderBy("run")), F.col("z"))).where("side <> 0 and from_n > 1")
    swap = -F.when(F.col("side") > 0, swap_long).otherwise(swap_short) * F.floor((F.unix_timestamp("e.time") - F.unix_timestamp("a.time")) / 86400)
    cost = (F.col("e.s") / 2 + slippage + commission + swap) * F.col("a.by")
    runs = runs.withColumns({"cost_pips": cost, "entry_pips": (F.col("a.s") / 2 + slippage) * F.col("a.by")})
    runs = runs.withColumn("pnl_pips", F.col("side") * (F.col("e.price") - F.col("a.price")) / pip - F.col("cost_pips"))
    # the trades of one series, a few numbers each
    kept = ["run", "side", "a", "e", "cost_pips", "entry_pips", "pnl_pips"]
    book = runs.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("book"))
    gain = lambda t: (t["pnl_pips"] - t["entry_pips"]) * pip
    narrow = F.transform("book", lambda t: F.struct(t["a"]["price"].alias("price"), t["a"]["atr"].alias("atr"), t["a"]["raw"].alias("signal"), gain(t).alias("gain")))
    book = book.withColumn("narrow", narrow).withColumn("before", entry_equities(F.col("narrow"), capital, sizer or atr_sizer()))
    runs = book.select("pair", F.explode_outer(F.arrays_zip("book", "before")).alias("t")).select("pair", "t.book.*", F.col("t.before").alias("entry_equity"))
    size = (sizer or atr_sizer())(F.col("entry_equity"), F.col("a.price"), F.col("a.atr"), F.col("a.raw"))
    return runs.select(
        "pair", F.col("side").cast("int").alias("direction"), F.col("a.time").alias("entry_time"), F.col("e.time").alias("exit_time"), F.col("a.price").alias("entry_price"), F.col("e.price").alias("exit_price"),
        size.alias("size"), "entry_equity", "entry_pips", "pnl_pips", "cost_pips", (F.col("pnl_pips") * pip * size).alias("pnl_dollars"), (F.col("cost_pips") * pip * size).alias("cost_dollars"),
    )


def discrete_equity(bars: DataFrame, trades: DataFrame, pip: float = 0.0001, capital: float = 10_000.0) -> DataFrame:
    """(pair, ts, equity) of each bar of a series: the equity after the trades that are closed, less the entry cost and with the open move of
    the one that is open. trades: priced_trades(). The last bar of a trade that the end of the series closes shows it closed."""
    from tidemark.operators.joins import asof

    state = F.struct("direction", "entry_price", "size", "entry_equity", "entry_pips", "pnl_pips", "exit_time")
    rows = asof(bars.select("pair", "ts", "close"), trades.select("pair", F.col("entry_time").alias("ts"), state.alias("t")), "t")
    paid = F.col("t.entry_equity") - F.col("t.entry_pips") * pip * F.col("t.size")
    closed = paid + F.col("t.pnl_pips") * pip * F.col("t.size")
    running = paid + (F.col("close") - F.col("t.entry_price")) * F.col("t.direction") * F.col("t.size")
    return rows.select("pair", "ts", F.when(F.col("t").isNull(), capital).when(F.col("ts") >= F.col("t.exit_time"), closed).otherwise(running).alias("equity"))


def reversion_trades(
    rows: DataFrame, hold: int = 3, least_volume: float = 1.5, tight: float = 0.4, extension: float = 0.75, pip: float = 0.0001, overhead: float = 0.8
) -> DataFrame:
    """(pair, ts, entry_ts, exit_ts, direction, relvol, relrng, gross, cost, net) of bars (.., relvol, relrng, session_open, usual_range) with
    high relative volume, a spread at or below its `tight` quantile and a close `extension` usual ranges away from the session's open.

    Against the move: entered at the next open, left at the first of the `hold` bars after it that touches the session's open, at that
    price or a worse close, else at the last of them. Entry and exit bars need a usable spread.
    """
    q = rows.groupBy("pair").agg(F.percentile("spread_median_pips", tight).alias("tight"))
    bar = F.struct("ts", "open", "high", "low", "close", "spread_median_pips")
    r = rows.withColumns({"e": F.lead(bar, 1).over(by_ts()), "n": F.row_number().over(by_ts()), "size": F.count("*").over(W.partitionBy("pair"))})
    r = r.withColumn("after", F.collect_list(bar).over(by_ts().rowsBetween(2, hold + 1)))
    r = r.join(q, "pair").where("spread_median_pips > 0 and spread_median_pips <= tight").where(F.col("relvol") >= least_volume)
    move = F.col("close") - F.col("session_open")
    r = r.where((F.abs(move) >= F.col("usual_range") * extension) & (F.col("n") <= F.col("size") - hold - 1))
    r = r.withColumn("direction", F.when(move > 0, -1.0).otherwise(1.0))
    touched = lambda b: F.when(F.col("direction") > 0, b["high"] >= F.col("session_open")).otherwise(b["low"] <= F.col("session_open"))
    r = r.withColumn("x", F.coalesce(F.get(F.filter("after", touched), F.lit(0)), F.get("after", F.lit(hold - 1)))).withColumn("hit", F.exists("after", touched))
    worse = F.when(F.col("direction") > 0, F.least("session_open", "x.close")).otherwise(F.greatest("session_open", "x.close"))
    r = r.withColumn("price", F.when(F.col("hit"), worse).otherwise(F.col("x.close"))).where("e.spread_median_pips > 0 and x.spread_median_pips > 0")
    r = r.withColumns({"gross": F.col("direction") * (F.col("price") - F.col("e.open")) / pip, "cost": F.col("e.spread_median_pips") + F.col("x.spread_median_pips") + overhead})
    return r.select("pair", "ts", F.col("e.ts").alias("entry_ts"), F.col("x.ts").alias("exit_ts"), "direction", "relvol", "relrng", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"))


def buy_and_hold_net(bars: DataFrame, capital: float = 10_000.0, swap: float = 0.0, cost: float = 0.0) -> DataFrame:
    """(pair, ts, equity) of units bought at the first close: their value, `swap` a unit for each bar held, less `cost` a unit once."""
    units, held = F.lit(capital) / F.first("close").over(by_ts()), F.row_number().over(by_ts()) - 1
    return bars.select("pair", "ts", (units * (F.col("close") + swap * held - cost)).alias("equity"))


def carry_holds(
    rows: DataFrame, least: float = 0.005, crash: float = 2.0, n: int = 10, median_n: int = 60, haircut: float = 0.5, pip: float = 0.0001, overhead: float = 0.8
) -> DataFrame:
    """Holds of the higher yielder in decision bars (pair, ts, close, spread_median_pips, diff): (pair, entry_ts, exit_ts, direction, days,
    mean_diff, carry, drift, gross, cost, net) in pips.

    The signal is the sign of a differential of over `least`, none where the volatility of n returns is over `crash` times its median of
    median_n bars; it acts on the next bar. A run of one position is a hold. carry: mean |diff| for the days held (1 at least) of a
    year, after the haircut; drift: signed change of the close. cost: turnover costs from the entry bar to the bar that changes the position
    after the hold, which belongs to the hold that ends. Holds whose entry or exit bar has no usable spread are left out."""
    w = by_ts()
    held, wide = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(median_n - 1), 0)
    rows = rows.withColumn("lr", F.log(F.col("close") / F.lag("close").over(w)))
    rows = rows.withColumn("vol", F.when(F.count("lr").over(held) == n, F.stddev_samp("lr").over(held)))
    rows = rows.withColumn("usual", F.when(F.count("vol").over(wide) == median_n, F.percentile("vol", 0.5).over(wide))).withColumn("diff", F.coalesce("diff", F.lit(0.0)))
    calm = ~F.coalesce(F.round("vol", 12) > F.round(F.col("usual") * crash, 12), F.lit(False))
    rows = rows.withColumn("signal", F.when(calm & (F.abs("diff") > least), F.signum("diff")).otherwise(0.0))
    rows = turnover_cost(rows, "spread_median_pips", overhead)
    rows = rows.withColumn("turn", F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(True)).cast("int"))
    rows = rows.withColumns({"run": F.sum("turn").over(w), "next_cost": F.coalesce(F.lead("cost_pips").over(w), F.lit(0.0))})
    bar = F.struct("ts", "close", "spread_median_pips", "next_cost")
    runs = rows.where("position <> 0").groupBy("pair", "run", "position").agg(F.min_by(bar, "ts").alias("a"), F.max_by(bar, "ts").alias("z"), F.avg(F.abs("diff")).alias("mean_diff"), F.sum("cost_pips").alias("own"))
    runs = runs.where("a.spread_median_pips > 0 and z.spread_median_pips > 0")
    runs = runs.withColumn("days", F.floor((F.unix_timestamp("z.ts") - F.unix_timestamp("a.ts")) / 86400))
    runs = runs.withColumns({
        "carry": F.col("mean_diff") * F.greatest("days", F.lit(1)) / 365 * haircut / pip, "drift": F.col("position") * (F.col("z.close") - F.col("a.close")) / pip, "cost": F.col("own") + F.col("z.next_cost"),
    }).withColumn("gross", F.col("carry") + F.col("drift"))
    return runs.select("pair", F.col("a.ts").alias("entry_ts"), F.col("z.ts").alias("exit_ts"), F.col("position").alias("direction"), "days", "mean_diff", "carry", "drift", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"))


#: Name, share of signals replaced, bars of extra delay, multiple of all costs.
STRESSES = [("baseline", 0.0, 0, 1.0), ("randomize_10pct", 0.10, 0, 1.0), ("randomize_25pct", 0.25, 0, 1.0), ("double_costs", 0.0, 0, 2.0), ("extra_delay", 0.0, 1, 1.0)]


def stress_cells(rows: DataFrame, draws: int = 1, stresses: list[tuple[str, float, int, float]] = STRESSES, seed: int = 1) -> DataFrame:
    """Rows (pair, ts, signal, ..) once for each stress and draw, as series `pair#stress#draw` with its signal and `multiplier` of costs. A
    stress that replaces no signals is drawn once. Replaced signals are -1, 0 or +1, from md5, so that any engine repeats them."""
    from tidemark.operators.statistics import uniform

    cells = [(name, share, delay, cost, d) for name, share, delay, cost in stresses for d in range(draws if share else 1)]
    made = F.array(*(F.struct(F.lit(name).alias("stress"), F.lit(float(share)).alias("share"), F.lit(delay).alias("delay"), F.lit(float(cost)).alias("multiplier"), F.lit(d).alias("draw")) for name, share, delay, cost, d in cells))
    rows = rows.withColumn("cell", F.explode(made)).select("*", "cell.*").drop("cell")
    u = lambda tag: uniform(F.lit(f"{seed}|{tag}"), "stress", F.col("draw").cast("string"), "pair", F.unix_timestamp("ts").cast("string"))
    rows = rows.withColumn("signal", F.when(u("hit") < F.col("share"), (F.floor(u("value") * 3) - 1).cast("double")).otherwise(F.col("signal")))
    rows = rows.withColumn("pair", F.concat_ws("#", "pair", "stress", F.col("draw").cast("string")))
    late = {d: F.lag("signal", d, 0.0).over(by_ts()) for d in sorted({c[2] for c in cells} - {0})}
    signal = F.col("signal")
    for d, v in late.items():
        signal = F.when(F.col("delay") == d, v).otherwise(signal)
    return rows.withColumn("signal", signal).drop("share", "delay", "stress", "draw")


def stress_grid(rows: DataFrame, draws: int = 1, stresses: list[tuple[str, float, int, float]] = STRESSES, seed: int = 1, **costs_and_sizer) -> DataFrame:
    """(pair, stress, draw, sharpe, total_return, max_drawdown, trades): stress_cells() of rows (pair, ts, close, signal, atr, spread) through the
    trade job, all cells in one pass."""
    from tidemark.operators import metrics

    cells = stress_cells(rows, draws, stresses, seed)
    trades = priced_trades(cells, multiplier="multiplier", **costs_and_sizer)
    equity = discrete_equity(cells, trades, costs_and_sizer.get("pip", 0.0001), costs_and_sizer.get("capital", 10_000.0))
    returns = equity.withColumn("ret", F.round(F.col("equity") / F.lag("equity").over(by_ts()) - 1, 12))
    s = returns.groupBy("pair").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"))
    out = s.join(metrics.max_drawdown(equity), "pair").join(trades.groupBy("pair").agg(F.count("*").alias("trades")), "pair", "left")
    part = lambda k: F.element_at(F.split("pair", "#"), k)
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * 252**0.5).otherwise(0.0)
    return out.select(part(-3).alias("pair"), part(-2).alias("stress"), part(-1).cast("int").alias("draw"), sharpe.alias("sharpe"), "total_return", "max_drawdown", F.coalesce("trades", F.lit(0)).alias("trades"))


def stress_report(cells: DataFrame) -> DataFrame:
    """(pair, stress, draws, sharpe, worst, below): mean and least Sharpe of the draws of each stress, and the share of them below the
    baseline's."""
    base = cells.where("stress = 'baseline'").select("pair", F.round("sharpe", 9).alias("base"))
    rows = cells.join(base, "pair")
    return rows.groupBy("pair", "stress").agg(F.count("*").alias("draws"), F.avg("sharpe").alias("sharpe"), F.min("sharpe").alias("worst"), F.avg((F.round("sharpe", 9) < F.col("base")).cast("double")).alias("below"))
