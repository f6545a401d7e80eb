"""Performance summaries of return, equity and trade tables, and statistics on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from tidemark.operators import chunks
from tidemark.operators.indicators import bars_per_year as spacing, by_ts, last_n
from tidemark.operators.signals import clip


def equity_from_returns(rows: DataFrame, ret: str = "ret") -> DataFrame:
    return rows.withColumn("equity", F.exp(F.sum(F.log1p(ret)).over(by_ts())))


def summary(rows: DataFrame, ret: str = "ret", bars_per_year: float = 252.0) -> DataFrame:
    """(pair, n, total, sharpe, sortino) of simple returns; Sortino falls back to Sharpe without two losses."""
    root = bars_per_year**0.5
    s = rows.groupBy("pair").agg(
        F.count(ret).alias("n"), F.sum(F.log1p(ret)).alias("lg"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"), F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret))).alias("d"),
    )
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * root).otherwise(0.0)
    return s.select("pair", "n", (F.exp("lg") - 1).alias("total"), sharpe.alias("sharpe"), F.when(F.col("d") > 0, F.col("m") / F.col("d") * root).otherwise(sharpe).alias("sortino"))


def summary_by_spacing(rows: DataFrame, ret: str = "ret") -> DataFrame:
    """summary() with the annual factor of each series taken from the median spacing of its own bars, and that factor (periods_per_year)."""
    own = spacing(rows).select("pair", "periods_per_year")
    root = F.sqrt("periods_per_year")
    return summary(rows, ret, 1.0).join(own, "pair").withColumns({"sharpe": F.col("sharpe") * root, "sortino": F.col("sortino") * root})


def sample_moments(rows: DataFrame, key: str, x: str = "ret") -> DataFrame:
    """(key, n, skew, kurt): skewness and excess kurtosis corrected for the sample's size; null with fewer than 3 and 4 values."""
    s = rows.where(F.col(x).isNotNull()).groupBy(key).agg(F.count(x).cast("double").alias("m"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"))
    m = F.col("m")
    skew = F.when(m > 2, F.sqrt(m * (m - 1)) / F.nullif(m - 2, F.lit(0.0)) * F.col("g"))
    kurt = F.when(m > 3, (m - 1) / F.nullif((m - 2) * (m - 3), F.lit(0.0)) * ((m + 1) * F.col("k") + 6))
    return s.select(key, m.cast("long").alias("n"), skew.alias("skew"), kurt.alias("kurt"))


def cross_pair_aggregate(cells: DataFrame) -> DataFrame:
    """(strategy, cells, sharpe, max_drawdown, trades, bars, skew, kurt) of cells (strategy, sharpe, max_drawdown, trades, bars, skew, kurt): mean
    Sharpe, worst drawdown, summed trades, least bars and mean moments."""
    return cells.groupBy("strategy").agg(
        F.count("*").alias("cells"), F.avg("sharpe").alias("sharpe"), F.max("max_drawdown").alias("max_drawdown"), F.sum("trades").alias("trades"), F.min("bars").alias("bars"), F.avg("skew").alias("skew"), F.avg("kurt").alias("kurt")
    )


def drawdowns(rows: DataFrame) -> DataFrame:
    """Rows with the running peak and the share lost from it, held to [0, 1]."""
    peak = F.max("equity").over(by_ts())
    return rows.withColumn("peak", peak).withColumn("drawdown", clip(1 - F.col("equity") / F.col("peak"), 0.0, 1.0))


def max_drawdown(rows: DataFrame) -> DataFrame:
    return drawdowns(rows).groupBy("pair").agg(F.max("drawdown").alias("max_drawdown"))


def longest_drawdown(rows: DataFrame) -> DataFrame:
    """(pair, days): from the first bar below a peak to the bar back at it, or the last bar; whole days."""
    rows = drawdowns(rows).withColumn("at_peak", F.col("equity") >= F.col("peak"))
    rows = rows.withColumn("island", F.count_if("at_peak").over(by_ts()))
    runs = rows.groupBy("pair", "island").agg(F.min("ts").alias("peak_ts"), F.min(F.when(~F.col("at_peak"), F.col("ts"))).alias("a"), F.max("ts").alias("z"))
    back = F.coalesce(F.lead("peak_ts").over(W.partitionBy("pair").orderBy("island")), F.col("z"))
    runs = runs.withColumn("days", F.floor((F.unix_timestamp(back) - F.unix_timestamp("a")) / 86400))
    return runs.groupBy("pair").agg(F.coalesce(F.max("days"), F.lit(0)).alias("days"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """(pair, trades, win_rate, profit_factor, avg_pips, avg_days): a trade of 0 counts as lost; 99.9 without losses."""
    gain = F.sum(F.when(F.col("pnl_pips") > 0, F.col("pnl_pips")).otherwise(0.0))
    loss = F.sum(F.when(F.col("pnl_pips") <= 0, -F.col("pnl_pips")).otherwise(0.0))
    return trades.groupBy("pair").agg(
        F.count("*").alias("trades"), F.avg((F.col("pnl_pips") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, gain / loss).otherwise(99.9).alias("profit_factor"),
        F.avg("pnl_pips").alias("avg_pips"), F.avg(F.datediff("exit_time", "entry_time")).alias("avg_days"),
    )


def regime_blocks(rows: DataFrame, bars_per_year: float = 252.0) -> DataFrame:
    s = rows.groupBy("pair", F.year("ts").alias("year")).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return s.select("pair", "year", F.when(F.col("s") > 0, F.col("m") / F.col("s") * bars_per_year**0.5).otherwise(0.0).alias("sharpe"))


def portfolio(rows: DataFrame) -> DataFrame:
    """(ts, ret, equity) of equal weights over the series at each time. The running product is summed within spans of time and over them."""
    mean = rows.groupBy("ts").agg(F.avg("ret").alias("ret")).select(F.lit("all").alias("pair"), "ts", "ret", F.log1p("ret").alias("__lr"))
    return chunks.running_sum(mean, "__lr", "__sum").select("ts", "ret", F.exp("__sum").alias("equity"))


def concentration(trades: DataFrame) -> DataFrame:
    """Largest share of absolute pnl of one pair and of one quarter: grouping sets in one pass."""
    keyed = trades.withColumn("quarter", F.date_trunc("quarter", "exit_time"))
    sums = keyed.groupingSets([["pair"], ["quarter"]], "pair", "quarter").agg(F.abs(F.sum("pnl_pips")).alias("p"), F.grouping("pair").alias("by_quarter"))
    return sums.groupBy("by_quarter").agg((F.max("p") / F.sum("p")).alias("share")).select(F.when(F.col("by_quarter") == 1, "quarter").otherwise("pair").alias("by"), "share")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation by series with average ranks for ties."""
    def rank(c: str):
        w = W.partitionBy("pair")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(w.partitionBy("pair", c)) - 1) / 2

    return rows.withColumns({"rx": rank(x), "ry": rank(y)}).groupBy("pair").agg(F.corr("rx", "ry").alias("rho"))


def newey_west(rows: DataFrame, x: str, lags: int) -> DataFrame:
    """(pair, n, mean, se): Bartlett weights; the long-run variance is 1e-12 at least."""
    centred = rows.join(rows.groupBy("pair").agg(F.avg(x).alias("mean"), F.count(x).alias("n")), "pair").withColumn("e", F.col(x) - F.col("mean"))
    sums = [F.sum(F.col("e") * F.col("e")).alias("g0")]
    for k in range(1, lags + 1):
        centred = centred.withColumn(f"e{k}", F.lag("e", k).over(by_ts()))
        sums.append(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}"))
    g = centred.groupBy("pair", "n", "mean").agg(*sums)
    total = F.col("g0")
    for k in range(1, lags + 1):
        total = total + F.coalesce(F.col(f"g{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1)))
    return g.select("pair", "n", "mean", F.sqrt(F.greatest(total / F.col("n"), F.lit(1e-12)) / F.col("n")).alias("se"))


def window_placement(rows: DataFrame, n: int, bars_per_year: float = 252.0) -> DataFrame:
    """(pair, windows, last_sharpe, percentile, median_sharpe): Sharpe of the last n rows among all windows of n; the median is annual."""
    w = last_n(n)
    s = F.when(F.count("ret").over(w) == n, F.avg("ret").over(w) / F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0)))
    return _placed(rows.withColumn("s", F.round(s, 12)), bars_per_year)


def _placed(rows: DataFrame, bars_per_year: float) -> DataFrame:
    rows = rows.where("s is not null")
    rows = rows.join(rows.groupBy("pair").agg(F.max_by("s", "ts").alias("last_sharpe")), "pair")
    return rows.groupBy("pair", "last_sharpe").agg(F.count("*").alias("windows"), F.avg((F.col("s") <= F.col("last_sharpe")).cast("double")).alias("percentile"), (F.percentile("s", 0.5) * bars_per_year**0.5).alias("median_sharpe"))


def placement_after(rows: DataFrame, cutoff, bars_per_year: float = 252.0) -> DataFrame:
    """(pair, size, windows, last_sharpe, percentile, median_sharpe): window_placement() with windows as long as each series' own part at or
    after the cutoff. Windows of any length come from sums up to each row, less those `size` rows before (values less the series' mean,
    so that the sums stay small)."""
    part = rows.where("ret is not null").groupBy("pair").agg(F.avg("ret").alias("mean"), F.count_if(F.col("ts") >= F.lit(cutoff).cast("timestamp")).alias("size")).where("size > 1")
    held = rows.where("ret is not null").join(part, "pair").withColumn("e", F.col("ret") - F.col("mean"))
    held = held.select("pair", "ts", "size", "mean", F.row_number().over(by_ts()).alias("i"), F.sum("e").over(by_ts()).alias("a"), F.sum(F.col("e") * F.col("e")).over(by_ts()).alias("b"))
    before = held.select("pair", (F.col("i") + F.col("size")).alias("i"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    held = held.where("i >= size").join(before, ["pair", "i"], "left").na.fill(0.0, ["a0", "b0"])
    total, square, n = F.col("a") - F.col("a0"), F.col("b") - F.col("b0"), F.col("size")
    var = (square - total * total / n) / (n - 1)
    s = F.when(var > 1e-18, (F.col("mean") + total / n) / F.sqrt(var))
    sizes = part.select("pair", "size")
    return _placed(held.withColumn("s", F.round(s, 12)), bars_per_year).join(sizes, "pair")


def drawdown_catalogue(rows: DataFrame, least: float = 0.05) -> DataFrame:
    """(pair, peak_ts, trough_ts, recovery_ts, depth) of drawdowns of at least `least`; recovery is null while none. Rank 1 is the worst."""
    rows = drawdowns(rows).withColumn("island", F.count_if(F.col("equity") >= F.col("peak")).over(by_ts()))
    runs = rows.groupBy("pair", "island").agg(F.min("ts").alias("peak_ts"), F.max("drawdown").alias("depth"), F.max_by("ts", F.struct("drawdown", -F.unix_timestamp("ts"))).alias("trough_ts"))
    runs = runs.withColumn("recovery_ts", F.lead("peak_ts").over(W.partitionBy("pair").orderBy("island"))).where(F.col("depth") >= least)
    return runs.drop("island").withColumn("rank", F.row_number().over(W.partitionBy("pair").orderBy(F.desc("depth"), "peak_ts")))


#: Depths between which drawdowns are counted.
DEPTHS = (0.05, 0.07, 0.10, 0.15, 0.20, 0.50)


def drawdown_details(rows: DataFrame, least: float = 0.05, at_peak: tuple[str, ...] = ()) -> DataFrame:
    """drawdown_catalogue() with the equity at peak and trough, the whole days from peak to trough and from trough to recovery (null while
    none), and the columns `at_peak` as they were at the peak."""
    held = drawdowns(rows).withColumn("island", F.count_if(F.col("equity") >= F.col("peak")).over(by_ts()))
    runs = held.groupBy("pair", "island").agg(
        F.min("ts").alias("peak_ts"), F.min_by(F.struct("equity", *at_peak), "ts").alias("p"), F.max("drawdown").alias("depth"), F.max_by(F.struct("ts", "equity"), F.struct("drawdown", -F.unix_timestamp("ts"))).alias("t")
    )
    runs = runs.withColumn("recovery_ts", F.lead("peak_ts").over(W.partitionBy("pair").orderBy("island"))).where(F.col("depth") >= least)
    days = lambda a, b: F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 86400)
    runs = runs.select(
        "pair", "peak_ts", F.col("t.ts").alias("trough_ts"), "recovery_ts", "depth", F.col("p.equity").alias("peak_equity"), F.col("t.equity").alias("trough_equity"),
        days("peak_ts", "t.ts").alias("days_down"), days("t.ts", "recovery_ts").alias("days_up"), *[F.col(f"p.{c}").alias(c) for c in at_peak],
    )
    return runs.withColumn("rank", F.row_number().over(W.partitionBy("pair").orderBy(F.desc("depth"), "peak_ts")))


def drawdown_histogram(details: DataFrame, depths: tuple[float, ...] = DEPTHS) -> DataFrame:
    """(pair, over, upto, drawdowns, unrecovered, days): counts of drawdowns by depth, over one depth and up to the next."""
    cells = F.array(*(F.struct(F.lit(a).alias("over"), F.lit(b).alias("upto")) for a, b in zip(depths, depths[1:])))
    rows = details.select("pair", "depth", "recovery_ts", "days_down", F.explode(F.filter(cells, lambda c: (F.col("depth") > c["over"]) & (F.col("depth") <= c["upto"]))).alias("c"))
    return rows.groupBy("pair", "c.over", "c.upto").agg(F.count("*").alias("drawdowns"), F.count_if(F.col("recovery_ts").isNull()).alias("unrecovered"), F.sum("days_down").alias("days"))


def vol_weighted(rows: DataFrame, target: float, cap: float = 5.0) -> DataFrame:
    """(ts, ret) with weights least(target / volatility, cap), normalised over the series; one weight a series."""
    vol = rows.groupBy("pair").agg(F.stddev_samp("ret").alias("s")).withColumn("w", F.when(F.col("s") > 0, F.least(F.lit(target) / F.col("s"), F.lit(cap))).otherwise(0.0))
    r = rows.join(vol, "pair")
    return r.groupBy("ts").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("ret")), F.sum("w")), F.lit(0.0)).alias("ret"))


def rolling_basket(rows: DataFrame, target: float, n: int) -> DataFrame:
    """(ts, ret): mean over series of the return times the lagged target / rolling volatility."""
    w = last_n(n)
    std = F.when(F.count("ret").over(w) == n, F.stddev_samp("ret").over(w))
    r = rows.withColumn("k", F.when(std > 0, target / std)).withColumn("scaled", F.col("ret") * F.lag("k").over(by_ts()))
    return r.where("scaled is not null").groupBy("ts").agg(F.avg("scaled").alias("ret"))


def cross_pair(cells: DataFrame) -> DataFrame:
    """(strategy, cells, mean_sharpe, worst_drawdown, least_bars)"""
    return cells.groupBy("strategy").agg(F.count("*").alias("cells"), F.avg("sharpe").alias("mean_sharpe"), F.max("max_drawdown").alias("worst_drawdown"), F.min("bars").alias("least_bars"))


def execution_report(fills: DataFrame) -> DataFrame:
    """(pair, fills, success, avg_slippage, avg_spread) and the overall row (null pair): rollup in one pass."""
    return fills.rollup("pair").agg(
        F.count("*").alias("fills"), F.avg(F.col("success").cast("double")).alias("success"), F.avg("slippage_pips").alias("avg_slippage"), F.avg("spread_at_fill").alias("avg_spread")
    )


def go_no_go(stats: DataFrame, least_sharpe: float = 0.5, least_trades: int = 30) -> DataFrame:
    """Adds `edge` by cell and `go`, true for all when any cell has an edge."""
    rows = stats.withColumn("edge", (F.col("sharpe") > least_sharpe) & (F.col("trades") >= least_trades))
    return rows.crossJoin(F.broadcast(rows.agg(F.bool_or("edge").alias("go"))))  # one row


def correlations(rows: DataFrame) -> DataFrame:
    """(a, b, n, rho) of series at shared times, a < b: an equi-join on the time; the result has one row for each pair of series."""
    x, y = rows.select("ts", F.col("pair").alias("a"), F.col("ret").alias("x")), rows.select("ts", F.col("pair").alias("b"), F.col("ret").alias("y"))
    return x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))


def effective_bets(matrix: DataFrame) -> DataFrame:
    """(series, mean_rho, effective): participation ratio of the eigenvalues, k^2 over the sum of squared correlations."""
    s = matrix.agg(F.sum(F.col("rho") * F.col("rho")).alias("q"), F.avg("rho").alias("mean_rho"), F.count("*").alias("m"))
    k = (1 + F.sqrt(1 + 8 * F.col("m"))) / 2
    return s.select(k.cast("long").alias("series"), "mean_rho", (k * k / (k + 2 * F.col("q"))).alias("effective"))


def stratified(rows: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(pair, x_high, y_high, n, mean) by the medians of x and y."""
    mid = rows.groupBy("pair").agg(F.percentile(x, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"))
    r = rows.join(mid, "pair").withColumns({"x_high": F.col(x) > F.col("mx"), "y_high": F.col(y) > F.col("my")})
    return r.groupBy("pair", "x_high", "y_high").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def gates(trades: DataFrame, least_trades: int, least_hit: float, least_net: float) -> DataFrame:
    """(pair, trades, hit, net, gate): the first gate that a trade table fails, else pass."""
    t = trades.groupBy("pair").agg(F.count("*").alias("trades"), F.avg((F.col("pnl_pips") > 0).cast("double")).alias("hit"), F.avg("pnl_pips").alias("net"))
    return t.withColumn("gate", F.when(F.col("trades") < least_trades, "power").when(F.col("hit") < least_hit, "hit_rate").when(F.col("net") < least_net, "net_pips").otherwise("pass"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """(pair, direction, bars, share, next_ret, hit): time in the market and the next bar's return by direction."""
    nxt = F.lead("close").over(by_ts()) / F.col("close") - 1
    r = rows.withColumn("direction", F.signum("signal").cast("int")).withColumn("nxt", nxt)
    d = r.groupBy("pair", "direction").agg(F.count("*").alias("bars"), F.avg("nxt").alias("next_ret"), F.avg((F.col("nxt") * F.col("direction") > 0).cast("double")).alias("hit"))
    return d.withColumn("share", F.col("bars") / F.sum("bars").over(W.partitionBy("pair")))


def family_screen(rows: DataFrame, pip: float = 0.0001, overhead: float = 0.8, bars_per_year: float = 6150.0) -> DataFrame:
    """(pair, family, gross_sharpe, net_sharpe, turnover, verdict) in pips by rule and series. Bars without a usable spread earn nothing and
    carry no spread. Verdict bands of the net Sharpe: PASS from 1.76, STRETCH from 1.44, else FAIL."""
    r = family_pips(rows, pip, overhead)
    def sharpe(x: str):
        return F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * bars_per_year**0.5)

    s = r.groupBy("pair", "family").agg(sharpe("gross").alias("gross_sharpe"), sharpe("net").alias("net_sharpe"), F.sum("turn").alias("turnover"))
    return s.withColumn("verdict", F.when(F.round("net_sharpe", 6) >= 1.76, "PASS").when(F.round("net_sharpe", 6) >= 1.44, "STRETCH").otherwise("FAIL"))


def family_pips(rows: DataFrame, pip: float = 0.0001, overhead: float = 0.8) -> DataFrame:
    """rows (pair, ts, close, spread_median_pips, family, signal) with turn, gross and net in pips."""
    w = W.partitionBy("pair", "family").orderBy("ts")
    r = rows.withColumn("position", F.lag("signal", 1, 0.0).over(w))
    usable = F.coalesce(F.col("spread_median_pips") > 0, F.lit(False))
    gross = F.coalesce(F.col("position") * F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0)) / pip
    r = r.withColumns({"turn": F.abs(F.col("position") - F.lag("position", 1).over(w)), "gross": F.when(usable, gross).otherwise(0.0), "spread": F.when(usable, F.col("spread_median_pips")).otherwise(0.0)})
    r = r.withColumn("turn", F.coalesce("turn", F.lit(0.0)))
    return r.withColumn("net", F.col("gross") - F.col("turn") * (F.col("spread") + overhead))


def family_summary(rows: DataFrame, subset: list[str], bars_per_year: float = 6150.0) -> DataFrame:
    """(family, least, middle, most, positive, portfolio, portfolio_subset): net Sharpes over the series, how many are over 0, and the
    Sharpe of the mean net pips of all series, and of a subset, at the times that all of them share."""
    cells = family_screen(rows, bars_per_year=bars_per_year).withColumn("x", F.round("net_sharpe", 9))
    over = cells.groupBy("family").agg(F.min("x").alias("least"), F.percentile("x", 0.5).alias("middle"), F.max("x").alias("most"), F.count_if(F.col("x") > 0).alias("positive"))
    r = family_pips(rows)
    for name, part in (("portfolio", r), ("portfolio_subset", r.where(F.col("pair").isin(subset)))):
        series = part.select("family", "pair").distinct().groupBy("family").agg(F.count("*").alias("k"))
        mean = part.groupBy("family", "ts").agg(F.avg("net").alias("m"), F.count("*").alias("n")).join(series, "family").where("n = k")
        s = F.when(F.stddev_samp("m") > 0, F.avg("m") / F.stddev_samp("m") * bars_per_year**0.5)
        over = over.join(mean.groupBy("family").agg(s.alias(name)), "family", "left")
    return over


def volatility_control(trades: DataFrame, y: str = "gross", x1: str = "relvol", x2: str = "relrng", least: int = 10) -> DataFrame:
    """(pair, n, b1, t1, b2, t2, r2, passes) of the regression of y on the ranks of x1 and x2 (ties take their mean rank) by series; null below
    `least` rows. passes: t1 is 2 or more. The coefficients come from centred sums, so no row leaves its aggregation."""
    def rank(c: str):
        w = W.partitionBy("pair")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(w.partitionBy("pair", c)) - 1) / 2

    r = trades.withColumns({"a": rank(x1), "b": rank(x2), "y": F.col(y)})
    s = r.groupBy("pair").agg(
        F.count("*").alias("n"), *[(F.covar_pop(p, q) * F.count("*")).alias(f"{p}{q}") for p, q in (("a", "a"), ("b", "b"), ("a", "b"), ("a", "y"), ("b", "y"), ("y", "y"))]
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("det", F.when((det > 1e-9) & (F.col("n") >= least), det))
    s = s.withColumns({"b1": (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / F.col("det"), "b2": (F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / F.col("det")})
    s = s.withColumn("rest", F.col("yy") - F.col("b1") * F.col("ay") - F.col("b2") * F.col("by"))
    var = F.col("rest") / F.greatest(F.col("n") - 3, F.lit(1))
    t1, t2 = (F.try_divide(F.col(b), F.sqrt(var * F.col(d) / F.col("det"))) for b, d in (("b1", "bb"), ("b2", "aa")))
    s = s.withColumns({"t1": t1, "t2": t2, "r2": 1 - F.try_divide("rest", "yy")})
    return s.select("pair", "n", "b1", "t1", "b2", "t2", "r2", F.coalesce(F.round("t1", 9) >= 2, F.lit(False)).alias("passes"))


def annualised(equity: DataFrame) -> DataFrame:
    """(pair, total, annual): growth over the whole series and a year of 365.25 days; -1 where all is lost."""
    ends = equity.groupBy("pair").agg(F.min_by("equity", "ts").alias("a"), F.max_by("equity", "ts").alias("z"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    total = F.col("z") / F.col("a") - 1
    years = F.greatest(F.col("days") / 365.25, F.lit(1e-6))
    return ends.select("pair", total.alias("total"), F.when(total <= -1, -1.0).otherwise(F.pow(1 + total, 1 / years) - 1).alias("annual"))


def exposure_share(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(pair, exposure): time inside trades over the time of the series."""
    span = bars.groupBy("pair").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("all"))
    held = trades.groupBy("pair").agg(F.sum(F.unix_timestamp("exit_time") - F.unix_timestamp("entry_time")).alias("held"))
    return span.join(held, "pair", "left").select("pair", F.coalesce(F.try_divide("held", "all"), F.lit(0.0)).alias("exposure"))


def regime_consistency(rows: DataFrame, bars_per_year: float = 252.0) -> DataFrame:
    """(pair, blocks, positive): years, and those with a Sharpe over 0."""
    s = regime_blocks(rows, bars_per_year).withColumn("x", F.round("sharpe", 9))
    return s.groupBy("pair").agg(F.count("*").alias("blocks"), F.count_if(F.col("x") > 0).alias("positive"))


def weighting_report(rows: DataFrame, target: float, bars_per_year: float = 252.0) -> DataFrame:
    """(weighting, sharpe, max_drawdown) of the series' portfolio by volatility weights and by equal ones. A portfolio is one narrow row a
    time; its drawdown runs along them."""
    both = vol_weighted(rows, target).select(F.lit("volatility").alias("pair"), "ts", "ret").unionByName(rows.groupBy("ts").agg(F.avg("ret").alias("ret")).select(F.lit("equal").alias("pair"), "ts", "ret"))
    std = F.stddev_samp("ret")
    risk = both.groupBy("pair").agg(F.when(std > 0, F.avg("ret") / std * bars_per_year**0.5).otherwise(0.0).alias("sharpe"))
    return risk.join(max_drawdown(equity_from_returns(both)), "pair").withColumnRenamed("pair", "weighting")


def independent_bets(matrix: DataFrame, most: int = 2000) -> DataFrame:
    """(series, top_share, participation, entropy, effective) of a correlation table (a, b, rho) of up to `most` series, whose k x k matrix
    alone comes to the driver: share of the largest eigenvalue, participation ratio, exponential of the entropy, and the least of
    1 / top_share and these two."""
    import numpy as np

    names = sorted({r["s"] for r in matrix.select(F.col("a").alias("s")).union(matrix.select("b")).distinct().limit(most + 1).collect()})
    if len(names) > most:
        raise ValueError(f"more than {most} series")
    at, m = {n: i for i, n in enumerate(names)}, np.eye(len(names))
    for r in matrix.select("a", "b", "rho").collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["rho"] or 0.0
    value = np.maximum(np.linalg.eigvalsh(m), 0)
    share = value / value.sum()
    entropy = float(np.exp(-(share[share > 0] * np.log(share[share > 0])).sum()))
    participation, top = float(1 / (share * share).sum()), float(share.max())
    row = [(len(names), top, participation, entropy, min(1 / top, participation, entropy))]
    return matrix.sparkSession.createDataFrame(row, "series long, top_share double, participation double, entropy double, effective double")


def volume_range(rows: DataFrame) -> DataFrame:
    """(pair, raw, relative, r2_log) of rows (volume, rng, relvol, relrng): rank correlations, and the squared correlation of the logarithms of
    1 + the relative values."""
    both = spearman(rows, "volume", "rng").withColumnRenamed("rho", "raw").join(spearman(rows, "relvol", "relrng").withColumnRenamed("rho", "relative"), "pair")
    logs = rows.groupBy("pair").agg(F.pow(F.corr(F.log1p("relvol"), F.log1p("relrng")), 2).alias("r2_log"))
    return both.join(logs, "pair")


def screen_verdict(trades: DataFrame, gross: str = "gross", cost: str = "cost") -> DataFrame:
    """(pair, trades, ratio, verdict, fires_per_year): mean gross over mean cost is FAIL up to 0.8, STRETCH up to 1, else PASS."""
    s = trades.groupBy("pair").agg(
        F.count("*").alias("trades"), F.try_divide(F.avg(gross), F.avg(cost)).alias("ratio"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / (365.25 * 86400)).alias("years"),
    )
    ratio = F.round("ratio", 9)
    verdict = F.when(ratio.isNull(), None).when(ratio <= 0.8, "FAIL").when(ratio <= 1.0, "STRETCH").otherwise("PASS")
    return s.select("pair", "trades", "ratio", verdict.alias("verdict"), F.try_divide(F.col("trades"), F.col("years")).alias("fires_per_year"))


def power_gate(trades: DataFrame, bars: DataFrame, days: float, needed: int) -> DataFrame:
    """(pair, per_day, expected, enough): trades a day of the series' span, what they come to in so many days, and whether that is enough."""
    span = bars.groupBy("pair").agg(F.greatest(F.datediff(F.max("ts"), F.min("ts")), F.lit(1)).alias("d"))
    n = trades.groupBy("pair").agg(F.count("*").alias("n"))
    rows = span.join(n, "pair", "left").withColumn("per_day", F.coalesce("n", F.lit(0)) / F.col("d"))
    return rows.select("pair", "per_day", (F.col("per_day") * days).alias("expected"), (F.round(F.col("per_day") * days, 9) >= needed).alias("enough"))


def side_totals(trades: DataFrame) -> DataFrame:
    """(pair, direction, trades, pips) of long and short trades."""
    return trades.groupBy("pair", "direction").agg(F.count("*").alias("trades"), F.sum("pnl_pips").alias("pips"))


def fold_average(folds: DataFrame, weight: str = "n_test") -> DataFrame:
    """(pair, folds, mean): Sharpe over folds, weighted by what each tested."""
    return folds.groupBy("pair").agg(F.count("*").alias("folds"), F.try_divide(F.sum(F.col("sharpe") * F.col(weight)), F.sum(weight)).alias("mean"))


def low_sharpe_clause(rows: DataFrame, x: str = "sharpe", last: int = 90, least: float = 0.20) -> DataFrame:
    """(pair, met, lowest, below) over the last rows of each series: whether any rolling Sharpe is under `least`, the lowest, and how many."""
    recent = rows.withColumn("n", F.row_number().over(W.partitionBy("pair").orderBy(F.desc("ts")))).where(F.col("n") <= last).withColumn("v", F.round(x, 9))
    return recent.groupBy("pair").agg(F.coalesce(F.bool_or(F.col("v") < least), F.lit(False)).alias("met"), F.min("v").alias("lowest"), F.count_if(F.col("v") < least).alias("below"))
