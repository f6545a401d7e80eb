"""Mixing sources to target weights by iterative proportional fitting (raking) of token weights."""

from __future__ import annotations

import json
import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.shared import free_names, materialise

#: Raking ends when no margin value misses its goal by more than this share of the drawn tokens.
TOLERANCE = 1e-5
#: Up to so many cells (a row for each combination of margin values) are fitted on the driver, by exact steps, in MOST sweeps at most. A
#: larger table is fitted where it lies, within COARSE; it is looked at after every SWEEPS sweeps, ROUNDS times at most.
DRIVER_CELLS, MOST = 50_000, 300
COARSE, SWEEPS, ROUNDS = 2e-4, 4, 60
#: How far goals that the cells cannot meet together move towards the shares as found, which equal probabilities always meet.
STEPS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Cells are broadcast up to so many; above it documents meet them in a salted join.
BROADCAST_CELLS, SALTS = 100_000, 16
MARGINS = ["source", "lang", "topic"]

logger = logging.getLogger(__name__)


def token_count(text: Column) -> Column:
    """White-space separated tokens; 0 for null and blank texts."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def topic_of(text: Column) -> Column:
    """Kind of content, from the whole text: table (bars), symbols (other marks), short or long prose. A stand-in for a topic model's
    label; the operator takes any column of that name."""
    body = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(body), F.lit(1))
    bars = F.length(body) - F.length(F.translate(body, "|", ""))
    marks = F.length(body) - F.length(F.translate(body, "!*$%&#", ""))
    return F.when(bars * 50 > n, "table").when(marks * 50 > n, "symbols").when(n < 1000, "short prose").otherwise("long prose")


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the record's key and content alone, so that reruns and lost executors draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def margin_values(cells: DataFrame, power: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """(margin, value, held, wanted): tokens and wanted share of every margin value. Without targets the share goes with tokens raised to
    `power` (1: as found, 0: all equal). A value that holds tokens and has no target is an error."""
    parts = [cells.groupBy(F.col(m).cast("string").alias("value")).agg(F.sum("tokens").alias("held")).select(F.lit(m).alias("margin"), "value", "held") for m in MARGINS]
    held = parts[0].union(parts[1]).union(parts[2]).where("held > 0")
    if targets is None:
        raised = F.pow(F.col("held").cast("double"), F.lit(power))
    else:
        given = [targets[m].select(F.lit(m).alias("m"), F.col(m).cast("string").alias("v"), F.col("share").cast("double").alias("raised")) for m in MARGINS]
        given = given[0].union(given[1]).union(given[2])
        held = held.join(given, (F.col("margin") == F.col("m")) & F.col("value").eqNullSafe(F.col("v")), "left").drop("m", "v")
        lacking = held.where("raised is null").select("margin", "value").limit(5).collect()
        if lacking:
            raise ValueError(f"margin values without a target share: {[tuple(r) for r in lacking]}")
        raised = F.col("raised")
    held = held.withColumn("raised", raised)
    sums = held.groupBy("margin").agg(F.sum("raised").alias("sum"))
    return held.join(sums, "margin").select("margin", "value", "held", F.coalesce(F.try_divide("raised", "sum"), F.lit(0.0)).alias("wanted"))


def feasible(shares: np.ndarray, held: np.ndarray, budget: float) -> np.ndarray:
    """Tokens for each value in proportion to the shares, none above what it holds; what a capped value cannot supply goes to the others
    in proportion to theirs."""
    out, free, left = np.zeros(len(held)), (shares > 0) & (held > 0), budget
    while free.any():
        want = np.where(free, shares * left / shares[free].sum(), 0.0)
        over = free & (want >= held)
        if not over.any():
            return out + want
        out[over], left, free = held[over], left - held[over].sum(), free & ~over
    return out


def factor(other: np.ndarray, tokens: np.ndarray, target: float) -> float:
    """The a with sum(tokens * min(1, a * other)) = target; where target is all tokens, the least a that takes every cell whole."""
    order = np.argsort(-other)
    o, t = other[order], tokens[order]
    whole = np.cumsum(t) - t  # the k largest are taken whole
    a = (target - whole) / np.cumsum((t * o)[::-1])[::-1]
    fits = np.flatnonzero(a * o <= 1)
    return float(a[fits[0]]) if len(fits) else float(1 / o[-1])


def solve(at: list[np.ndarray], t: np.ndarray, goals: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Probabilities min(1, product of one factor a margin value) of the cells, by exact steps over the values of each margin, and the
    largest miss in tokens."""
    rows = []
    for i in at:  # cells of each value
        order = np.argsort(i, kind="stable")
        values, first = np.unique(i[order], return_index=True)
        rows.append(list(zip(values, np.split(order, first[1:]))))
    factors = [np.ones(len(g)) for g in goals]
    p, worst = np.ones(len(t)), np.inf
    for _ in range(MOST):
        for m in range(len(at)):
            other = np.prod([factors[k][at[k]] for k in range(len(at)) if k != m], axis=0)
            for v, cell in rows[m]:
                factors[m][v] = factor(other[cell], t[cell], goals[m][v])
            p = np.minimum(1.0, other * factors[m][at[m]])
        worst = max(np.abs(np.bincount(i, t * p, len(g)) - g).max() for i, g in zip(at, goals))
        if worst <= TOLERANCE * t @ p:
            break
    return p, worst


def fit(cells: list[tuple], tokens: np.ndarray, wanted: list[dict], budget: float) -> tuple[np.ndarray, list[tuple]]:
    """Probabilities of drawable cells (one value a margin) and the report (margin, value, wanted, target, reached)."""
    names = [list(w) for w in wanted]
    places = [{v: i for i, v in enumerate(n)} for n in names]
    at = [np.array([x[c[m]] for c in cells], int) for m, x in enumerate(places)]
    shares = [np.array([w[v] for v in n]) for n, w in zip(names, wanted)]
    capped = [feasible(x, np.bincount(i, tokens, len(x)), budget) for x, i in zip(shares, at)]
    found = [np.bincount(i, tokens, len(x)) * (budget / max(tokens.sum(), 1.0)) for x, i in zip(shares, at)]
    p, goals = np.zeros(len(tokens)), capped
    for step in STEPS if budget > 0 else ():
        goals = [(1 - step) * x + step * y for x, y in zip(capped, found)]
        p, worst = solve(at, tokens, goals)
        if worst <= TOLERANCE * budget:
            _tell(step)
            break
    report = []
    for m, n, x, g, i in zip(MARGINS, names, shares, goals, at):
        got = np.bincount(i, tokens * p, len(n))
        report += [(m, v, float(x[k]), float(g[k] / budget) if budget else 0.0, float(got[k] / budget) if budget else 0.0) for k, v in enumerate(n)]
    return p, report


def _tell(step: float) -> None:
    if step:
        logger.warning("the margins cannot be reached together; goals moved by %s towards the shares as found", step)


# ---- the same where the cells lie ------------------------------------------------------------------------------------------------


def capped_goals(values: DataFrame, budget: float) -> DataFrame:
    """values with `goal`: the budget in proportion to the wanted shares, no value above what it holds; what a held value cannot supply
    goes to the others of its margin in proportion to theirs. The level of each margin rises until the held values stay the same."""
    levels = {m: budget for m in MARGINS}
    while True:
        level = F.create_map(*[F.lit(x) for m, v in levels.items() for x in (m, float(v))])[F.col("margin")]
        goal = F.least(F.col("held").cast("double"), F.col("wanted") * level)
        full = F.col("wanted") * level >= F.col("held")
        sums = values.where("wanted > 0").groupBy("margin").agg(
            F.sum(F.when(full, F.col("held")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("wanted"))).alias("free")
        ).collect()
        now = {r["margin"]: max((budget - r["full"]) / r["free"], levels[r["margin"]]) if r["free"] > 0 else levels[r["margin"]] for r in sums}
        if all(abs(now[m] - levels[m]) <= 1e-12 * levels[m] for m in now):
            return values.withColumn("goal", goal)
        levels |= now


def sweep(cells: DataFrame) -> DataFrame:
    """One sweep over the margins: weights of a value are scaled to its goal and held at the cell's tokens; where they have to grow, only
    those that are not held yet are scaled. Windows run over the cells of one margin value."""
    for m in MARGINS:
        w = W.partitionBy(m)
        held, goal = F.col("weight") >= F.col("tokens") * (1 - 1e-12), F.col(f"goal_{m}")
        cells = cells.withColumns({"__sum": F.sum("weight").over(w), "__held": F.sum(F.when(held, F.col("weight")).otherwise(0.0)).over(w)})
        grow = F.coalesce(F.try_divide(goal - F.col("__held"), F.col("__sum") - F.col("__held")), F.lit(1.0))
        shrink = F.coalesce(F.try_divide(goal, F.col("__sum")), F.lit(0.0))
        scaled = F.when(goal < F.col("__sum"), F.col("weight") * shrink).when(held, F.col("weight")).otherwise(F.col("weight") * grow)
        cells = cells.withColumn("weight", F.least(scaled, F.col("tokens").cast("double")))
    return cells.drop("__sum", "__held")


def _by_margin(cells: DataFrame, x: str) -> DataFrame:
    """(margin, value, sum of x)."""
    parts = [cells.groupBy(F.col(m).alias("value")).agg(F.sum(x).alias(x)).select(F.lit(m).alias("margin"), "value", x) for m in MARGINS]
    return parts[0].union(parts[1]).union(parts[2])


def _beside(cells: DataFrame, values: DataFrame, x: str) -> DataFrame:
    """cells with x_<margin>, the value of x in the margin table (margin, value, x) for the cell's own values."""
    for m in MARGINS:
        own = values.where(F.col("margin") == m).select(F.col("value").alias("v"), F.col(x).alias(f"{x}_{m}"))
        cells = cells.join(own, F.col(m).eqNullSafe(F.col("v")), "left").drop("v")
    return cells


def _table(spark: SparkSession, names: list[str], strings: int, rows: list[tuple]) -> DataFrame:
    """A table of few rows from the driver, whose first columns are strings and the others doubles."""
    kind = ", ".join(f"{n}: {'string' if i < strings else 'double'}" for i, n in enumerate(names))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{kind}>>")))


def rake(cells: DataFrame, fraction: float, power: float = 0.5, targets: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, lang, topic, probability) of the cells of a table (source, lang, topic, tokens) that can be drawn, and the report (margin,
    value, wanted, target, reached): wanted shares, what is left of them after capping and moving, and what the probabilities give, all as
    shares of the drawn tokens.

    Goals are capped at what each value holds. Sweeps go on until all goals are met (TOLERANCE on the driver, COARSE beyond DRIVER_CELLS); goals that the cells cannot meet
    together move in STEPS towards the shares as found. Cells without tokens, or with a value of share 0, are not drawn.
    """
    cells = materialise(cells.select(*[F.col(m).cast("string").alias(m) for m in MARGINS], "tokens"), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = margin_values(cells, power, targets).select("margin", "value", "wanted")
    used = _beside(cells, wanted, "wanted").where("tokens > 0 and wanted_source > 0 and wanted_lang > 0 and wanted_topic > 0")
    used = materialise(used.select(*MARGINS, "tokens"), "used")
    drawable = used.agg(F.sum("tokens")).first()[0] or 0
    budget = min(fraction * total, drawable)
    held = _by_margin(used, "tokens").select(F.col("margin").alias("m"), F.col("value").alias("v"), F.col("tokens").alias("held"))
    values = wanted.join(held, (F.col("margin") == F.col("m")) & F.col("value").eqNullSafe(F.col("v")), "left").select("margin", "value", "wanted", F.coalesce("held", F.lit(0)).alias("held"))
    values = materialise(values, "values")
    if used.count() + values.count() <= DRIVER_CELLS:
        rows, shares = used.collect(), [{r["value"]: r["wanted"] for r in values.collect() if r["margin"] == m} for m in MARGINS]
        keys = [tuple(r[m] for m in MARGINS) for r in rows]
        chances, report = fit(keys, np.array([r["tokens"] for r in rows], float), shares, budget)
        fitted = [(*k, float(p)) for k, p in zip(keys, chances)]
        return _table(cells.sparkSession, [*MARGINS, "probability"], 3, fitted), _table(cells.sparkSession, ["margin", "value", "wanted", "target", "reached"], 2, report)
    values = materialise(capped_goals(values, budget), "goals")
    share = budget / drawable if drawable else 0.0
    state, goals = used.withColumn("weight", F.col("tokens") * share), values
    for step in STEPS if budget > 0 else ():
        goals = values.withColumn("goal", F.col("goal") * (1 - step) + F.col("held") * (share * step))
        state, last, miss = _beside(used, goals, "goal").withColumn("weight", F.col("tokens") * share), None, None
        for _ in range(ROUNDS):
            for _ in range(SWEEPS):
                state = sweep(state)
            state = materialise(state, "raked")
            got = _by_margin(state, "weight").select(F.col("margin").alias("m"), F.col("value").alias("v"), "weight")
            met = goals.join(got, (F.col("margin") == F.col("m")) & F.col("value").eqNullSafe(F.col("v")))
            last, miss = miss, met.agg(F.max(F.abs(F.col("weight") - F.col("goal")))).first()[0] / budget
            if miss <= COARSE or last is not None and miss > 0.95 * last:
                break
        if miss <= COARSE:
            _tell(step)
            break
    reached = _by_margin(state, "weight").select(F.col("margin").alias("m"), F.col("value").alias("v"), F.col("weight").alias("got"))
    part = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0.0)), F.lit(float(budget))), F.lit(0.0))
    report = goals.join(reached, (F.col("margin") == F.col("m")) & F.col("value").eqNullSafe(F.col("v")), "left")
    report = report.select("margin", "value", "wanted", part(F.col("goal")).alias("target"), part(F.col("got")).alias("reached"))
    return materialise(state.select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("probability")), "fitted"), report


def _with_probability(rows: DataFrame, fitted: DataFrame, at: dict[str, str], salt_of: list[str], out: str) -> DataFrame:
    """rows with the probability of their cell; at: the column of rows that holds each margin."""
    *names, salt, other = free_names([*rows.columns, out], *MARGINS, "salt", "salt2")
    fitted = fitted.select(*[F.col(m).alias(n) for m, n in zip(MARGINS, names)], F.col("probability").alias(out))
    same = [F.col(at[m]).cast("string").eqNullSafe(F.col(n)) for m, n in zip(MARGINS, names)]
    if fitted.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(fitted), same[0] & same[1] & same[2], "left")
    else:  # a cell that holds many of the rows is met by SALTS tasks
        fitted = fitted.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(*salt_of), F.lit(SALTS)).cast("int"))
        joined = rows.join(fitted, (F.col(salt) == F.col(other)) & same[0] & same[1] & same[2], "left").drop(salt, other)
    return joined.drop(*names).withColumn(out, F.coalesce(out, F.lit(0.0)))


def margins(
    docs: DataFrame, fraction: float = 0.5, power: float = 0.5, text: str = "text", source: str = "source", lang: str = "lang",
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """(margin, value, wanted, target, reached) of mix(), as rake() reports them. An empty table gives no rows."""
    cells = docs.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), topic_of(F.col(text)).alias("topic")).agg(F.sum(token_count(F.col(text))).alias("tokens"))
    return rake(cells, fraction, power, targets)[1]


def mix(
    docs: DataFrame, fraction: float = 0.5, power: float = 0.5, seed: int = 7, key: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang", targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Every document with its cell, calibrated probability and draw: (key, source, lang, topic, n_tokens, probability, draw, kept,
    token_weight), token_weight = 1 / probability for kept rows.

    targets: for each margin a table (value, share); by default tempered shares of what is found. Null sources and languages are values of
    their own. Null and blank texts have no tokens; a cell without tokens has probability 0. Equal rows get equal draws. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(key).alias("k"), F.col(source).alias("source"), F.col(lang).alias("lang"), topic_of(F.col(text)).alias("topic"),
        token_count(F.col(text)).alias("n_tokens"), uniform(F.col(key), F.col(text), seed).alias("draw"),
    )
    rows = materialise(rows, "narrow")  # texts are read once
    fitted, _ = rake(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), fraction, power, targets)
    rows = _with_probability(rows, fitted, {m: m for m in MARGINS}, ["k", "draw"], "probability").withColumn("kept", F.col("draw") < F.col("probability"))
    return rows.select(F.col("k").alias(key), *MARGINS, "n_tokens", "probability", "draw", "kept", F.when(F.col("kept"), 1 / F.col("probability")).alias("token_weight"))


def sample(
    docs: DataFrame, fraction: float = 0.5, power: float = 0.5, seed: int = 7, key: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang", targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The documents that mix() keeps, with the columns of the input, whatever their names. Rows without tokens (null and blank texts) go;
    equal rows stay or go together; an empty table gives no rows."""
    columns = docs.columns
    cells = docs.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), topic_of(F.col(text)).alias("topic")).agg(F.sum(token_count(F.col(text))).alias("tokens"))
    fitted, _ = rake(cells, fraction, power, targets)
    topic, draw, chance = free_names(columns, "topic", "draw", "probability")
    rows = docs.withColumns({topic: topic_of(F.col(text)), draw: uniform(F.col(key), F.col(text), seed)})
    rows = _with_probability(rows, fitted, {"source": source, "lang": lang, "topic": topic}, [draw], chance)
    return rows.where(F.col(draw) < F.col(chance)).select(*[F.col(f"`{c}`") for c in columns])
