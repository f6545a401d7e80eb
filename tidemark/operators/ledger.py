"""Trial ledger jobs: the last record of a trial wins, by an explicit sequence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def last_wins(ledger: DataFrame) -> DataFrame:
    """(trial_id, status, strategy, seq) of each trial's latest record."""
    last = ledger.groupBy("trial_id").agg(F.max_by(F.struct("status", "strategy", "seq"), "seq").alias("r"))
    return last.select("trial_id", "r.*")


def family(strategy: Column, suffixes: list[str]) -> Column:
    """A strategy's name without any number of trailing variant suffixes."""
    return F.regexp_replace(strategy, "(?:" + "|".join(re.escape(s) for s in suffixes) + ")+$", "")


def distinct_hypotheses(ledger: DataFrame, counted: list[str], suffixes: list[str]) -> DataFrame:
    """(status, trials, hypotheses, counted): of the latest records. A hypothesis is the pre-registration of the record, or else the family
    of its strategy."""
    own = [c for c in ("pre_reg_path",) if c in ledger.columns]
    last = ledger.groupBy("trial_id").agg(F.max_by(F.struct("status", "strategy", *own), "seq").alias("r")).select("r.*")
    path = F.nullif("pre_reg_path", F.lit("")) if own else F.lit(None).cast("string")
    rows = last.withColumn("key", F.coalesce(path, family(F.col("strategy"), suffixes), F.lit("")))
    return rows.groupBy("status").agg(F.count("*").alias("trials"), F.countDistinct("key").alias("hypotheses")).withColumn("counted", F.col("status").isin(*counted))


def orphans(ledger: DataFrame, terminal: list[str], before: Column) -> DataFrame:
    """(trial_id, spawned): trials without a terminal record whose first record is older than `before`."""
    t = ledger.groupBy("trial_id").agg(F.min("ts").alias("spawned"), F.count_if(F.col("status").isin(*terminal)).alias("done"))
    return t.where((F.col("done") == 0) & (F.col("spawned") < before)).select("trial_id", "spawned")


def exposure(positions: DataFrame, group: str) -> DataFrame:
    """(group, positions, strategies, notional, share) and the total row (null group): rollup in one pass."""
    sums = positions.rollup(group).agg(F.count("*").alias("positions"), F.countDistinct("strategy_id").alias("strategies"), F.sum("notional").alias("notional"), F.grouping(group).alias("total"))
    whole = sums.where("total = 1").select(F.col("notional").alias("all"))
    return sums.crossJoin(F.broadcast(whole)).select(group, "positions", "strategies", "notional", (F.col("notional") / F.col("all")).alias("share"))


def deflation_denominator(ledger: DataFrame, classified: DataFrame, withdrawn: str = "withdrawn-pre-freeze", spawned: str = "spawned") -> DataFrame:
    """(trial_id, how) of the trials that count: `legacy` ones of the classification (trial_id, counted), and `new` ones of the ledger
    (trial_id, seq, status, config_hash, sharpe, counts) that are not in it.

    A new trial drops if any of its records was withdrawn or flagged not to count; if its last record is spawned without a Sharpe; or if it
    re-runs, with equal config hash and Sharpe, a legacy trial that counts or an earlier new one. What is unclear counts.
    """
    from pyspark.sql import Window as W

    record = F.struct("status", "config_hash", "sharpe", "seq")
    gone = F.bool_or(F.coalesce(F.col("status") == withdrawn, F.lit(False)) | F.coalesce(~F.col("counts"), F.lit(False)))
    last = ledger.where("trial_id is not null").groupBy("trial_id").agg(F.max_by(record, "seq").alias("r"), F.min("seq").alias("first"), gone.alias("gone")).select("trial_id", "first", "gone", "r.*")
    marked = last.join(classified.select("trial_id", F.col("counted").alias("legacy")), "trial_id", "full")
    new = marked.where("legacy is null and not gone").where(~(F.col("sharpe").isNull() & F.coalesce(F.col("status") == spawned, F.lit(False))))
    # one row of each draw counts: legacy draws come first, then the ledger's order of first appearance
    draws = new.select("trial_id", "config_hash", "sharpe", F.lit(1).alias("late"), "first")
    draws = draws.unionByName(marked.where("legacy and sharpe is not null and config_hash is not null").select("trial_id", "config_hash", "sharpe", F.lit(0).alias("late"), F.coalesce("first", F.lit(0)).alias("first")))
    same = W.partitionBy("config_hash", "sharpe").orderBy("late", "first", "trial_id")
    known = F.col("config_hash").isNotNull() & F.col("sharpe").isNotNull()
    kept = draws.where(known).withColumn("n", F.row_number().over(same)).where("n = 1 and late = 1").select("trial_id").union(draws.where(~known & (F.col("late") == 1)).select("trial_id"))
    return classified.where("counted").select("trial_id", F.lit("legacy").alias("how")).union(kept.select("trial_id", F.lit("new")))


def check_classification(records: DataFrame) -> int:
    """The ratified number of a ledger's classification records (ratified_n, counted); none, several, or a number that is not that of the
    counted trials is an error."""
    found = records.select("ratified_n", F.size("counted").alias("n")).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} classification records; exactly one is needed")
    if found[0]["ratified_n"] is None or found[0]["ratified_n"] != found[0]["n"]:
        raise ValueError(f"ratified number {found[0]['ratified_n']} is not the number of counted trials {found[0]['n']}")
    return found[0]["n"]


def params_hash(params: dict[str, Column]) -> Column:
    """First 12 hex digits of the sha256 of the parameters as JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*(params[k].alias(k) for k in sorted(params)))), 256), 1, 12)


def longest_level_run(rows: DataFrame, x: str, level: float) -> DataFrame:
    """(pair, run): most consecutive rows at or above the level."""
    from tidemark.operators.quality import longest_run

    return longest_run(rows, F.col(x) >= level, "run")


def limit_check(positions: DataFrame, own: float, total: float) -> DataFrame:
    """(ts, strategy_id, notional, all_notional, breach): the strategy's own cap comes first, then the cap on the sum."""
    by = positions.groupBy("ts", "strategy_id").agg(F.sum("notional").alias("notional"))
    whole = by.groupBy("ts").agg(F.sum("notional").alias("all_notional"))
    rows = by.join(whole, "ts")
    return rows.withColumn("breach", F.when(F.col("notional") > own, "strategy").when(F.col("all_notional") > total, "aggregate").otherwise("none"))
