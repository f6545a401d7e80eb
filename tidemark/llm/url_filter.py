"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.shared import LOWER, UPPER

#: (host, path, verdict) of the standing rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rule tables up to this many rows are broadcast; beyond it the join shuffles, with the rules dealt over SALTS copies.
BROADCAST_RULES, SALTS = 100_000, 16


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (host, path, verdict) as a table."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' if null or without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def url_filter(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for every row: (key, host, path, rule, verdict).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule string wins, on a tie the longer
    host, then the rule first in string order, then 'allow' before 'block'. No rule: null and the default verdict. Null urls and
    urls without '://' have an empty host and path, which no rule fits unless it is empty itself. Repeated rows are each judged;
    other columns are ignored.

    The urls are first reduced to distinct (host, path), so a host that holds a third of all rows weighs what its distinct paths
    weigh; only the label counts and path lengths that occur among the rules are expanded.
    """
    judged = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = rules.select("host", "path", "verdict").distinct().withColumn("rule", F.concat("host", "path"))
    # both sets are bounded: by 127 labels of a host name and by the longest rule path
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    if not shape["n"]:
        return judged.select(F.col("__key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    distinct = judged.select("host", "path").distinct()
    n = F.size(F.split("host", r"\."))
    hosts = F.array_compact(F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in sorted(shape["labels"])]))
    paths = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape["lengths"])]))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    terms = distinct.select("host", "path", F.explode_outer(pairs).alias("t")).select(
        "host", "path", F.sha2(F.concat("t.h", F.lit("\0"), "t.p"), 256).alias("digest")
    ).withColumn("short", _prefix(F.col("digest")))
    listed = rules.withColumn("digest", F.sha2(F.concat("host", F.lit("\0"), "path"), 256)).select(
        "rule", "verdict", F.length("host").alias("host_length"), F.col("digest").alias("rule_digest"), _prefix(F.col("digest")).alias("short")
    )
    if shape["n"] <= BROADCAST_RULES:
        hits = terms.join(F.broadcast(listed), "short")
    else:  # a rule that fits most urls is met by SALTS tasks
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = terms.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    hits = hits.where(F.col("digest") == F.col("rule_digest"))
    # greatest length, longest host, then the least rule and verdict
    ranked = hits.groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), -F.col("host_length"), F.col("rule"), F.col("verdict"))).alias("best")
    )
    return judged.join(ranked, ["host", "path"], "left").select(
        F.col("__key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
