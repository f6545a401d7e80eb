"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard scores a key by -weight / ln(u) with u uniform in (0, 1) from a hash of (key, shard); the best score takes the record.
A shard that joins takes records only into itself, and takes a share equal to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """Shard (0-based int) of a key over weighted shards. A null key counts as one key of its own. Weights of 0 take nothing."""
    scores = []
    for shard, weight in enumerate(weights):
        # 53 bits of the hash, moved off 0 so that the logarithm is finite and below 0
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return -F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def shard_records(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", buckets: int = 64, seed: int = 0) -> DataFrame:
    """Places every record: (key, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text (null: 0) plus 16. text_crc32: unsigned, null as ''. slot: 0, 1, .. in each shard without gaps.
    grown_shard: the shard if one more of mean weight joined. Equal keys (null keys too) share a shard. Slots are dealt in two
    levels, (shard, bucket) and then an offset for each bucket, so no task holds a whole shard. Other columns are ignored, whatever
    their names; an empty table gives no rows; repeated rows get slots of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    grown = [*weights, sum(weights) / len(weights)]
    rows = rows.withColumns({
        "shard": rendezvous(F.col("__key"), weights, seed).cast("int"),
        "grown_shard": rendezvous(F.col("__key"), grown, seed).cast("int"),
        "__bucket": F.pmod(F.xxhash64("__key", "text_crc32", "size", F.lit(seed + 1)), F.lit(buckets)).cast("int"),
    })
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    # at most len(weights) * buckets rows
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = W.partitionBy("shard", "__bucket").orderBy("__key", "text_crc32", "size")
    placed = rows.withColumn("__rank", F.row_number().over(order) - 1).join(F.broadcast(offsets), ["shard", "__bucket"])
    return placed.select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__before") + F.col("__rank")).cast("long").alias("slot"), "grown_shard",
    )
