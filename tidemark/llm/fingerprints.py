"""Document fingerprints: canonical exact digests, grouped by a wide xxhash with byte comparison inside equal buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.llm.shared import materialise


#: About so many bytes of text are sorted by one task.
RANGE_BYTES = 16 << 20
#: Quantiles of the key that are asked for at most; each range between two is cut further by the key's value, and a key that fills more
#: than one range by the hash of the text.
QUANTILES = 500
#: Ranges whose first rows (key, hash and digest) are broadcast; above it Spark joins them by a shuffle.
BROADCAST_RANGES = 100_000


def canonical(text: Column) -> Column:
    """Closed under compatibility composition (NFKC) and full case folding: composed, then twice folded and composed again, as folding can
    undo a composition and composing can bring back what folds. Every run of white space becomes one space, none at the ends. Null
    as ''."""
    def composed(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    def folded(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))

    out = composed(F.coalesce(text, F.lit("")))
    for _ in range(2):
        out = composed(folded(out))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash64 under two salts, as 32 lower-case hex digits."""
    one, two = F.xxhash64(canon), F.xxhash64(F.lit(0x5EED), canon)
    return F.lower(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))


def collisions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Byte comparison inside equal buckets: (digest, check, ordinal) of every canonical text that shares its digest with another
    text; ordinal numbers the different texts of one digest. Normally empty. Copies of a text meet in the map-side grouping."""
    canon = docs.select(canonical(F.col(text)).alias("canon")).select(digest(F.col("canon")).alias("digest"), "canon")
    distinct = canon.groupBy("digest", "canon").agg(F.lit(1).alias("one")).select("digest", F.sha2("canon", 256).alias("check"))
    shared = distinct.groupBy("digest").agg(F.sort_array(F.collect_set("check")).alias("checks")).where(F.size("checks") > 1)
    return shared.select("digest", F.posexplode("checks").alias("ordinal", "check"))


def named(rows: DataFrame, canon: str, out: str, found: DataFrame | None) -> DataFrame:
    """Adds the fingerprint of a canonical text: its digest; where different texts share it, '-' and the text's ordinal follow."""
    if found is None:
        return rows.withColumn(out, digest(F.col(canon)))
    marks = found.select(F.col("digest").alias("__digest"), F.col("check").alias("__check"), F.col("ordinal").alias("__ordinal"))
    rows = rows.withColumns({"__digest": digest(F.col(canon)), "__check": F.sha2(canon, 256)}).join(marks, ["__digest", "__check"], "left")
    name = F.concat_ws("-", F.col("__digest"), F.col("__ordinal").cast("string"))
    return rows.withColumn(out, name).drop("__digest", "__check", "__ordinal")


def fingerprints(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(docs with canon and fingerprint columns, table of collided digests or None). Equal canonical texts have equal fingerprints
    and no others; null texts count as ''. An empty table gives no rows; input columns with these two names are replaced."""
    found = materialise(collisions(docs, text), "collisions")
    found = None if found.isEmpty() else found
    return named(docs.withColumn("canon", canonical(F.col(text))), "canon", "fingerprint", found), found


def dealt(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """rows with `at`, the number of a range in descending order of (key, hash h of the text): ranges of about `size` bytes of text.

    The cuts are quantiles of the key, QUANTILES at most, and each range between two is cut evenly by the key's value; keys that are
    quantiles more than once, and null keys, which come last, are cut by h.
    """
    ranges = F.least(F.lit(QUANTILES), F.ceil(F.sum(F.octet_length(text)) / size)).cast("int")
    shape = rows.agg(ranges.alias("n"), F.sum(F.octet_length(text)).alias("bytes"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    wanted = shape["n"] or 1
    cuts = rows.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10_000).alias("c")).first()["c"] if wanted > 1 else None
    cuts = sorted(cuts or [], reverse=True)
    parts = -(-(shape["bytes"] or 0) // (size * wanted)) or 1
    hot = sorted({x for x, y in zip(cuts, cuts[1:]) if x == y})
    many = max(1, -(-(shape["bytes"] or 0) // size))  # ranges of one hot key: as many as there can be
    cuts = sorted(set(cuts), reverse=True)
    coarse = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(key))) if cuts else F.lit(0)
    edges = [F.array(*[F.lit(x).cast("double") for x in e]) for e in ([shape["hi"], *cuts], [*cuts, shape["lo"]])]
    top, low = (F.get(e, coarse) for e in edges)
    inner = F.floor((top - F.col(key).cast("double")) / F.greatest(top - low, F.lit(1e-9)) * parts)
    inner = F.greatest(F.lit(0), F.least(F.lit(parts - 1), inner))
    by_hash = parts + F.floor((F.lit(2.0**63) - F.col("h").cast("double")) / F.lit(2.0**64) * F.lit(many) * F.lit(1 - 1e-12))
    place = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1) * (parts + many) + by_hash)
    if hot:  # a hot key is the least of its range
        place = place.when(F.col(key).isin(hot), coarse * (parts + many) + by_hash)
    return rows.withColumn("at", place.otherwise(coarse * (parts + many) + inner).cast("long"))


def with_next(docs: DataFrame, key: str, text: str, payload: dict[str, Column], size: int = RANGE_BYTES) -> DataFrame:
    """(k, t, payload.., next): each row with the struct of t and payload of the row that follows in descending order of the key, after
    the last row the first. Ties of the key: the greater xxhash64 of the text first, then the greater text; null keys last.

    Ranges of rows are sorted one by one. Each also gets a copy of the first row of the range that follows, which is found by key and
    hash alone; only those rows are fetched with their texts.
    """
    base = dealt(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")), "k", "t", size)
    place = F.struct(F.col("k").isNotNull().alias("some"), "k", "h", F.md5("t").alias("m"))
    heads = materialise(base.groupBy("at").agg(F.max(place).alias("top")).withColumn("group", F.floor(F.col("at") / 4096)), "heads")
    # one narrow row for each range; the ranges are chained in groups, and the groups by their first ranges
    inside = W.partitionBy("group").orderBy("at")
    firsts = heads.groupBy("group").agg(F.min("at").alias("first"))
    follow = firsts.withColumn("after", F.lead("first").over(W.orderBy("group")))
    chained = heads.withColumn("next_at", F.lead("at").over(inside)).join(follow, "group")
    least = firsts.agg(F.min("first").alias("opening"))
    chained = chained.join(F.broadcast(least)).select("at", F.coalesce("next_at", "after", "opening").alias("next_at"))
    asked = heads.join(chained.select(F.col("at").alias("into"), "next_at"), F.col("at") == F.col("next_at")).select("into", "at", "top")
    # equal rows (key, text) are one row here
    wanted = asked.select("at", "into", F.col("top.k").alias("wk"), F.col("top.h").alias("wh"), F.col("top.m").alias("wm"))
    # one narrow row for each range: broadcast up to a number of them
    found = base.join(F.broadcast(wanted) if heads.count() <= BROADCAST_RANGES else wanted, ["at"]).where(F.col("k").eqNullSafe(F.col("wk")) & (F.col("h") == F.col("wh")))
    found = found.where(F.md5("t") == F.col("wm")).groupBy("into", "k", "h").agg(F.first("t").alias("t"))
    copies = found.select(F.col("into").alias("at"), "k", "t", "h", F.lit(True).alias("copy"))
    rows = base.select("at", "k", "t", "h", F.lit(False).alias("copy")).unionByName(copies)
    rows = rows.withColumns(payload)
    order = [F.col("copy"), F.col("k").desc_nulls_last(), F.col("h").desc(), F.col("t").desc()]
    led = rows.withColumn("next", F.lead(F.struct("t", *payload)).over(W.partitionBy("at").orderBy(*order)))
    return led.where("not copy").drop("at", "h", "copy")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), following.substr(F.lit(1), half))


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint of every text and of its edited text: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). The next document is the one with the next smaller key (ties: the greater xxhash64 of the text first, null
    keys last), after the last the first. Likeness of exact digests is 1.0 (equal, bytes compared) or 0.0. Null texts are ''. Keys are
    numbers. Repeated rows are answered one by one; an empty table gives no rows; other columns are ignored, whatever their names."""
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = materialise(collisions(base, "t"), "collisions")
    found = None if found.isEmpty() else found
    if found is None:
        follow = with_next(base, "k", "t", {"fingerprint": digest(canonical(F.col("t")))}, size)
    else:  # different texts that share a digest are told apart once the next text is there
        follow = with_next(base, "k", "t", {}, size).withColumns({"c0": canonical(F.col("t")), "c1": canonical(F.col("next.t"))})
        follow = named(named(follow, "c0", "fingerprint", found), "c1", "next_fingerprint", found)
        follow = follow.withColumn("next", F.struct(F.col("next.t").alias("t"), F.col("next_fingerprint").alias("fingerprint")))
    follow = follow.withColumn("edited", edited(F.col("t"), F.col("next.t")))
    follow = named(follow.withColumn("canon", canonical(F.col("edited"))), "canon", "edited_fingerprint", found)
    # fingerprints of the table's own texts are equal for equal canonical texts alone; the edited text is compared with its bytes
    same = (F.col("fingerprint") == F.col("edited_fingerprint")) & (canonical(F.col("t")) == F.col("canon"))
    return follow.select(
        F.col("k").alias(key),
        F.length("t").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.when(same, 1.0).otherwise(0.0).alias("near_edited"),
        F.when(F.col("fingerprint") == F.col("next.fingerprint"), 1.0).otherwise(0.0).alias("near_next"),
    )
