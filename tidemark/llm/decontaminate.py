"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of an item (all of them if it has fewer). From every run of L words the least hash among its k-grams
is kept, on both sides; a run that document and item share has the same k-grams and so the same least one: no shared window is
missed. Documents are joined with the benchmark on kept hashes alone; in the texts that hit, each hit is extended to the windows around
it, and these are joined with the items' windows word for word.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import free_names, materialise, text_key, words

WINDOW, GRAM = 13, 7
#: Up to so many kept hashes (8 bytes each), texts with hits (16 bytes each) and bytes of benchmark windows are broadcast; above that a
#: join shuffles, and where one key can hold many rows its other side is copied SALTS times.
BROADCAST_HASHES, BROADCAST_TEXTS, BROADCAST_BYTES, SALTS = 500_000, 200_000, 16 << 20, 16


def _runs(values: Column, size: int, join) -> Column:
    """join(*values) of every `size` consecutive values; shorter arrays give none."""
    each = F.transform(F.sequence(F.lit(0), F.size(values) - size), lambda i: join(*[F.get(values, i + j) for j in range(size)]))
    return F.when(F.size(values) < size, F.array().cast("array<bigint>")).otherwise(each)


def least_of_runs(grams: Column, run: int) -> Column:
    """Least of every `run` consecutive hashes, each value once."""
    return F.array_distinct(grams if run == 1 else _runs(grams, run, F.least))


def _grams(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds g<k>, the hashes of all k consecutive words, to a table with words. What follows explodes these with explode_outer: a plain
    explode has Catalyst filter on the array's size first, which would compute it anew inside every lambda."""
    hashed = df.withColumn("hashed", F.transform("words", lambda x: F.xxhash64(x)))
    return hashed.withColumns({f"g{k}": _runs(F.col("hashed"), k, F.xxhash64) for k in sizes})


def _with(length: int):
    return lambda h: F.struct(F.lit(length).alias("length"), h.alias("hash"))


def _kept(df: DataFrame, lengths: list[int]) -> Column:
    """Array of (length, hash) that a text keeps, from its g<k>."""
    each = [F.transform(least_of_runs(F.col(f"g{min(GRAM, n)}"), n - min(GRAM, n) + 1), _with(n)) for n in lengths]
    return F.concat(*each) if len(each) > 1 else each[0]


def _window(words_: Column, start: Column, length: Column) -> Column:
    """`length` words from `start` (from 0), joined by spaces, which no word holds."""
    return F.array_join(F.slice(words_, start + 1, length), " ")


def _hits(texts: DataFrame, items: DataFrame, lengths: list[int], limits: dict[str, int]) -> DataFrame:
    """(tid, item, start, length): windows of documents that are windows of the items. texts: tid, words. items: item, words, n (the length
    of their windows, one of `lengths`). One pass over the texts hashes them for all lengths."""
    sizes = sorted({min(GRAM, n) for n in lengths})
    own = _grams(items, sizes).select("n", F.explode_outer(_kept(items, lengths)).alias("k"))
    hashes = materialise(own.where("k.length = n").select("k.length", "k.hash").distinct(), "hashes")
    windows = items.select("item", "words", "n", F.explode_outer(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("s"))
    windows = materialise(windows.select("item", F.col("n").alias("length"), _window(F.col("words"), F.col("s"), F.col("n")).alias("window")).distinct(), "windows")
    # narrow rows only: copies of a text meet in the map-side grouping
    kept = _grams(texts, sizes).select("tid", F.explode_outer(_kept(texts, lengths)).alias("k")).select("tid", "k.length", "k.hash")
    met = kept.join(F.broadcast(hashes) if hashes.count() <= limits["hashes"] else hashes, ["length", "hash"], "left_semi").distinct()
    met = materialise(met, "met")
    tids = met.select("tid").distinct()
    few = tids.count() <= limits["texts"]
    # the texts that hit, each once
    candidates = texts.join(F.broadcast(tids) if few else tids, "tid", "left_semi").groupBy("tid").agg(F.first("words").alias("words"))
    candidates = materialise(candidates, "candidates")
    # where a kept hash stands, and the windows around it
    wide = _grams(candidates, sizes)
    places = None
    for k in sizes:
        part = wide.select("tid", F.size("words").alias("n"), F.lit(k).alias("k"), F.posexplode_outer(f"g{k}").alias("p", "hash"))
        places = part if places is None else places.unionByName(part)
    places = places.join(met.withColumn("k", F.least("length", F.lit(GRAM))), ["tid", "k", "hash"]).where("n >= length")
    around = F.sequence(F.greatest(F.col("p") - (F.col("length") - F.col("k")), F.lit(0)), F.least(F.col("p"), F.col("n") - F.col("length")))
    starts = places.select("tid", "length", F.explode_outer(around).alias("start")).groupBy("tid", "length").agg(F.collect_set("start").alias("starts"))
    cut = F.transform("starts", lambda s: F.struct(s.alias("start"), _window(F.col("words"), s, F.col("length")).alias("window")))
    around = candidates.join(starts, "tid").select("tid", "length", F.explode_outer(cut).alias("w")).select("tid", "length", "w.start", "w.window")
    if (windows.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0) <= limits["bytes"]:
        found = around.join(F.broadcast(windows), ["length", "window"])
    else:  # a window that very many texts hold is met by SALTS tasks
        salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = around.withColumn("salt", F.pmod(F.xxhash64("tid", "start"), F.lit(SALTS)).cast("int")).join(salted, ["length", "window", "salt"])
    return found.select("tid", "item", "start", "length")


def judged_texts(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.05,
    hashes: int = BROADCAST_HASHES, texts: int = BROADCAST_TEXTS, window_bytes: int = BROADCAST_BYTES,
) -> DataFrame | None:
    """(tid, n_hit, items, contaminated) of the different texts that hit; None without items that have words. tid is text_key().

    A word inside any occurrence of an item's window is hit; items: the sorted ids with occurring windows. contaminated: n_hit >= share *
    words, share taken as the decimal number it is written as.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct()
    items = materialise(items.withColumn("n", F.least(F.size("words"), F.lit(WINDOW))), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # 13 at most
    if not lengths:
        return None
    base = docs.select(text_key(F.col(text)).alias("tid"), words(F.col(text)).alias("words"))
    hits = _hits(base, items, lengths, {"hashes": hashes, "texts": texts, "bytes": window_bytes})
    # spans and items of one text: bounded by its length
    of_text = hits.groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans", zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
        ),
    )
    of_text = materialise(of_text.select("tid", covered["n"].alias("n_hit"), "items"), "hits")
    few = of_text.count() <= texts
    sizes = base.join(F.broadcast(of_text.select("tid")) if few else of_text.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.first(F.size("words")).alias("n"))
    # share * n, exactly
    enough = F.col("n_hit").cast("decimal(20,0)") >= F.lit(Decimal(str(share))) * F.col("n").cast("decimal(12,0)")
    return materialise(of_text.join(sizes, "tid").select("tid", "n_hit", "items", ((F.col("n_hit") > 0) & enough).alias("contaminated")), "judged")


def _salted(docs: DataFrame, judged: DataFrame, tid: str, salt: str, few: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs with their text's key, and the judged texts, ready to be joined; copies of one text are dealt over SALTS tasks."""
    if few:
        return docs, F.broadcast(judged.withColumnRenamed("tid", tid)), [tid]
    apart = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # what xxhash64 takes
    salted = docs.withColumn(salt, F.pmod(F.xxhash64(*apart), F.lit(SALTS)).cast("int"))
    return salted, judged.withColumnRenamed("tid", tid).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [tid, salt]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.05, **limits) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated added (input columns with these names are replaced).

    A document word inside any occurrence of an item's window is hit. contaminated: n_hit > 0 and n_hit >= share * n_words. Null and
    blank texts have no words and are not contaminated. Each row is answered, repeated rows too; different texts are judged once. Items
    without words and an empty benchmark hit nothing; an empty table gives no rows. Other columns stay as they are, whatever their
    names.
    """
    out = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    judged = judged_texts(docs, benchmark, text, item, item_text, share, **limits)
    tid, salt, count = free_names(docs.columns + out, "tid", "salt", "count")
    kept = [c for c in docs.columns if c.lower() not in out]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], text_key(F.col(text)).alias(tid), F.size(words(F.col(text))).cast("long").alias(count))
    none = F.array().cast("array<string>")
    if judged is None:
        hit, items, bad = F.lit(0), none, F.lit(False)
    else:
        names = free_names([*rows.columns, salt], "hit", "items", "bad")
        few = judged.count() <= limits.get("texts", BROADCAST_TEXTS) and (judged.agg(F.sum(F.octet_length(F.array_join("items", ",")))).first()[0] or 0) <= BROADCAST_BYTES
        rows, found, on = _salted(rows, judged.toDF("tid", *names), tid, salt, few)
        rows = rows.join(found, on, "left")
        hit, items, bad = (F.coalesce(names[0], F.lit(0)), F.coalesce(names[1], none), F.coalesce(names[2], F.lit(False)))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], F.col(count).alias("n_words"), hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), bad.alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.05, **limits) -> DataFrame:
    """The documents that decontaminate() does not call contaminated, with the columns of the input, whatever their names. Null texts
    and repeated rows stay; an empty table gives no rows."""
    judged = judged_texts(docs, benchmark, text, item, item_text, share, **limits)
    if judged is None:
        return docs
    tid, salt = free_names(docs.columns, "tid", "salt")
    bad = judged.where("contaminated").select("tid")
    rows, found, on = _salted(docs.withColumn(tid, text_key(F.col(text))), bad, tid, salt, bad.count() <= limits.get("texts", BROADCAST_TEXTS))
    return rows.join(found, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
