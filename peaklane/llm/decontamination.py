"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``size`` words. A window can stand in a document only if all its words do, so one
necessary word is enough to find it: the rarest by its count over all documents (the prefix of the window in order
of rarity, at containment 1). Documents' words join these prefix words; a length bound and a positional bound drop
places where the window can't fit, and the words around the rest are compared one by one.

The prefix table is written first and measured: up to ``BROADCAST`` bytes it is broadcast and the words of the documents
are probed inside the scan; beyond that narrow rows of one word each are shuffled to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklane.llm.scratch import written

#: Bytes up to which a measured table of the benchmark's side is broadcast.
BROADCAST = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the documents and items, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def item_windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, words, size, s): every window start; an item of fewer words, but not none, is one window."""
    cut = items.select(F.col(item).alias("item"), plain_words(text).alias("item_words")).filter("size(item_words) > 0")
    cut = cut.withColumn("size", F.least(F.lit(size), F.size("item_words")))
    return cut.withColumn("s", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("size"))))


def measured(df: DataFrame, words: Column, limit: int) -> tuple[DataFrame, bool]:
    """A written table and whether its words and 100 bytes a row stay within the limit; if so with a broadcast hint."""
    small = df.agg(F.coalesce(F.sum(F.octet_length(words) + 100), F.lit(0)).alias("n")).first()["n"] <= limit
    return (F.broadcast(df), True) if small else (df, False)


def prefixes(docs: DataFrame, windows: DataFrame, text: str, limit: int) -> DataFrame:
    """For each window its rarest word; windows of an item that share that place become one row with the room they need."""
    vocabulary, small = measured(written(windows.select(F.explode("item_words").alias("word")).distinct(), "vocabulary"), F.col("word"), limit)
    seen = docs.select(F.explode(plain_words(text)).alias("word")).join(vocabulary, "word").groupBy("word").count()
    seen = F.broadcast(seen) if small else seen  # no more rows than the vocabulary
    places = windows.select("item", "item_words", "size", "s", F.posexplode(F.slice("item_words", F.col("s") + 1, F.col("size"))).alias("i", "word"))
    counted = places.join(seen, "word", "left").withColumn("order", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "i"))
    best = counted.groupBy("item", "item_words", "size", "s").agg(F.min("order").alias("o")).select("item", "item_words", "size", "s", F.col("o.word").alias("word"), (F.col("s") + F.col("o.i")).alias("q"))
    room = best.groupBy("item", "item_words", "size", "word", "q").agg(F.min(F.col("q") - F.col("s")).alias("before"), F.min(F.col("s") + F.col("size") - F.col("q")).alias("from"))
    return written(room, "prefixes")


def _run(sign: int) -> Column:
    """How many words next to the place agree with the item's, at most a window's less one."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), lambda t: F.coalesce(F.get("words", F.col("p") + sign * t) == F.get("item_words", F.col("q") + sign * t), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(F.col("size") == 1, 0).when(first == 0, F.col("size").cast("long") - 1).otherwise(first - 1)


def decontaminate(docs: DataFrame, items: DataFrame, *, ids: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """(ids, n_words, n_hit, spans, items, contaminated) for every row of ``docs``.

    ``spans``: merged-able word ranges (end excluded) inside which windows of items occur; ``n_hit``: words in any of
    them; ``items``: sorted distinct item ids as strings.

    Null text: no words. Null or empty items: no window. Items with the same id are one. A null item id counts its
    words but is not listed. Repeated rows of ``docs``, and rows with repeated or null ids, give a row each. Other columns
    are left out, whatever their names; ``ids`` may be named like a word column. Empty tables: no hits, or no rows.
    """
    need = prefixes(docs, item_windows(items, item, item_text, size), text, broadcast_bytes)
    need, small = measured(need, F.array_join("item_words", " "), broadcast_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_id"), plain_words(text).alias("words"))
    end = F.col("p") == F.col("n")
    fits = (F.col("p") >= F.col("before")) & (F.col("n") - F.col("p") >= F.col("from"))
    # the null word after the last stands for the document itself
    placed = F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("p", "word")
    if small:
        # this filter is plain enough to run inside the scan's generated code, before a row of its own is made for a word
        found = rows.select("_row", "_id", "words", F.size("words").alias("n"), placed).join(need, "word", "left").filter(end | (F.col("q").isNotNull() & fits))
    else:
        rows = written(rows, "rows")  # their numbers must be the same on both sides of the join
        narrow = rows.select("_row", F.size("words").alias("n"), F.posexplode("words").alias("p", "word")).join(need, "word").filter(fits)
        whole_rows = rows.select("_row", "_id", "words", F.size("words").alias("n"))
        ends = whole_rows.select("*", F.col("n").alias("p"))
        found = narrow.drop("n", "word").join(whole_rows, "_row").unionByName(ends, allowMissingColumns=True)
    left, right = _run(-1), _run(1)
    whole = ~end & ((left + right + 1) >= F.col("size"))
    span = F.when(whole, F.struct((F.col("p") - left).alias("start"), (F.col("p") + right + 1).alias("end")))
    told = found.select("_row", "_id", F.when(end, F.col("p")).alias("n"), span.alias("span"), F.when(whole, F.col("item").cast("string")).alias("item"))
    by_row = told.groupBy("_row", "_id").agg(F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    union = F.aggregate("spans", start, lambda a, x: F.struct((a.n + F.greatest(F.lit(0).cast("long"), x.end - F.greatest(x.start, a.to))).alias("n"), F.greatest(a.to, x.end).alias("to")), lambda a: a.n)
    return by_row.withColumn("n_hit", union).select(F.col("_id").alias(ids), "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, items: DataFrame, *, ids: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with the same columns and values. A row goes by its id and
    text, so of rows that share an id, or have none, only those that hold a window go."""
    key = F.struct(F.col(ids).alias("id"), F.xxhash64(text).alias("told")).alias("_key")
    rows = docs.select(key, F.col(text).alias("text"))
    bad = written(decontaminate(rows, items, ids="_key", **how).filter("contaminated").select("_key.*").distinct(), "contaminated")
    return docs.join(bad, docs[ids].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text]) == bad["told"]), "left_anti")
