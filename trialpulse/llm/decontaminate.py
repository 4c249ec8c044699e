"""Benchmark decontamination by a prefix-filtered set join (operator 5), in DataFrame functions only.

An item's windows are ``size`` consecutive words (a shorter item is one window).
Words are ordered by rarity, counted over all documents; a document can hold a
window only if it holds the window's rarest word, so that word alone is joined
on (the necessary prefix of an exact containment). A meeting fixes where the
window would begin in the document: length and position bounds drop what would
stick out, and the rest is verified word by word over the item-sized window.

The item side is broadcast only where its bytes are counted first and are within
BROADCAST_BYTES; otherwise words are shuffled, and the documents that have a
candidate join again for the verification.

Defined results: null text and null items have no words; a null doc_id or
item_id is an id like any other (a null item_id reads as the empty string);
repeated rows stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Words of a text column: A-Z folded, runs of digits, letters and non-ASCII."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(folded, SEPARATORS), "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(win, items): distinct windows and the ids of the items that have them."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    each = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, size).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item_id").alias("items"))


def find(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted), hits (array of start, length in words), key (hash of the text)."""
    wins = windows(items.select("item_id", "text"), size)
    weight = wins.agg(F.sum(F.length(F.array_join("win", " ")) + F.size("items") * 12 + 64)).first()[0] or 0
    small = weight <= broadcast_bytes

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    listed = rows.select("doc_id", "key", words(F.col("text")).alias("words"))

    # rarity of the items' words, over all documents
    vocabulary = wins.select(F.explode("win").alias("token")).distinct()
    seen = rows.select(F.explode(words(F.col("text"))).alias("token")).join(side(vocabulary), "token", "left_semi" if not small else "inner").groupBy("token").count()
    spots = wins.select("win", "items", F.posexplode("win").alias("at", "token")).join(side(seen), "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token"), F.col("at"))).alias("r")
    prefix = spots.groupBy("win").agg(rarest, F.first("items").alias("items")).select(F.col("r.token").alias("token"), F.col("r.at").alias("at"), "win", "items", F.size("win").alias("len"))
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    if small:
        # every document meets this entry once, at the end mark behind its last word
        mark = docs.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("len"))
        marked = listed.select("doc_id", "key", "words", F.size("words").alias("n_words"), F.concat("words", F.array(F.lit(""))).alias("ended"))
        met = marked.select("doc_id", "key", "words", "n_words", F.posexplode("ended").alias("pos", "token")).join(F.broadcast(prefix.unionByName(mark)), "token").where(fits)
        real = met.where((F.col("len") == 0) | (F.slice("words", start + 1, F.greatest("len", F.lit(1))) == F.col("win")))
    else:
        counted = listed.select("doc_id", "key", "words", F.size("words").alias("n_words"))
        met = counted.select("doc_id", "key", "n_words", F.posexplode("words").alias("pos", "token")).join(prefix, "token").where(fits)
        # a document that repeats (an id and its text) is verified once; every row is counted below
        texts = met.select("doc_id", "key").distinct().alias("m").join(listed.alias("d"), F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.key") == F.col("d.key"))).select("d.*").dropDuplicates(["doc_id", "key"])
        checked = met.alias("m").join(texts.alias("d"), F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.key") == F.col("d.key"))).where(F.slice("d.words", start + 1, F.col("len")) == F.col("win")).select("m.*")
        rows_ = counted.select("doc_id", "key", "n_words", F.size("words").alias("pos"), F.lit("").alias("token"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("len"))
        real = checked.unionByName(rows_)
    hit = F.when(F.col("len") > 0, F.struct(start.alias("start"), F.col("len").alias("length")))
    found = real.groupBy("doc_id", "key", "n_words").agg(F.count_if(F.col("len") == 0).alias("copies"), F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    total = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda acc, h: F.struct(F.greatest(acc["end"], h["start"] + h["length"]).alias("end"), (acc["sum"] + F.greatest(h["start"] + h["length"] - F.greatest(acc["end"], h["start"]), F.lit(0))).alias("sum")))["sum"]
    spread = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return found.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), total.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "hits", spread.alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, items, size, **options)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
