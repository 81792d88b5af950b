"""Benchmark decontamination as a prefix-filtered join, with DataFrame functions alone.

Each benchmark item is cut into windows of words. A window that occurs in a document has all its words there, so its
rarest word suffices to find it: frequencies of the benchmark's words are counted over all documents, every window
is posted under its rarest word, and only these words are joined. A candidate must fit into the document by position
and length, and is then compared word by word.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all of ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a benchmark table up to which it is sent to all executors (a few MB); beyond, both sides are shuffled.
SENT_ROWS = 100_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none. Other letters keep their case, so only pure ASCII may take lower()."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(small, _BETWEEN), lambda w: w != "")


def text_mark(text: Column) -> Column:
    """Hash by which rows of one id with different texts are told apart."""
    return F.xxhash64(text.cast("string"))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Columns behind a generator, so that none is computed again wherever it is used."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, key, words) of every window: `window` consecutive words, or all of an item that has fewer."""
    split = _once(items.where(F.col("item_id").isNotNull()), F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = split.select("item_id", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))).alias("at"))
    return starts.select("item_id", F.slice("all", F.col("at"), window).alias("words")).select("item_id", F.array_join("words", " ").alias("key"), "words").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, text_mark, contaminated) of every row of documents.

    A word of a document is hit if it lies in an occurrence of an item's window; n_items counts the items with such a
    window. contaminated: n_hit > 0 and share * n_hit >= n_words. Null or empty texts have no words, and no hit; an empty
    benchmark hits nothing. Items without item_id or without words take no part. Rows that repeat an id and its text have
    the same result each; a null doc_id stays null. Other columns of either table are not looked at.
    """
    windows = stored(item_windows(items, window), "benchmark-windows")
    distinct = windows.select("key", "words").distinct()
    vocabulary = _sized(windows.select(F.explode("words").alias("word")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    every = texts.select(F.explode(words_of(F.col("text"))).alias("word"))
    often = stored(every.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("often")), "benchmark-frequencies")
    # the rarest word of each window; one that no document has needs no search at all
    placed = distinct.select("key", F.size("words").alias("size"), F.posexplode("words").alias("at", "word")).join(often, "word", "left")
    rarest = placed.groupBy("key", "size").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word", "at")).alias("least"))
    anchors = _sized(stored(rarest.where("least.often > 0").select("key", "size", F.col("least.word").alias("word"), F.col("least.at").alias("at")), "benchmark-anchors"))
    split = _once(texts, F.col("doc_id"), F.col("mark"), words_of(F.col("text")).alias("words"))
    spots = split.select("doc_id", "mark", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    found = spots.join(anchors, "word").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    candidates = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(start.alias("start"), "size", "key")).alias("found"))
    # null-safe on the id, equal on the text's mark: both sides are hashed by the mark as well
    joined = texts.alias("t").join(candidates.alias("c"), (F.col("t.mark") == F.col("c.mark")) & F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")), "left")
    whole = _once(joined, F.col("t.doc_id").alias("doc_id"), F.col("t.mark").alias("mark"), words_of(F.col("t.text")).alias("words"), F.col("c.found").alias("found"))
    hits = F.filter("found", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["size"]), " ") == c["key"])
    checked = stored(_once(whole, F.col("doc_id"), F.col("mark"), F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "benchmark-hits")
    ranges = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["size"]).alias("stop"))))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total"))
    covered = F.aggregate(ranges, zero, lambda a, r: F.struct(
        F.greatest(a["upto"], r["stop"]).alias("upto"),
        (a["total"] + F.greatest(F.lit(0), r["stop"] - F.greatest(a["upto"], r["start"]))).alias("total")), lambda a: a["total"])
    named = checked.select("doc_id", "mark", F.explode("hits").alias("h")).select("doc_id", "mark", F.col("h.key").alias("key")).distinct().join(windows.select("item_id", "key"), "key")
    per_doc = named.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    result = checked.alias("t").join(per_doc.alias("i"), (F.col("t.mark") == F.col("i.mark")) & F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), "left").select(
        F.col("t.doc_id").alias("doc_id"), "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("t.mark").alias("text_mark"))
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
