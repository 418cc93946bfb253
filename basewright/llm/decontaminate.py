"""Benchmark decontamination over a distributed positional inverted index.

The test items are cut into windows of consecutive words. One pass counts how
often the corpus has each test term, so that every window knows its rarest
term. The index then stores the postings (document, position) of those rarest
terms only, each with the terms around it: the entries of the neighbouring
lists that an intersection could ever ask for. A window's matches are found by
joining on its rarest term, shifting by its offset and keeping the postings at
whose shifted offsets all its other terms stand (phrase), or near which enough
of them stand in any order (proximity).

All of it is DataFrame expressions. Nothing grows with the square of a group:
a posting meets the windows of its term, no other posting.

Edge cases: null or wordless texts have no words and no hits; wordless items
have no windows, items shorter than a window are one window; equal texts share
their result, so repeated rows and null ids are fine; an empty corpus or
benchmark gives no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import ascii_lower, small, stored, table, words_between

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def terms_of(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return words_between(ascii_lower(text), WORD_GAP)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; equal texts share them."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: terms and the sorted ids (strings) of the items that have them."""
    words = items.select(F.col(item).cast("string").alias("item"), terms_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms"))
    return cut.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term, n: occurrences in the corpus of the given distinct terms."""
    words = docs.select(F.explode(terms_of(F.col(text))).alias("term"))
    return words.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with term and offset (from 0) of the rarest term; windows with an absent term go."""
    each = windows.select("terms", "items", F.posexplode("terms").alias("offset", "term"))
    known = each.join(counts, "term")
    best = known.groupBy("terms").agg(F.min(F.struct("n", "term", "offset")).alias("_b"), F.count("*").alias("_n"), F.first("items").alias("items"))
    return best.where(F.col("_n") == F.size("terms")).select("terms", "items", F.col("_b.term").alias("term"), F.col("_b.offset").alias("offset"))


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text", around: int = WINDOW - 1) -> DataFrame:
    """Postings of the given terms: term, doc (text key), pos, first, near (terms at first, first + 1, …)."""
    words = docs.select(text_key(F.col(text)).alias("doc"), terms_of(F.col(text)).alias("w"))
    # the word list is evaluated once for both, below the generator
    postings = words.select("doc", "w", F.posexplode("w").alias("pos", "term")).join(small(terms), "term")
    first = F.greatest(F.col("pos") - around, F.lit(0))
    return postings.select("term", "doc", "pos", first.alias("first"), F.slice("w", first + 1, F.col("pos") - first + around + 1).alias("near"))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """doc, start, stop (exclusive), items: every exact occurrence of a window."""
    start = F.col("pos") - F.col("offset")
    same = F.slice("near", start - F.col("first") + 1, F.size("terms")) == F.col("terms")
    fits = start >= F.col("first")
    found = index.join(small(windows), "term").where(fits).where(F.when(fits, same))
    return found.select("doc", start.alias("start"), (start + F.size("terms")).alias("stop"), "items")


def proximity_matches(index: DataFrame, windows: DataFrame, share: float = 0.8) -> DataFrame:
    """doc, pos, items, found: windows of whose distinct terms ``share`` stand near their rarest term."""
    found = F.size(F.array_intersect("near", "terms"))
    rows = index.join(small(windows), "term").withColumn("found", found)
    return rows.where(F.col("found") >= share * F.size(F.array_distinct("terms"))).select("doc", "pos", "items", "found")


def _covered(spans: Column) -> Column:
    """Positions inside any of the sorted (start, stop) spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(a, s):
        add = F.greatest(s["stop"] - F.greatest(s["start"], a["upto"]), F.lit(0))
        return F.struct(F.greatest(a["upto"], s["stop"]).alias("upto"), (a["n"] + add).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def search(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc (text key), start, stop, items: all windows of the items found in the documents."""
    windows = stored(item_windows(items, item, item_text, window), "windows")
    terms = stored(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = stored(term_counts(docs, terms, text), "counts")
    keyed = stored(rarest_terms(windows, counts), "rarest")
    index = stored(build_index(docs, stored(keyed.select("term").distinct(), "keys"), text, window - 1), "postings")
    return phrase_matches(index, keyed)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items (sorted strings), spans of hit words."""
    hits = search(docs, items, text, item, item_text, window)
    per_doc = hits.groupBy("doc").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    found = stored(per_doc.withColumn("n_hit", _covered(F.col("spans")).cast("long")), "hits")
    rows = docs.select(F.col(key).alias(key), text_key(F.col(text)).alias("doc"), F.size(terms_of(F.col(text))).cast("long").alias("n_words"))
    return rows.join(small(found), "doc", "left").select(key, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
