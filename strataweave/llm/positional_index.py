"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

Training texts are cut into words once; the positions of all words that occur
in a test item are stored as postings ``(document key, position, term)``. Test
items are then matched from their rarest terms on:

1. Term frequencies come from the postings. Of every test window (``width``
   consecutive words; the whole item if it is shorter) the ``rarest`` least
   frequent terms are its anchors; a window with a term that no text has is
   out.
2. The postings of the anchors, each shifted by the anchor's place in its item,
   are intersected: only shifts (*diagonals*) on which enough anchor lists meet
   go on.
3. On these the remaining terms' lists are intersected, shifted alike. Runs of
   consecutive matches as long as a window are exact occurrences.

Frequent terms' lists are thus read only where rare terms have met. A phrase
that a third of all texts share makes rows in proportion to its occurrences;
every shuffle is keyed by document and diagonal, and test-side tables are
broadcast only up to a checked number of rows.

A proximity match is looser: the least frequent terms of a window stand in a text
in any order, each at most ``slop`` words away from where the others put it. Its
lists are intersected over a sliding range of shifts, so no place is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain_words, release, small, stored


def document_key(doc_id: str, text: str) -> list[Column]:
    """96 bits that stand for a row's id and text and are never null; equal rows share them."""
    both = (F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return [F.xxhash64(*both).alias("k1"), F.hash(*both).alias("k2")]


def test_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(ik, item, ipos, word, len)``: the words of each distinct item; items without words have no rows."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), plain_words(F.col(text)).alias("words")).where(F.size("words") > 0).distinct()
    rows = stored(rows.withColumn("ik", F.monotonically_increasing_id()), "items")
    return rows.select("ik", "item", F.size("words").alias("len"), F.posexplode("words").alias("ipos", "word"))


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: ``(k1, k2, pos, tid)`` of all words in ``terms(word, tid)``; word positions count from 0."""
    words = docs.select(*document_key(doc_id, text), plain_words(F.col(text)).alias("words"))
    each = words.select("k1", "k2", F.posexplode("words").alias("pos", "word"))
    return each.join(small(terms), "word").select("k1", "k2", "pos", "tid")


def _windows(terms: DataFrame, width: int) -> DataFrame:
    """Every term once for each window (``start``) that it stands in; ``terms(ik, item, len, ipos, tid, n)``."""
    starts = F.sequence(F.greatest(F.col("ipos") - (width - 1), F.lit(0)), F.least("ipos", F.greatest(F.col("len") - width, F.lit(0))))
    return terms.select("ik", "item", "ipos", "tid", "n", "len", F.explode(starts).alias("start"))


def diagonals(index: DataFrame, terms: DataFrame, width: int, rarest: int) -> DataFrame:
    """``(k1, k2, ik, delta)`` where the lists of enough anchors meet."""
    window = W.partitionBy("ik", "start")
    ranked = _windows(terms, width).withColumn("least", F.min("n").over(window)).where("least > 0").withColumn("rank", F.row_number().over(window.orderBy("n", "ipos")))
    anchors = stored(ranked.where(F.col("rank") <= rarest).select("ik", "ipos", "tid", F.least(F.lit(rarest), "len").alias("need")).distinct(), "anchors")
    met = index.join(small(anchors), "tid").select("k1", "k2", "ik", (F.col("pos") - F.col("ipos")).alias("delta"), "need")
    return met.groupBy("k1", "k2", "ik", "delta").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need")).where("met >= need").select("k1", "k2", "ik", "delta")


def phrase_matches(index: DataFrame, terms: DataFrame, width: int = 10, rarest: int = 2) -> DataFrame:
    """Exact occurrences ``(k1, k2, item, start, end)``: maximal runs of an item's words, at least a window long; places in the text, end included."""
    found = stored(diagonals(index, terms, width, rarest), "diagonals")
    lists = terms.groupBy("ik").agg(F.first("item").alias("item"), F.first("len").alias("len"), F.collect_list(F.struct("ipos", "tid")).alias("list"))
    lists = stored(lists, "lists")
    due = found.join(small(lists, terms.count()), "ik").select("k1", "k2", "ik", "item", "len", "delta", F.explode("list").alias("t"))
    due = due.select("k1", "k2", "ik", "item", "len", "delta", (F.col("delta") + F.col("t.ipos")).alias("pos"), F.col("t.tid").alias("tid")).where("pos >= 0")
    keys = stored(found.select("k1", "k2").distinct(), "keys")
    there = index.join(small(keys), ["k1", "k2"], "left_semi")
    met = due.join(there.distinct(), ["k1", "k2", "pos", "tid"])
    line = W.partitionBy("k1", "k2", "ik", "delta").orderBy("pos")
    runs = met.withColumn("run", F.col("pos") - F.row_number().over(line))
    runs = runs.groupBy("k1", "k2", "ik", "delta", "run").agg(F.first("item").alias("item"), F.first("len").alias("len"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    return runs.where((F.col("end") - F.col("start") + 1) >= F.least(F.lit(width), "len")).select("k1", "k2", "item", "start", "end")


def proximity_matches(index: DataFrame, terms: DataFrame, width: int = 10, rarest: int = 3, slop: int = 5) -> DataFrame:
    """Distinct ``(k1, k2, item)`` where the ``rarest`` least frequent terms of a window of ``item`` stand with shifts at most ``slop`` apart.

    A term's shift is its place in the text less its place in the item. Terms
    that no text has are passed over; a window with fewer terms left than
    ``rarest`` (or than it has words, if these are fewer) has no match. Windows
    with the same rarest terms are one.
    """
    window = W.partitionBy("ik", "start").orderBy("n", "ipos")
    ranked = _windows(terms, width).where("n > 0").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= rarest)
    sets = ranked.groupBy("ik", "start").agg(F.sort_array(F.collect_list(F.struct("ipos", "tid"))).alias("of"), F.first("item").alias("item"), F.min(F.least(F.lit(rarest), F.lit(width), "len")).alias("need"))
    sets = stored(sets.where(F.size("of") == F.col("need")).select("ik", "item", "need", "of").distinct(), "sets")
    # a text's places of an item's rarest terms meet once, however many windows share them
    anchors = stored(sets.select("ik", "need", F.explode("of").alias("t")).select("ik", "need", "t.ipos", "t.tid").distinct(), "near_anchors")
    met = index.join(small(anchors), "tid").select("k1", "k2", "ik", "need", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"))
    line = W.partitionBy("k1", "k2", "ik").orderBy("shift").rangeBetween(0, slop)
    near = met.withColumn("there", F.collect_set("ipos").over(line)).where(F.size("there") >= F.col("need")).select("k1", "k2", "ik", "there")
    wanted = stored(sets.groupBy("ik").agg(F.first("item").alias("item"), F.collect_list("of.ipos").alias("sets")), "near_sets")
    both = near.join(small(wanted), "ik").where(F.exists("sets", lambda s: F.size(F.array_except(s, F.col("there"))) == 0))
    return both.select("k1", "k2", "item").distinct()


def index_for(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored postings and the test terms with their ids and corpus frequencies."""
    words = stored(test_terms(items, text=text), "terms")
    vocabulary = stored(words.select("word").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    index = stored(postings(docs, vocabulary, doc_id, text), "postings")
    counts = index.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    known = vocabulary.join(counts, "tid", "left").select("word", "tid", F.coalesce("n", F.lit(0)).alias("n"))
    return index, stored(words.join(known, "word").select("ik", "item", "len", "ipos", "tid", "n"), "test_terms")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2, doc_id: str = "doc_id", text: str = "text", near_rarest: int = 3, slop: int = 5) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    ``n_near`` counts the items with a proximity match (``near_rarest`` terms,
    ``slop``); it decides nothing. Null and empty texts have no words and no
    hits. Repeated rows get the same result each. A null item id counts for hits
    and not as an item. Items that share a passage are all listed. Without items
    nothing is hit. Further columns are ignored.
    """
    index, terms = index_for(docs, items, doc_id, text)
    runs = stored(phrase_matches(index, terms, width, rarest), "runs")
    near = stored(proximity_matches(index, terms, width, near_rarest, slop).where("item is not null"), "near")
    release(index)
    places = runs.select("k1", "k2", F.explode(F.sequence("start", "end")).alias("pos")).distinct()
    hits = places.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
    named = runs.where("item is not null").select("k1", "k2", "item").distinct().groupBy("k1", "k2")
    named = named.agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    about = near.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_near"))
    found = stored(hits.join(named, ["k1", "k2"], "left").join(about, ["k1", "k2"], "full"), "found")
    base = docs.select(F.col(doc_id).alias("doc_id"), *document_key(doc_id, text), F.size(plain_words(F.col(text))).cast("long").alias("n_words"))
    some = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = base.join(found, ["k1", "k2"], "left").select("doc_id", "n_words", some("n_hit"), some("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), some("n_near"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, without any hit word.

    Null and blank texts stay; repeated rows stay or go together; without items
    all stay; an empty table stays empty.
    """
    index, terms = index_for(docs, items)
    hit = stored(phrase_matches(index, terms, **options).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "hit")
    release(index)
    k1, k2 = document_key("doc_id", "text")
    gone = small(hit)
    return docs.join(gone, (k1 == gone["_k1"]) & (k2 == gone["_k2"]), "left_anti")
