"""Passages of test items inside a corpus, found through a positional inverted index.

The index is a stored table of postings ``doc_id, at, term`` with both neighbours of the term, for the terms that test items
use; it lies in the order of the documents, so the lists of a frequent term are spread over the cluster and nothing
shuffles to build it. Every window of the sought length gets its rarest term as anchor. The anchors' lists, met with those
of their neighbours and shifted by their place in the item, name the diagonals on which all other lists are intersected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, met, stored

LEAST_RUN = 12
#: A near match: so many runs of three words within ``LEAST_RUN`` item words on so many adjacent diagonals.
LEAST_THREES, BAND = 4, 3
#: Tables of test items and named documents up to so many rows are sent to every task; larger ones are joined by shuffle.
SENT_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Words: runs of letters and digits in lower case. Null gives null, a text without words an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _placed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, term, before, after``: every word with its neighbours ('' at the ends)."""
    own = rows.where(f"{key} is not null and {text} is not null").select(key, tokens(F.col(text)).alias("w"))
    none = F.array(F.lit(""))
    threes = F.arrays_zip(F.col("w").alias("term"), F.concat(none, "w").alias("before"), F.concat(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), none).alias("after"))
    return own.select(key, F.posexplode(threes).alias("at", "x")).select(key, "at", F.col("x")["term"].alias("term"), F.col("x")["before"].alias("before"), F.col("x")["after"].alias("after")).where("term is not null")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, at, term, before, after`` of the test items."""
    return cut_lineage(_placed(items, "item_id", "item_text").distinct())


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, at, term, before, after``: the postings of all documents, whole texts, for the given ``term`` rows.

    Rows of one doc_id are read as one document: their positions are united.
    """
    return stored(met(_placed(documents, "doc_id", "text"), terms.select("term").distinct(), "term", "left_semi", SENT_ROWS), "postings")


def anchors(index: DataFrame, terms: DataFrame, run: int = LEAST_RUN) -> DataFrame:
    """``item_id, place, term, before, after``: of every window of ``run`` words of an item its rarest inner term (ties: the first)."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    known = met(terms, counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("item_id").orderBy("at")
    inner = w.rowsBetween(min(1, run - 1), max(run - 2, 0))
    best = known.select("item_id", F.min(F.struct("n", "at", "term", "before", "after")).over(inner).alias("b"), F.count("*").over(w.rowsBetween(0, run - 1)).alias("size"))
    return best.where(F.col("size") == run).select("item_id", F.col("b.at").alias("place"), "b.term", "b.before", "b.after").distinct()


def diagonals(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, item_id, place, shift``: places where a term of the item stands in the document between the same neighbours."""
    return met(index, chosen, ["term", "before", "after"], limit=SENT_ROWS).select("doc_id", "item_id", "place", (F.col("at") - F.col("place")).alias("shift"))


def exact(index: DataFrame, terms: DataFrame, run: int = LEAST_RUN) -> DataFrame:
    """``doc_id, item_id, longest_run``: documents with ``run`` (three at least) or more consecutive words of an item."""
    lines = cut_lineage(diagonals(index, anchors(index, terms, run)).select("doc_id", "item_id", "shift").distinct())
    # All lists of the named documents at the places the diagonals ask for.
    lists = met(index, lines.select("doc_id").distinct(), "doc_id", "left_semi", SENT_ROWS).select("doc_id", "at", "term").distinct()
    wanted = met(lines, terms.select("item_id", F.col("at").alias("place"), "term"), "item_id", limit=SENT_ROWS).withColumn("at", F.col("shift") + F.col("place"))
    hits = met(wanted, lists, ["doc_id", "at", "term"])
    island = F.col("place") - F.row_number().over(Window.partitionBy("doc_id", "item_id", "shift").orderBy("place"))
    runs = hits.withColumn("island", island).groupBy("doc_id", "item_id", "shift", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id", "item_id").agg(F.max("n").alias("longest_run")).where(F.col("longest_run") >= run)


def near(index: DataFrame, terms: DataFrame, run: int = LEAST_RUN, threes: int = LEAST_THREES, band: int = BAND) -> DataFrame:
    """``doc_id, item_id, best_window``: documents in which ``threes`` runs of three of ``run`` item words in a row stand on ``band`` adjacent diagonals.

    With the given numbers that is every passage of twelve item words with up to two words replaced, left out or inserted:
    ten words in three runs hold four runs of three, and each change moves what follows by a diagonal at most.
    """
    stands = diagonals(index, terms.where("before <> '' and after <> ''").withColumnRenamed("at", "place").distinct())
    lines = stands.select("doc_id", "item_id", "place", F.explode(F.sequence(F.col("shift") - (band - 1), F.col("shift"))).alias("shift"))
    places = lines.groupBy("doc_id", "item_id", "shift").agg(F.sort_array(F.collect_set("place")).alias("p")).where(F.size("p") >= threes)
    dense = F.array_max(F.transform("p", lambda a: F.size(F.filter("p", lambda b: (b >= a) & (b <= a + (run - 3))))))
    return places.groupBy("doc_id", "item_id").agg(F.max(dense).cast("bigint").alias("best_window")).where(F.col("best_window") >= threes)


def matches(documents: DataFrame, items: DataFrame, run: int = LEAST_RUN) -> DataFrame:
    """``doc_id, item_id, longest_run``: documents with ``run`` or more consecutive words of an item.

    What stands between words does not matter. Null and empty texts, null ids, and items shorter than ``run`` match nothing;
    no documents or no items give no rows. Items of any number are taken: beyond ``SENT_ROWS`` words they meet the postings
    by shuffle.
    """
    terms = item_terms(items)
    return exact(build_index(documents, terms), terms, run)


def all_matches(documents: DataFrame, items: DataFrame, run: int = LEAST_RUN) -> DataFrame:
    """``doc_id, item_id, kind, longest_run, best_window, item_words``: exact and near matches.

    ``kind`` is exact for the rows of :func:`matches`, else near; a near row has no ``longest_run``.
    """
    terms = item_terms(items)
    index = build_index(documents, terms)
    size = terms.groupBy("item_id").agg((F.max("at") + 1).cast("bigint").alias("item_words"))
    both = near(index, terms, run).join(exact(index, terms, run).hint("merge"), ["doc_id", "item_id"], "full")
    kind = F.when(F.col("longest_run").isNotNull(), "exact").otherwise("near")
    return met(both, size, "item_id", limit=SENT_ROWS).select("doc_id", "item_id", kind.alias("kind"), "longest_run", "best_window", "item_words")
