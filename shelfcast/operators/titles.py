"""Title search for a whole table of queries: the best five catalogue titles each.

A title is a candidate if it shares a word with the query. More shared distinct
words come first, then fewer distinct words in the title, then the shorter
title, then the lower id. Only the first of these depends on the query.

A word is hot if joining on it would give more than ``hot_pairs`` pairs. Titles that share another word
with a query are found through that word. Titles that share hot words only are found through posting lists: every set
of hot words that a title holds has a list of the titles that hold all of it, in the order that does not depend on the query, cut
to a page. Where a query and a title share the hot words T and nothing else, all titles ahead on the list of T share at
least as much with the query; so a title on the query's page is on the cut list of T, and a query reads one
page for each set of its own hot words, however many titles hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import new_path
from shelfcast.sources.sinks import write_snapshot

PAGE_SIZE = 5
HOT_PAIRS = 1_000_000
# a title or query has a list for each of the 2^n sets of its n hot words; those with more are compared word by word
WIDE = 10


def words(text: Column) -> Column:
    """Distinct lower-case words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")))


def title_candidates(
    queries: DataFrame, titles: DataFrame, size: int = PAGE_SIZE, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """``queries(query_id, query)`` against ``titles(game_id, name)``; blank queries find nothing."""
    # the same words typed many times are searched once
    asked = queries.select("query_id", words("query").alias("query_words")).where(F.size("query_words") > 0)
    searches = asked.select("query_words").distinct()
    listed = titles.select("game_id", "name", words("name").alias("title_words"))

    hot = hot_words(searches, listed, hot_pairs)
    if hot.take(1):
        # written once: pairs are found in several ways, and all of them read both
        searches = _written(_with_hot(searches, ["query_words"], "query_words", hot), "searches")
        listed = _written(_with_hot(listed, ["game_id", "name", "title_words"], "title_words", hot), "listed-titles")
        found = _through_rare_words(searches, listed).unionByName(_through_hot_sets(searches, listed, size))
    else:
        none = F.array().cast("array<string>")
        found = _through_rare_words(searches.withColumn("hot", none), listed.withColumn("hot", none))
    best = Window.partitionBy("query_words").orderBy(
        F.desc("shared"), F.asc("n_words"), F.asc("n_chars"), F.asc("game_id")
    )
    ranked = found.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= size)
    return asked.hint("merge").join(ranked, "query_words").select("query_id", "rank", "game_id", "name", "shared")


def hot_words(searches: DataFrame, listed: DataFrame, hot_pairs: int) -> DataFrame:
    """The words with more than ``hot_pairs`` pairs, written once; two sides read them."""

    def counts(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias(name))

    # both lists of words grow with the rows
    both = counts(listed, "title_words", "titles").join(counts(searches, "query_words", "queries").hint("merge"), "word")
    return _written(both.where(F.col("queries").cast("double") * F.col("titles") > hot_pairs).select("word"), "hot-words")


def _written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).parquet(write_snapshot(rows, new_path(spark, name)))


def _with_hot(rows: DataFrame, key: list[str], column: str, hot: DataFrame) -> DataFrame:
    """Adds the row's hot words, sorted; only the list of hot words may be broadcast, never the rows."""
    hits = rows.select(*key, F.explode(column).alias("word")).join(hot, "word", "left_semi")
    lists = hits.groupBy(*key).agg(F.array_sort(F.collect_set("word")).alias("hot"))
    return rows.join(lists.hint("merge"), key, "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<string>")))


def _ranking_columns() -> list[Column]:
    return [
        F.col("game_id"),
        F.col("name"),
        F.size("title_words").alias("n_words"),
        F.length("name").alias("n_chars"),
    ]


def _through_rare_words(searches: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs that share a word outside the hot ones, each once, with all shared words counted."""
    by_query = searches.select(
        "query_words",
        F.array_except("query_words", "hot").alias("rare"),
        F.explode(F.array_except("query_words", "hot")).alias("word"),
    )
    by_title = listed.select(
        "title_words", *_ranking_columns(), F.explode(F.array_except("title_words", "hot")).alias("word")
    )
    shared = F.array_intersect("query_words", "title_words")
    # the smallest shared rare word keeps the pair
    keeper = F.array_min(F.array_intersect("rare", "title_words"))
    return (
        by_query.join(by_title.hint("merge"), "word")
        .where(F.col("word") == keeper)
        .select("query_words", "game_id", "name", "n_words", "n_chars", F.size(shared).cast("bigint").alias("shared"))
    )


def _sets(words: Column) -> Column:
    """All sets of an array's values but the empty one, each in the array's order."""
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate(words, none, lambda sets, w: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(w)))))
    return F.filter(every, lambda s: F.size(s) > 0)


def _through_hot_sets(searches: DataFrame, listed: DataFrame, size: int) -> DataFrame:
    """The pairs that share hot words only, or some of those that share others too, which do no harm twice."""
    listed = listed.where(F.size("hot") > 0).select("hot", "title_words", *_ranking_columns())
    searches = searches.where(F.size("hot") > 0)
    narrow = F.size("hot") <= WIDE
    best = Window.partitionBy("held").orderBy("n_words", "n_chars", "game_id")
    # tasks cut to ``size`` titles per list before the shuffle
    lists = (
        listed.where(narrow)
        .withColumn("held", F.explode(_sets(F.col("hot"))))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= size)
        .drop("hot", "place")
    )
    shared = F.size(F.array_intersect("query_words", "title_words")).cast("bigint").alias("shared")
    read = searches.where(narrow).select("query_words", F.explode(_sets(F.col("hot"))).alias("held")).join(lists.hint("merge"), "held")
    # what shares more than the list's words is on a longer list, or shares a word that is not hot
    found = read.select("query_words", "held", "game_id", "name", "n_words", "n_chars", shared).where(F.size("held") == F.col("shared"))
    found = found.drop("held")
    # either side may have no wide rows, and then the other is not read
    if listed.where(~narrow).take(1):
        found = found.unionByName(_word_by_word(_by_query(searches), _by_title(listed.where(~narrow))))
    if searches.where(~narrow).take(1):
        found = found.unionByName(_word_by_word(_by_title(listed.where(narrow)), _by_query(searches.where(~narrow))))
    return found


def _by_query(searches: DataFrame) -> DataFrame:
    return searches.select("query_words", "hot", F.explode("hot").alias("word"))


def _by_title(listed: DataFrame) -> DataFrame:
    return listed.withColumnRenamed("hot", "title_hot").withColumn("word", F.explode("title_hot"))


def _word_by_word(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs that share hot words only, one by one; a task holds the wide rows of a word and passes over the others."""
    common = F.array_intersect("hot", "title_hot")
    shared = F.size(F.array_intersect("query_words", "title_words"))
    return (
        rows.join(wide.hint("merge"), "word")
        # the smallest common hot word keeps the pair
        .where((F.col("word") == F.array_min(common)) & (F.size(common) == shared))
        .select("query_words", "game_id", "name", "n_words", "n_chars", shared.cast("bigint").alias("shared"))
    )
