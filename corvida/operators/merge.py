"""Merges of retrieval results: by mode, after another try, with supplements, as tool answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.operators import retrieve as R
from corvida.sources.folders import written

HIT = ["query_id", "chunk_id", "rank", "score"]


def by_mode(modes: DataFrame, vector: DataFrame, keyword: DataFrame, hybrid: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, chunk_id, rank, score) of the mode that each question has in modes (query_id, mode: VECTOR, BM25 or
    HYBRID), and, if chunks are given, their groups and sections. Every side is cut to its questions before the union."""
    got = None
    for mode, side in (("VECTOR", vector), ("BM25", keyword), ("HYBRID", hybrid)):
        part = side.select(*HIT).join(modes.where(F.col("mode") == mode).select("query_id"), "query_id", "left_semi")
        got = part if got is None else got.unionByName(part)
    return got if chunks is None else expanded(got, chunks)


def expanded(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the neighbours of their groups, then those of their sections."""
    return R.expand_sections(R.expand_groups(hits, chunks), chunks)


def requery(search: Callable[[DataFrame], DataFrame], tries: DataFrame, most: int = 2) -> DataFrame:
    """Hits of an iterated search. tries (query_id, attempt, query, action): a question's text at attempt 0 and its
    rephrasings, and the label of what each attempt found. `search` takes (query_id, query) and gives HIT.

    While a set is labelled REQUERY and there is a rephrasing, the next attempt is searched for, by these questions alone,
    and replaces it; one that finds nothing ends the search and the old set stays. Each attempt's rows are written, so
    that the next one's search doesn't run those before it again.
    """
    ask = tries.where("attempt = 0")
    hits = written(search(ask.select("query_id", "query")).select(*HIT), "hits")
    open_ = ask.where("action = 'REQUERY'").select("query_id")
    for attempt in range(1, most + 1):
        ask = tries.where(F.col("attempt") == attempt).join(open_, "query_id", "left_semi")
        found = written(search(ask.select("query_id", "query")).select(*HIT), "hits")
        hits = hits.join(found, "query_id", "left_anti").unionByName(found)
        open_ = ask.where("action = 'REQUERY'").select("query_id").join(found, "query_id", "left_semi")
    return hits


def supplement(hits: DataFrame, extra: DataFrame, actions: DataFrame, k: int = 5) -> DataFrame:
    """hits and, for questions with action SUPPLEMENT, the three best of extra; each chunk once, its first score; by score,
    the best k. Other questions keep their hits."""
    asked = actions.where("action = 'SUPPLEMENT'").select("query_id")
    more = extra.where("rank <= 3").join(asked, "query_id", "left_semi").select(*HIT, F.lit(1).alias("late"))
    both = hits.select(*HIT, F.lit(0).alias("late")).unionByName(more)
    once = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("late", "rank")).alias("at"), F.min_by("score", F.struct("late", "rank")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "at", "chunk_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*HIT)


def gap_merge(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """hits, then the three best of extra that are not among them, in order."""
    more = extra.where("rank <= 3").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("late", "was", "chunk_id")
    both = hits.select("query_id", "chunk_id", "score", F.col("rank").alias("was"), F.lit(0).alias("late")).unionByName(more.select("query_id", "chunk_id", "score", F.col("rank").alias("was"), F.lit(1).alias("late")))
    return both.withColumn("rank", F.row_number().over(w)).select(*HIT)


def search_results(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions (query_id, max_results), hits (query_id, rank, score, file_name, content) to one row per question: status,
    result_count and numbered passages. The number of results is held between 1 and 10."""
    most = questions.select("query_id", F.least(F.greatest(F.col("max_results"), F.lit(1)), F.lit(10)).alias("most"))
    told = hits.join(most, "query_id").where("rank <= most")
    passage = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("file_name"), F.lit(" ("), F.format_string("%.3f", F.col("score").cast("double")), F.lit(")\n"), F.col("content"))
    per = told.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("l"))
    return questions.select("query_id").join(per, "query_id", "left").select("query_id", F.when(F.col("n").isNull(), "no_results").otherwise("success").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("result_count"), F.coalesce(F.array_join(F.transform("l", lambda x: x.p), "\n\n"), F.lit("")).alias("passages"))
