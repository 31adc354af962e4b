"""Answers from table rows: requested columns, lookups, sums, facts in front of the evidence.

Rows are those of `tables.rank_rows`: (query_id, place, chunk_id, file_name, row_no, row_score, headers, cells), a handful
for each question, so that a question's rows may meet in one group. Rows that score 0 give facts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.functions.questions import first_of_each
from corvida.operators.tables import extremes, facts, normalized, table_terms

# The wording around facts, and the score that puts them first.
VERIFIED = "VERIFIED ANSWER extracted from table data: "
VERIFIED_FACTS = "\n\nTABLE FACTS:\n"
VERIFIED_END = "\n\nPresent this answer in clear, natural language. Preserve all numeric values exactly."
FACTS = "TABLE FACTS extracted from retrieved table rows:\n"
FACTS_END = "\n\nUse these facts exactly. Preserve numeric formatting and refuse if a requested value is missing."
FIRST_SCORE = 3.4028234663852886e38


def _by_question(rows: DataFrame) -> DataFrame:
    return rows.where("row_score > 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "file_name", "row_score", "headers", "cells"))).alias("rows"))


def _labels(query: Column, rows: Column) -> Column:
    """Labels of each row's cells, then its table's headers, blank cells' ones too; and each `col n`."""
    labels = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.concat(F.transform(r.cells, lambda c: c.label), r.headers))))
    named = F.filter(labels, lambda x: (F.length(normalized(x)) > 1) & F.contains(normalized(query), normalized(x)))
    numbers = F.regexp_extract_all(F.lower(query), F.lit(r"\bcol(?:umn)?\s*(\d+)\b"), F.lit(1))
    return first_of_each(F.concat(named, F.transform(numbers, lambda n: F.concat(F.lit("Col "), n))), normalized)


def requested_columns(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, labels): labels that the question holds, letters and digits compared, and its `col n`."""
    return questions.join(_by_question(rows), "query_id").select("query_id", _labels(F.col("query"), F.col("rows")).alias("labels"))


def lookup(questions: DataFrame, rows: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, answer, confident): the best row's requested cells, else its first `most`; sure from a row score of 2."""
    got = questions.join(_by_question(rows), "query_id").select("query_id", F.element_at("rows", 1).alias("r"), _labels(F.col("query"), F.col("rows")).alias("labels"))
    same = lambda a, b: F.contains(normalized(a), normalized(b)) | F.contains(normalized(b), normalized(a))
    asked = F.filter("r.cells", lambda c: F.exists("labels", lambda x: same(x, c.label)))
    got = got.withColumn("picked", F.when(F.size("labels") > 0, asked).otherwise(F.slice("r.cells", 1, most))).where(F.size("picked") > 0)
    values = F.array_join(F.transform("picked", lambda c: F.concat_ws(": ", c.label, c.value)), "; ")
    name = F.element_at("r.cells", 1).value
    return got.select("query_id", F.concat(name, F.lit(" — "), values, F.lit(" (Source: "), F.col("r.file_name"), F.lit(")")).alias("answer"), (F.col("r.row_score") >= 2).alias("confident"))


def sums(questions: DataFrame, rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, answer) `a + b = c` over numeric cells of rows that share a term with the question (in chunk text, label
    or value); each label and value of a chunk once; only where 2 to 8 of them are left and the question asks for a sum."""
    q = F.lower("query")
    asked = questions.where(F.contains(q, F.lit("sum")) | F.contains(q, F.lit("combined")) | F.contains(q, F.lit("total of"))).select("query_id", table_terms(F.col("query")).alias("terms"))
    texts = chunks.select("chunk_id", normalized(F.concat_ws(" ", "file_name", "content")).alias("text"))
    used = rows.where("row_score > 0").join(asked, "query_id")
    found = used.select("query_id", "chunk_id", "terms").distinct().join(texts, "chunk_id").select("query_id", "chunk_id", F.exists("terms", lambda t: F.contains("text", t)).alias("found"))
    got = used.join(found, ["query_id", "chunk_id"])
    own = F.transform("cells", lambda c: normalized(F.concat_ws(" ", c.label, c.value)))
    got = got.withColumn("found", F.col("found") | F.exists(own, lambda c: F.exists("terms", lambda t: F.contains(c, t))))
    got = got.where("found").select("query_id", "place", "chunk_id", "file_name", F.posexplode("cells").alias("at", "c")).withColumn("number", T.parse_number(F.col("c.value"))).where("number is not null")
    once = got.groupBy("query_id", "chunk_id", F.col("c.label").alias("label"), F.col("c.value").alias("value")).agg(F.min(F.struct("place", "at", "file_name", "number")).alias("m"))
    all_ = once.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("m.place", "m.at", "m.number", "m.file_name", "value"))).alias("l")).where("n between 2 and 8")
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x.number)
    shown = F.when(F.abs(total - total.cast("long")) < 0.0001, total.cast("long").cast("string")).otherwise(F.format_string("%.2f", total))
    return all_.select("query_id", F.concat(F.array_join(F.transform("l", lambda x: x.value), " + "), F.lit(" = "), shown, F.lit(" (Source: "), F.element_at("l", 1).file_name, F.lit(")")).alias("answer"))


def inject_facts(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, rank, score, content) with a row of facts in front of each question that has some.
    answers: (query_id, facts, answer, confidence NONE, MEDIUM or HIGH). A question without hits gets none."""
    anchor = hits.groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("anchor"))
    told = anchor.join(answers.where(F.col("confidence").isin("MEDIUM", "HIGH") & (T.trimmed(F.col("facts")) != "")), "query_id")
    sure = (F.col("confidence") == "HIGH") & F.col("answer").isNotNull()
    content = F.when(sure, F.concat(F.lit(VERIFIED), "answer", F.lit(VERIFIED_FACTS), "facts", F.lit(VERIFIED_END))).otherwise(F.concat(F.lit(FACTS), "facts", F.lit(FACTS_END)))
    new = told.select("query_id", F.concat(F.lit("table-facts:"), "anchor").alias("chunk_id"), F.lit(0).cast("long").alias("rank"), F.lit(FIRST_SCORE).alias("score"), content.alias("content"))
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"), "content").unionByName(new)


def table_answers(questions: DataFrame, rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, facts, answer, confidence) of table questions with rows: an extreme, else a sum, else a sure lookup (HIGH),
    else facts alone (MEDIUM), those of the first rows where none shares a term with the question. Others have no row."""
    asked = questions.where(T.is_table_question(F.col("query")))
    answered = [t.select("query_id", F.col("answer").alias(name)) for t, name in ((extremes(rows, asked), "extreme"), (sums(asked, rows, chunks), "total"), (lookup(asked, rows).where("confident"), "looked"))]
    got = facts(rows).join(asked.select("query_id"), "query_id", "left_semi")
    for part in answered:
        got = got.join(part, "query_id", "left")
    got = got.withColumn("answer", F.coalesce("extreme", "total", "looked"))
    return got.select("query_id", "facts", "answer", F.when(F.col("answer").isNotNull(), "HIGH").otherwise("MEDIUM").alias("confidence"))
