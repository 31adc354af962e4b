"""Questions over tables written as Markdown inside chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import text as T


def to_markdown(headers: Column, rows: Column) -> Column:
    """Header, dashes and one line per row; blank cells are -, blank headers Col n."""
    named = F.transform(headers, lambda h, i: F.when(T.trimmed(h) == "", F.concat(F.lit("Col "), (i + 1).cast("string"))).otherwise(h))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.when(T.trimmed(F.coalesce(c, F.lit(""))) == "", F.lit("-")).otherwise(c)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(named), rule), F.transform(rows, line)), "\n")


def parsed_tables(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, content, others), those that hold a table, with its headers and its rows array<struct<row_no, cells
    array<struct<col, label, value>>>>: the first | line is the header, dash lines are skipped, blank and - cells dropped,
    rows without a cell too, missing labels are Col n."""
    bars = F.filter(F.transform(F.split("content", "\n"), T.trimmed), lambda x: F.startswith(x, F.lit("|")))
    split = F.transform(bars, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), T.trimmed))
    kept = F.filter(split, lambda r: ~F.forall(r, lambda c: F.regexp_replace(c, "-", "") == ""))
    got = chunks.withColumn("lines", kept).where(F.size("lines") > 1).withColumn("headers", F.element_at("lines", 1))
    cell = lambda v, i: F.struct(i.alias("col"), F.coalesce(F.get("headers", i), F.concat(F.lit("Col "), (i + 1).cast("string"))).alias("label"), v.alias("value"))
    row = lambda r, i: F.struct(i.alias("row_no"), F.filter(F.transform(r, cell), lambda c: ~c.value.isin("", "-")).alias("cells"))
    rows = F.transform(F.slice("lines", F.lit(2), F.size("lines") - 1), row)
    return got.withColumn("rows", F.filter(rows, lambda r: F.size(r.cells) > 0)).drop("lines")


def markdown_cells(chunks: DataFrame) -> DataFrame:
    """(chunk_id, row_no, col, label, value) of the tables in chunks(chunk_id, content), see parsed_tables."""
    # an inner explode would have its rows parsed once more in a filter below, for each of their cells
    rows = parsed_tables(chunks.select("chunk_id", "content")).select("chunk_id", F.explode_outer("rows").alias("r"))
    cells = rows.select("chunk_id", "r.row_no", F.explode_outer("r.cells").alias("c"))
    return cells.where("c is not null").select("chunk_id", "row_no", "c.*")


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def table_terms(c: Column) -> Column:
    """Distinct words of over two characters, without stop words."""
    words = F.transform(F.split(F.lower(c), r"[^a-z0-9₹$%.'-]+"), lambda w: F.regexp_replace(w, r"^['.-]+|['.-]+$", ""))
    stop = F.array(*[F.lit(w) for w in T.TABLE_STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def rank_rows(questions: DataFrame, chunks: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """Rows of the evidence's tables per question by score, the best `most`: (query_id, place, chunk_id, file_name, row_no,
    row_score, headers, cells). evidence: (query_id, chunk_id, score); chunks: (chunk_id, file_name, content). A row scores
    one for each question term in file name, chunk text or cells, and one for each cell whose label or value holds a term.
    Of a question of which no row scores, the first rows come, with 0.

    A chunk is parsed, cut into terms and normalized once, whoever asks for it; its terms meet a question's once, for all
    its rows. Of the cells' own terms only those of labels that were made up can be missing in the chunk's text.
    """
    terms = table_terms(F.concat_ws(" ", "file_name", "content")).alias("chunk_terms")
    tables = parsed_tables(chunks.select("chunk_id", "file_name", "content")).select("chunk_id", "file_name", "headers", "rows", terms)
    plain = lambda c: F.struct(normalized(c.label).alias("label"), normalized(c.value).alias("value"))
    tables = tables.withColumn("plain", F.transform("rows", lambda r: F.transform(r.cells, plain)))
    asked = questions.select("query_id", table_terms(F.col("query")).alias("terms"))
    got = evidence.select("query_id", "chunk_id", "score").join(tables, "chunk_id").join(asked, "query_id")
    got = got.withColumn("shared", F.size(F.array_intersect("terms", "chunk_terms"))).withColumn("others", F.array_except("terms", "chunk_terms"))
    got = got.select("query_id", "chunk_id", "file_name", "score", "headers", "terms", "shared", "others", F.explode_outer(F.arrays_zip("rows", "plain")).alias("r")).where("r is not null")
    made_up = F.flatten(F.transform(F.filter("r.rows.cells", lambda c: c.col >= F.size("headers")), lambda c: F.array(F.lit("col"), (c.col + 1).cast("string"))))
    per_cell = F.size(F.filter("r.plain", lambda c: F.exists("terms", lambda t: F.contains(c.value, t) | F.contains(c.label, t))))
    got = got.select("query_id", "chunk_id", "file_name", "score", "headers", "r.rows.row_no", "r.rows.cells", (F.col("shared") + F.size(F.array_intersect("others", made_up)) + per_cell).alias("row_score"))
    per = Window.partitionBy("query_id")
    best = got.withColumn("place", F.row_number().over(per.orderBy(F.desc("row_score"), F.desc("score"), "chunk_id", "row_no"))).where(F.col("place") <= most)
    kept = best.withColumn("top", F.max("row_score").over(per)).where("row_score > 0 or top = 0")
    return kept.select("query_id", "place", "chunk_id", "file_name", "row_no", "row_score", "headers", "cells")


def extremes(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """The highest or lowest numeric cell over a question's rows, for questions that ask for one."""
    low = F.contains(F.lower("query"), F.lit("lowest"))
    asked = questions.where(F.lower("query").rlike("highest|largest|lowest")).select("query_id", low.alias("low"))
    cells = rows.where("row_score > 0").select("query_id", "place", "file_name", F.element_at("cells", 1).value.alias("row_name"), F.explode("cells").alias("c"))
    numbers = cells.select("*", T.parse_number(F.col("c.value")).alias("number")).where("number is not null").join(asked, "query_id")
    key = F.struct(F.when(F.col("low"), F.col("number")).otherwise(-F.col("number")).alias("n"), "place", F.col("c.col").alias("col"))
    best = numbers.groupBy("query_id").agg(F.min_by(F.struct("row_name", F.col("c.label").alias("label"), F.col("c.value").alias("value"), "file_name"), key).alias("b"))
    return best.select("query_id", F.concat(F.col("b.row_name"), F.lit(" — "), F.col("b.label"), F.lit(": "), F.col("b.value"), F.lit(" (Source: "), F.col("b.file_name"), F.lit(")")).alias("answer"))


def facts(rows: DataFrame, most: int = 10) -> DataFrame:
    """Fact lines per question, one for each row."""
    line = F.concat(F.lit("- "), F.col("file_name"), F.lit(": "), F.element_at("cells", 1).value, F.lit(" | "), F.array_join(F.transform(F.slice("cells", 1, most), lambda c: F.concat_ws(": ", c.label, c.value)), " | "))
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return got.select("query_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("facts"))
