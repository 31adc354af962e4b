"""Text and layout lines to chunks: splits, junk and copies, lists, headings, rows and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators.tables import to_markdown

#: Fixed value: what starts a list item.
LIST_START = r"^\s*([-*•◦▪]|\d+[.)])\s+"


def drop_junk(chunks: DataFrame) -> DataFrame:
    return chunks.where(~T.is_junk(F.col("content")))


def dedupe(chunks: DataFrame) -> DataFrame:
    """Within a document the first chunk of each digit-masked signature, grouped chunks exempt, and of the rest the first
    of each boilerplate key, grouped or not."""
    sign = chunks.withColumn("_s", T.masked_signature(F.col("content")))
    first = lambda key: F.row_number().over(Window.partitionBy("doc_id", key).orderBy("chunk_index"))
    once = sign.withColumn("_n", first("_s")).where(F.col("group_id").isNotNull() | (F.col("_n") == 1)).withColumn("_k", T.furniture_key(F.col("_s")))
    return once.withColumn("_n", first("_k")).where(F.col("_k").isNull() | (F.col("_n") == 1)).drop("_s", "_n", "_k")


def list_runs(lines: DataFrame) -> DataFrame:
    """Consecutive list lines of a document as one block: (doc_id, first_line, items, text)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("_is", F.col("line").rlike(LIST_START))
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_is") & ~F.coalesce(F.lag("_is").over(w), F.lit(False)), 1).otherwise(0)).over(w)).where("_is")
    got = runs.groupBy("doc_id", "_run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return got.select("doc_id", "first_line", "items", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))


def heading_level(size: Column, bold: Column, text: Column, base: Column) -> Column:
    """1 over base + 6, 2 over base + 3, 3 if bold or over base + 1 and under 120 characters, else 0."""
    return F.when(size > base + 6, 1).when(size > base + 3, 2).when((bold | (size > base + 1)) & (F.length(text) < 120), 3).otherwise(0)


def strict_heading_level(size: Column, bold: Column, text: Column, base: Column) -> Column:
    """As heading_level, but 0 for lines of figures: two or more numbers among their words, or two to six words that all
    hold a digit."""
    words = F.filter(F.split(T.trimmed(text), r"\s+"), lambda w: w != "")
    numbers = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"[,.%()₹$\-]", "").rlike(r"^\d+$")))
    digits = F.size(words).between(2, 6) & F.forall(words, lambda w: w.rlike(r"\d"))
    return F.when((numbers >= 2) | digits, 0).otherwise(heading_level(size, bold, text, base))


def line_geometry(lines: DataFrame) -> DataFrame:
    """lines (…, text, box array<struct<x, y>>): corners, size (1 at least) and centre; no row for a blank text or empty box."""
    got = lines.where((T.trimmed(F.col("text")) != "") & (F.size("box") > 0))
    for end, agg in (("", F.array_min), ("end_", F.array_max)):
        for axis in ("x", "y"):
            got = got.withColumn(f"{end}{axis}", agg(F.col(f"box.{axis}")))
    return got.withColumn("width", F.greatest(F.lit(1.0), F.col("end_x") - F.col("x"))).withColumn("height", F.greatest(F.lit(1.0), F.col("end_y") - F.col("y"))).withColumn("center_x", (F.col("x") + F.col("end_x")) / 2).drop("box")


def drop_page_furniture(lines: DataFrame, pages: int = 3, top: float = 0.12, bottom: float = 0.86) -> DataFrame:
    """Without fixed boilerplate (text.is_furniture), and without lines in the top or bottom margin whose digit-masked text
    occurs on `pages` pages or more of its document, boilerplate counted too. Pages are counted by a grouping with
    partial sums and joined back, so no line's copies are gathered."""
    masked = T.trimmed(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    s = lines.withColumn("_s", masked)
    margin = (F.col("y") < top * F.col("page_height")) | (F.col("y") > bottom * F.col("page_height"))
    often = s.select("doc_id", "_s", "page").distinct().groupBy("doc_id", "_s").agg(F.count("page").alias("_pages")).where(F.col("_pages") >= pages)
    kept = s.where(~T.is_furniture(F.col("text"))).join(often, ["doc_id", "_s"], "left")
    return kept.where(~(margin & F.col("_pages").isNotNull())).select(*lines.columns)


def page_boxes(lines: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box per chunk and page, truncated to one decimal."""
    cut = lambda c: F.floor(c * 10) / 10
    got = lines.groupBy(*by, "page").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("end_x").alias("ex"), F.max("end_y").alias("ey"))
    return got.select(*by, "page", cut(F.col("x")).alias("x"), cut(F.col("y")).alias("y"), cut(F.col("ex") - F.col("x")).alias("width"), cut(F.col("ey") - F.col("y")).alias("height"))


def ingest_summary(chunks: DataFrame) -> DataFrame:
    tokens = T.token_estimate(F.col("content"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "SECTION").alias("sections"), F.count_if(F.col("chunk_type") == "TEXT").alias("texts"), F.round(F.avg(tokens), 4).alias("mean_tokens"))


def markup_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, kind, level, path, text) of a page's blocks in order: headings h1 to h4 (level 1 to 4), paragraphs,
    runs of li as one list of `- ` lines, and tables as Markdown, cells row by row. path holds the headings above a block,
    each under the nearest one of a lower level. An element ends at its own closing tag, so li and p may be nested in
    others; blank ones are left out."""
    element = r"(?is)<(table)(?:\s[^>]*)?>.*?</table>|<(h[1-4])(?:\s[^>]*)?>.*?</\2>|<li(?:\s[^>]*)?>.*?(?=</?li[\s>]|</[uo]l>|\z)|<p(?:\s[^>]*)?>.*?(?=</p>|<p[\s>]|</?(?:li|[uo]l|h[1-4]|table|div)[\s>]|\z)"
    bare = lambda c: T.trimmed(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(element), F.lit(0))).alias("at", "b"))
    found = found.withColumn("kind", F.lower(F.regexp_extract("b", r"(?i)^<(table|h[1-4]|p|li)", 1)))
    rows = F.transform(F.regexp_extract_all("b", F.lit(r"(?is)<tr(?:\s[^>]*)?>.*?</tr>"), F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd](?:\s[^>]*)?>.*?</t[hd]>"), F.lit(0)), bare))
    table = F.when(F.size(rows) > 0, to_markdown(F.element_at(rows, 1), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))))
    found = found.withColumn("text", F.when(F.col("kind") == "table", table).when(F.col("kind") == "li", F.concat(F.lit("- "), bare(F.col("b")))).otherwise(bare(F.col("b"))))
    found = found.where(F.col("text").isNotNull() & ~F.col("text").isin("", "- "))
    w = Window.partitionBy("page_id").orderBy("at")
    starts = F.when((F.col("kind") == "li") & F.coalesce(F.lag("kind").over(w) == "li", F.lit(False)), 0).otherwise(1)
    found = found.withColumn("_start", starts).withColumn("block_no", (F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    got = found.groupBy("page_id", "block_no").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text), "\n").alias("text"))
    level = F.when(F.col("kind").rlike("^h[1-4]$"), F.substring("kind", 2, 1).cast("int")).otherwise(0)
    got = got.withColumn("level", level).withColumn("kind", F.when(F.col("kind") == "li", "list").otherwise(F.col("kind")))
    blocks = Window.partitionBy("page_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    # the last heading of each level so far, as long as none of a lower level came after it
    above = [F.max(F.when(F.col("level") == n, F.struct("block_no", F.col("text").alias("title")))).over(blocks).alias(f"_h{n}") for n in range(1, 5)]
    got = got.select("*", *above)
    kept = []
    for n in range(1, 5):
        own = F.col(f"_h{n}")
        later = [F.coalesce(F.col(f"_h{m}.block_no") > own.block_no, F.lit(False)) for m in range(1, n)]
        open_ = own.isNotNull() & ((F.col("level") == 0) | (F.col("level") > n))
        for x in later:
            open_ = open_ & ~x
        kept.append(F.when(open_, own.title))
    return got.select("page_id", "block_no", "kind", "level", F.array_compact(F.array(*kept)).alias("path"), "text")
