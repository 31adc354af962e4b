"""Layout lines and cells: text repair, headings, sections, paragraphs, columns, rows and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import text as T

# Literal repairs of recognised text, in the order of their use.
REPAIRS = [
    ("CONSOLIDATEDRESULTSFORQUARTER/YEARENDED31STMARCH,2026", "CONSOLIDATED RESULTS FOR QUARTER / YEAR ENDED 31ST MARCH, 2026"),
    ("CONSOLIDATEDFINANCIALHIGHLIGHTS", "CONSOLIDATED FINANCIAL HIGHLIGHTS"), ("RecordAnnual", "Record Annual "), ("ConsolidatedPATat", "Consolidated PAT at "),
    ("JioPlatforms", "Jio Platforms "), ("4QFY26EBITDA", "4Q FY26 EBITDA"), ("Y-o-Yat", "Y-o-Y at "), ("Jiototal", "Jio total "), ("RelianceRetail", "Reliance Retail "),
    ("ProfitAfterTaxandShareofProfit/(Loss)ofAssociates&JVs", "Profit After Tax and Share of Profit/(Loss) of Associates & JVs"), ("ProfitAfterTaxand", "Profit After Tax and"),
    ("NetDebt", "Net Debt"), ("FY26EBITDA", "FY26 EBITDA"), ("Associates &JVs", "Associates & JVs"), ("Associates&JVs", "Associates & JVs"),
    ("oOilandGassegment", "o Oil and Gas segment"), ("oRRVL", "o RRVL"), ("oO2CEBITDA", "o O2C EBITDA"), ("EBITDAup", "EBITDA up"),
    ("subscriberbaseofover", "subscriber base of over"), ("steadyramp-upof", "steady ramp-up of"), ("digitalservices", "digital services"), ("revenuedecreased", "revenue decreased"),
    ("by5.4", "by 5.4"), ("Y-o-Yon", "Y-o-Y on"), ("KGD6gasvolume", "KGD6 gas volume"), ("byhigher", "by higher"), ("inmargin", "in margin"),
    ("depreciationinDigitalServices", "depreciation in Digital Services"), ("operationalisationof5Gspectrumassets", "operationalisation of 5G spectrum assets"),
    ("increasedby", "increased by"), ("by10.1", "by 10.1"), ("by17.8", "by 17.8"), ("to190bps", "to 190bps"), ("transportationfuel", "transportation fuel"),
    ("Earningsgrowth", "Earnings growth"), ("ShareofProfit", "Share of Profit"), ("Y-o-Yto", "Y-o-Y to"), ("crore,up", "crore, up"), ("crore,margin", "crore, margin"),
    ("countcrosses", "count crosses"),
]
# What is no heading, footers, and the forms of amounts.
HEADER_FRAGMENTS = ["sr.", "sr", "no", "particulars", "4q", "3q", "fy26", "fy25", "% chg.", "% chg", "y-o-y", "y-0-y"]
ANNOUNCEMENTS = ["revenue", "ebitda", "pat", "subscriber", "retail", "dividend", "store count"]
DATE_LINE = r"(?i)^\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+,?\s+\d{4}$"
PERFORMANCE_LINE = r"(?i)^(Annual|Quarterly)\s+Performance"
NUMBERED = r"^(\d+(?:\.\d+){0,3})[\s.)-]+.+"
FOOTER = (
    r"(?i)(Registered\s+(Office|Offic)|Corporate\s+Communications|Telefax|Membership\s+No|UDIN:|ICAI\s+Reg|Chartered\s+Accountants|BSE\s+Limited|"
    r"National\s+Stock\s+Exchange|For\s+[A-Z].+\s+LLP\b|CIN\s+[A-Z]\d)"
)
COMMA_NUMBER = r"^\d{1,3}(,\d{3})+(\.\d+)?$"
DECIMAL_NUMBER = r"^\(?\d+\.\d{1,4}%?\)?$"
CURRENCY_START = r"^[$₹€£¥]"
FIGURES = r"^[\d,.()%\-]+$"
BASE_RUNS, BASE_DEFAULT = 50, 12.0


def repair_text(c: Column) -> Column:
    """Literal repairs, a blank between a small and a capital letter, white space squeezed."""
    fixed = reduce(lambda x, rule: F.replace(x, F.lit(rule[0]), F.lit(rule[1])), REPAIRS, c)
    return F.trim(F.regexp_replace(F.regexp_replace(fixed, "([a-z])([A-Z])", "$1 $2"), r"\s+", " "))


def base_font_size(lines: DataFrame) -> DataFrame:
    """(doc_id, base): the middle of the first 50 font sizes in reading order; 12 for documents with fewer lines."""
    w = Window.partitionBy("doc_id").orderBy("page", "y", "x")
    first = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= BASE_RUNS)
    sizes = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("font_size").cast("double"))).alias("s"))
    return sizes.select("doc_id", F.when(F.size("s") >= BASE_RUNS, F.get("s", F.lit(BASE_RUNS // 2))).otherwise(BASE_DEFAULT).alias("base"))


def heading_level_text(text: Column, height: Column, center_x: Column, page_width: Column, median_height: Column) -> Column:
    """1 to 4 for a heading by its numbers, capitals, place and height; null for any other line."""
    return T.once(T.trimmed(text), lambda t: T.once(F.regexp_count(t, F.lit(r"\p{L}")), lambda letters: _level(t, letters, height, center_x, page_width, median_height)))


def _level(t: Column, letters: Column, height: Column, center_x: Column, page_width: Column, median_height: Column) -> Column:
    low = F.lower(t)
    capitals = F.when(letters > 0, F.regexp_count(t, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)
    announces = T.has_any(t, ANNOUNCEMENTS) & ~F.contains(low, F.lit("financial highlights"))
    none = (F.length(t) < 4) | T.is_furniture(t) | low.isin(HEADER_FRAGMENTS) | announces | t.rlike(r"^\p{Ll}") | (F.endswith(t, F.lit(".")) & (letters > 6)) | t.rlike(DATE_LINE)
    depth = F.regexp_count(F.regexp_extract(t, NUMBERED, 1), F.lit(r"\.")) + 1
    centered, tall = F.abs(center_x - page_width / 2) < page_width * 0.18, height >= median_height * 1.18
    by_form = (
        F.when((F.length(t) <= 100) & tall & centered, 1).when((F.length(t) <= 120) & tall, 2).when(F.length(t).between(8, 120) & (capitals > 0.78), 2)
        .when((F.length(t) <= 90) & centered & (capitals > 0.45), 3)
    )
    return F.when(none, F.lit(None).cast("int")).when(t.rlike(PERFORMANCE_LINE), 2).when(t.rlike(r"\d") & (letters < 3), F.lit(None).cast("int")).when(t.rlike(NUMBERED), F.least(F.lit(4), depth)).otherwise(by_form)


def section_paths(lines: DataFrame, levels: int = 4) -> DataFrame:
    """lines (doc_id, line_no, text, level 0 to `levels`) with path, section_line and parent_line: a heading closes the
    open sections of its level and deeper ones. Of each level the last heading is open if it is newer than those of all
    higher levels, so running maxima do without a stack."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    got = lines
    for n in range(1, levels + 1):
        got = got.withColumn(f"_h{n}", F.max(F.when(F.col("level") == n, F.struct("line_no", "text"))).over(w))
    opened = []
    for n in range(1, levels + 1):
        newer = [F.coalesce(F.col(f"_h{m}.line_no"), F.lit(-1)) for m in range(1, n)]
        newest = newer[0] if len(newer) == 1 else F.greatest(*newer) if newer else F.lit(-1)
        opened.append(F.when(F.col(f"_h{n}.line_no") > newest, F.col(f"_h{n}")))
    got = got.withColumn("_open", F.array_compact(F.array(*opened)))
    return got.select(*lines.columns, F.transform("_open", lambda s: s.text).alias("path"), F.try_element_at("_open", F.lit(-1)).line_no.alias("section_line"), F.try_element_at("_open", F.lit(-2)).line_no.alias("parent_line"))


def with_middle(df: DataFrame, value: str, by: tuple[str, ...], name: str) -> DataFrame:
    """df with `name`: the middle of the non-null values of its group in ascending order, the upper one of two."""
    group = Window.partitionBy(*by)
    at = F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) == F.floor(F.count(value).over(group) / 2) + 1
    return df.withColumn("_at", at).withColumn(name, F.max(F.when(F.col("_at"), F.col(value))).over(group)).drop("_at")


def paragraph_groups(lines: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lines (`by`, page, page_width, x, y) with paragraph_no: a new one at a new page, after a gap over 1.65 times the
    middle gap of the lines' group (24 if it has none), and where x jumps by over 35 % of the page."""
    w = Window.partitionBy(*by).orderBy("page", "y", "x")
    prev = lambda c: F.lag(c).over(w)
    got = lines.withColumns({"_p": prev("page"), "_y": prev("y"), "_x": prev("x"), "_w": prev("page_width")})
    gap = F.when((F.col("_p") == F.col("page")) & (F.col("y") > F.col("_y")), F.col("y") - F.col("_y"))
    got = with_middle(got.withColumn("_g", gap), "_g", by, "_m").withColumn("_m", F.coalesce("_m", F.lit(24.0)))
    new = (F.col("_p") != F.col("page")) | (F.col("y") - F.col("_y") > F.col("_m") * 1.65) | (F.abs(F.col("x") - F.col("_x")) > F.col("_w") * 0.35)
    return got.withColumn("paragraph_no", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*lines.columns, "paragraph_no")


def column_segments(words: DataFrame, gap: float = 8.0) -> DataFrame:
    """words (doc_id, line_no, word_no, x, end_x, text) to segments divided by gaps over `gap`; only for lines of three
    words or more that fall into two segments or more."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    new = F.when(F.col("x") - F.lag("end_x").over(w) > gap, 1).otherwise(0)
    got = words.withColumn("_n", new).withColumn("segment", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = got.groupBy("doc_id", "line_no", "segment").agg(F.min("x").alias("x"), F.max("end_x").alias("end_x"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("l"))
    per = Window.partitionBy("doc_id", "line_no")
    got = got.withColumn("_w", F.sum("n").over(per)).withColumn("_s", F.count("*").over(per)).where("_w >= 3 and _s >= 2")
    return got.select("doc_id", "line_no", F.col("segment").cast("long").alias("segment"), "x", "end_x", F.array_join(F.transform("l", lambda t: t.text), " ").alias("text"))


def anchors(ascending: Column, apart: float | Column) -> Column:
    """Values of an ascending array that lie over `apart` above the anchor before them; the first is one."""
    return F.aggregate(ascending, F.array().cast("array<double>"), lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > apart), F.concat(a, F.array(v))).otherwise(a))


def mean_anchors(ascending: Column, apart: float = 32.0) -> Column:
    """Means of groups of an ascending array; a value over `apart` above its group's running mean opens the next."""
    one = lambda v: F.array(F.struct(v.alias("sum"), F.lit(1).alias("n")))

    def step(a, v):
        last = F.element_at(a, -1)
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct((last.sum + v).alias("sum"), (last.n + 1).alias("n"))))
        return F.when(F.size(a) == 0, one(v)).when(v - last.sum / last.n > apart, F.concat(a, one(v))).otherwise(grown)

    return F.transform(F.aggregate(ascending, F.array().cast("array<struct<sum:double,n:int>>"), step), lambda g: g.sum / g.n)


def cluster_rows(lines: DataFrame, within: float = 3.0) -> DataFrame:
    """lines (doc_id, page, y, …) with row_no: lines within `within` of a row's first line share the row. A page's rows come
    from its distinct heights alone."""
    starts = lines.groupBy("doc_id", "page").agg(anchors(F.array_sort(F.collect_set(F.col("y").cast("double"))), within).alias("_a"))
    return lines.join(starts, ["doc_id", "page"]).withColumn("row_no", (F.size(F.filter("_a", lambda a: a <= F.col("y"))) - 1).cast("long")).drop("_a")


TABLE = ["doc_id", "page", "table_row"]


def _islands(rows: DataFrame, flag: str) -> DataFrame:
    """Rows with a true flag, with table_row, the first row of their run; only runs of two rows or more."""
    w = Window.partitionBy("doc_id", "page").orderBy("row_no")
    starts = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    runs = rows.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(flag)
    per = Window.partitionBy("doc_id", "page", "_run")
    return runs.withColumn("table_row", F.min("row_no").over(per)).withColumn("_c", F.count("*").over(per)).where("_c >= 2").drop("_s", "_run", "_c")


def _rows(cells: DataFrame) -> DataFrame:
    """One row per layout row with its cells from left to right."""
    got = cells.groupBy("doc_id", "page", "row_no").agg(F.array_sort(F.collect_list(F.struct("x", "end_x", "text", "y"))).alias("cells"))
    return got.withColumn("_gap", F.array_max(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("cells"))), lambda i: F.when(i <= F.size("cells"), F.get("cells", i - 1).x - F.get("cells", i - 2).end_x))))


def detect_tables(cells: DataFrame, gap: float = 15.0) -> DataFrame:
    """cells (doc_id, page, row_no, x, end_x, y, text) to rows (…, cells, table_row) of tables: two or more rows on end,
    each with a gap over `gap` between cells."""
    return _islands(_rows(cells).withColumn("_is", F.coalesce(F.col("_gap") > gap, F.lit(False))), "_is").select(*TABLE, "row_no", "cells")


def bridge_table_rows(cells: DataFrame, gap: float = 12.0, across: float = 40.0) -> DataFrame:
    """As detect_tables, where a row of one cell stays between two rows of several if these are less than `across` apart;
    a table needs an amount."""
    w = Window.partitionBy("doc_id", "page").orderBy("row_no")
    rows = _rows(cells).withColumn("_m", F.coalesce(F.col("_gap") >= gap, F.lit(False))).withColumn("_y", F.element_at("cells", 1).y)
    bridge = F.lag("_m").over(w) & F.lead("_m").over(w) & (F.lead("_y").over(w) - F.lag("_y").over(w) < across)
    tables = _islands(rows.withColumn("_is", F.col("_m") | F.coalesce(bridge, F.lit(False))), "_is")
    has = F.bool_or(F.exists("cells", lambda c: is_amount(c.text))).over(Window.partitionBy(*TABLE))
    return tables.withColumn("_has", has).where("_has").select(*TABLE, "row_no", "cells")


def is_amount(text: Column) -> Column:
    """A number with thousands, decimals, a percent sign or a currency."""
    t = F.regexp_replace(F.regexp_replace(text, r"^[$₹€£¥+]+", ""), r"^\(+|\)+$", "")
    return t.rlike(COMMA_NUMBER) | t.rlike(DECIMAL_NUMBER) | (t.rlike(FIGURES) & (F.contains(text, F.lit("%")) | text.rlike(CURRENCY_START)))


def filter_table_rows(rows: DataFrame) -> DataFrame:
    """Rows of tables without footers and without what follows the last row with an amount; tables of one row are dropped."""
    per = Window.partitionBy(*TABLE)
    got = rows.where(~F.exists("cells", lambda c: c.text.rlike(FOOTER)))
    got = got.withColumn("_last", F.max(F.when(F.exists("cells", lambda c: is_amount(c.text)), F.col("row_no"))).over(per)).where(F.col("row_no") <= F.col("_last"))
    return got.withColumn("_n", F.count("*").over(per)).where("_n >= 2").drop("_last", "_n")


def assign_cells(rows: DataFrame, apart: float = 20.0) -> DataFrame:
    """(doc_id, page, table_row, row_no, col, text): each cell in the column whose anchor is nearest, texts of one column
    joined. A table's columns come from its distinct left edges."""
    cells = rows.select(*TABLE, "row_no", F.explode("cells").alias("c"))
    columns = cells.groupBy(*TABLE).agg(anchors(F.array_sort(F.collect_set(F.col("c.x").cast("double"))), apart).alias("a"))
    nearest = F.array_min(F.transform("a", lambda x, i: F.struct(F.abs(x - F.col("c.x")).alias("d"), i.alias("i")))).i
    got = cells.join(columns, TABLE).withColumn("col", nearest.cast("long")).groupBy(*TABLE, "row_no", "col").agg(F.array_sort(F.collect_list(F.struct("c.x", "c.text"))).alias("l"))
    return got.select(*TABLE, "row_no", "col", F.array_join(F.transform("l", lambda t: T.trimmed(t.text)), " ").alias("text"))


def merge_continuation_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, row_no, serial, label) to records (doc_id, record_no, serial, label): a row with a serial number starts
    one, rows without extend its label; those before the first are dropped."""
    w = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("record_no", F.count(F.when(F.col("serial") != "", 1)).over(w)).where("record_no > 0")
    got = got.groupBy("doc_id", "record_no").agg(F.max("serial").alias("serial"), F.array_sort(F.collect_list(F.struct("row_no", "label"))).alias("l"))
    return got.select("doc_id", "record_no", "serial", F.array_join(F.filter(F.transform("l", lambda x: T.trimmed(x.label)), lambda x: x != ""), " ").alias("label"))


def text_grid_tables(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) to (doc_id, first_line, lines): two or more tabular lines on end. A line is one if
    three blanks part it in two cells or more, or if three or more and 40 % of its four or more words are numbers."""
    t = T.trimmed(F.col("line"))
    cells = F.filter(F.split(t, r"\s{3,}"), lambda c: T.trimmed(c) != "")
    words = F.filter(F.split(t, r"\s+"), lambda c: c != "")
    numbers = F.size(F.filter(words, lambda c: c.rlike(r"^[(]?[$₹]?\d[\d,.]*%?[)]?$")))
    is_grid = (F.size(cells) >= 2) | ((F.size(words) >= 4) & (numbers >= 3) & (numbers >= 0.4 * F.size(words)))
    rows = lines.select("doc_id", F.lit(0).alias("page"), F.col("line_no").alias("row_no"), F.coalesce(is_grid, F.lit(False)).alias("_is"))
    return _islands(rows, "_is").groupBy("doc_id", F.col("table_row").alias("first_line")).agg(F.count("*").alias("lines"))
