"""Queries over layout lines and cells, chunks and parts of tables and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import chunking as C
from corvida.operators import ingest as I
from corvida.operators import layout as L
from corvida.plans.ingest_plans import _IS_FURNITURE, LAYOUT, layout, tagged_pages
from corvida.plans.shape_plans import MARKDOWN, part_chunks, part_tables
from corvida.sources import fixtures as X
from corvida.sources.fixtures import with_

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


def _any(words: list[str], text: str) -> str:
    return f"(len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({text}, w))) > 0)"


# every line with one of the literals that are repaired in front of it
BROKEN = [a for a, _ in L.REPAIRS]
REPAIRED = reduce(lambda x, r: f"replace({x}, '{r[0]}', '{r[1]}')", L.REPAIRS, "text")


@query("normalize_ocr_text", with_("lines") + f", b as (select doc_id, line_no, [{', '.join(repr(x) for x in BROKEN)}][line_no % {len(BROKEN)} + 1] || line as text from lines) select doc_id, line_no, trim(regexp_replace(regexp_replace({REPAIRED}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) as text from b")
def _(s, d):
    broken = F.element_at(F.array(*[F.lit(x) for x in BROKEN]), (F.col("line_no") % len(BROKEN) + 1).cast("int"))
    return X.lines(s, d).select("doc_id", "line_no", L.repair_text(F.concat(broken, "line")).alias("text"))


@query("line_geometry", with_("lines") + f", {LAYOUT} select doc_id, page, x, y, end_x, end_y, greatest(1, end_x - x) as width, greatest(1, end_y - y) as height, (x + end_x) / 2 as center_x from layout where regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def _(s, d):
    box = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("end_x", "y"), ("x", "y"), ("x", "end_y"), ("end_x", "end_y"))])
    return I.line_geometry(layout(s, d).select("doc_id", "page", "text", box.alias("box"))).drop("text")


@query("base_font_size", with_("lines") + f", {LAYOUT}, f as (select doc_id, font_size, row_number() over (partition by doc_id order by page, y, x) as n from layout) select doc_id, case when count(*) >= 50 then cast(list_sort(list(font_size))[26] as double) else 12 end as base from f where n <= 50 group by doc_id")
def _(s, d):
    return L.base_font_size(layout(s, d))


# headings by text: lines with numbers, capitals and cut lengths, of varied height and place
TEXTS = """t as (select doc_id, line_no, case line_no % 6 when 0 then (line_no % 4 + 1) || '.' || (line_no % 3) || ' ' || left(line, 40) when 1 then upper(regexp_replace(left(line, 30), '[^a-zA-Z ]', '', 'g')) when 2 then left(line, 60) when 3 then 'Annual Performance ' || line_no when 4 then case line_no % 18 when 4 then 'MAKER CHAMBERS IV NARIMAN POINT' when 10 then 'Registered Office Network Expansion' else '12 March, 2024' end else line end as text,
  10.0 + line_no % 5 as height, 200.0 + (line_no % 7) * 60 as center_x from lines)"""


def texts(s, d):
    n = F.col("line_no")
    cleaned = F.upper(F.regexp_replace(F.substring("line", 1, 30), "[^a-zA-Z ]", ""))
    numbered = F.concat((n % 4 + 1).cast("string"), F.lit("."), (n % 3).cast("string"), F.lit(" "), F.substring("line", 1, 40))
    text = F.when(n % 6 == 0, numbered).when(n % 6 == 1, cleaned).when(n % 6 == 2, F.substring("line", 1, 60)).when(n % 6 == 3, F.concat(F.lit("Annual Performance "), n.cast("string"))).when(n % 18 == 4, "MAKER CHAMBERS IV NARIMAN POINT").when(n % 18 == 10, "Registered Office Network Expansion").when(n % 6 == 4, "12 March, 2024").otherwise(F.col("line"))
    return X.lines(s, d).select("doc_id", "line_no", text.alias("text"), (10.0 + n % 5).alias("height"), (200.0 + (n % 7) * 60).alias("center_x"))


LEVEL = f"""case when length(u) < 4 or {_IS_FURNITURE} or lower(u) in ({', '.join(repr(x) for x in L.HEADER_FRAGMENTS)}) or ({_any(L.ANNOUNCEMENTS, 'lower(u)')} and not contains(lower(u), 'financial highlights'))
  or regexp_matches(u, '^\\p{{Ll}}') or (ends_with(u, '.') and letters > 6) or regexp_matches(u, '{L.DATE_LINE}') then 0 when regexp_matches(u, '{L.PERFORMANCE_LINE}') then 2 when regexp_matches(u, '\\d') and letters < 3 then 0
  when regexp_matches(u, '{L.NUMBERED}') then least(4, len(string_split(regexp_extract(u, '{L.NUMBERED}', 1), '.'))) when length(u) <= 100 and tall and centered then 1 when length(u) <= 120 and tall then 2
  when length(u) between 8 and 120 and capitals > 0.78 then 2 when length(u) <= 90 and centered and capitals > 0.45 then 3 else 0 end"""
LEVELS = f"""{TEXTS}, c as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as u from t), e as (select *, len(regexp_extract_all(u, '\\p{{L}}')) as letters, abs(center_x - 300) < 108 as centered, height >= 11 * 1.18 as tall from c),
g as (select *, case when letters > 0 then len(regexp_extract_all(u, '\\p{{Lu}}')) / letters else 0 end as capitals from e), levels as (select doc_id, line_no, text, {LEVEL} as level from g)"""


def levels(s, d):
    t = texts(s, d)
    level = L.heading_level_text(F.col("text"), F.col("height"), F.col("center_x"), F.lit(600.0), F.lit(11.0))
    return t.select("doc_id", "line_no", "text", F.coalesce(level, F.lit(0)).cast("long").alias("level"))


@query("heading_level_text", with_("lines") + f", {LEVELS} select doc_id, line_no, level from levels")
def _(s, d):
    return levels(s, d).drop("text")


@query("section_paths", with_("lines") + f""", {LEVELS}, o as (select *, {', '.join(f"max(case when level = {n} then line_no end) over w as l{n}" for n in range(1, 5))} from levels window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
k as (select doc_id, line_no, list_filter([l1, case when l2 > coalesce(l1, -1) then l2 end, case when l3 > greatest(coalesce(l1, -1), coalesce(l2, -1)) then l3 end, case when l4 > greatest(coalesce(l1, -1), coalesce(l2, -1), coalesce(l3, -1)) then l4 end], lambda x: x is not null) as open from o)
select doc_id, line_no, array_to_string(open, '/') as path, open[-1] as section_line, open[-2] as parent_line from k""")
def _(s, d):
    marked = levels(s, d).withColumn("text", F.col("line_no").cast("string"))
    return L.section_paths(marked).select("doc_id", "line_no", F.array_join("path", "/").alias("path"), "section_line", "parent_line")


# paragraphs: every ninth line lies lower, every thirteenth further right
SPACED = "spaced as (select doc_id, line_no, line_no // 40 as page, 600.0::double as page_width, 80.0::double + case when line_no % 13 = 5 then 300 else 0 end as x, cast(18 * (line_no % 40) + 30 * (line_no % 40 // 9) as double) as y from lines)"


def spaced(s, d):
    n = F.col("line_no")
    return X.lines(s, d).select("doc_id", "line_no", F.floor(n / 40).cast("long").alias("page"), F.lit(600.0).alias("page_width"), (F.lit(80.0) + F.when(n % 13 == 5, 300).otherwise(0)).alias("x"), (18 * (n % 40) + 30 * F.floor(n % 40 / 9)).cast("double").alias("y"))


@query("paragraph_groups", with_("lines") + f""", {SPACED}, p as (select *, lag(page) over w as p, lag(y) over w as py, lag(x) over w as px, lag(page_width) over w as pw from spaced window w as (partition by doc_id order by page, y, x)),
m as (select doc_id, coalesce(list_sort(list(y - py) filter (where p = page and y > py))[1 + (count(*) filter (where p = page and y > py)) // 2], 24) as m from p group by doc_id)
select doc_id, line_no, cast(sum(case when p <> page or y - py > m * 1.65 or abs(x - px) > pw * 0.35 then 1 else 0 end) over (partition by doc_id order by page, y, x rows between unbounded preceding and current row) as bigint) as paragraph_no from p join m using (doc_id)""")
def _(s, d):
    return L.paragraph_groups(spaced(s, d)).select("doc_id", "line_no", "paragraph_no")


@query("split_columns_in_line", with_("lines") + """, w as (select doc_id, line_no, i as word_no, string_split(line, ' ')[i + 1] as text, 60.0::double * i as x, 60.0::double * i + 6 * length(string_split(line, ' ')[i + 1]) as end_x from (select *, unnest(range(len(string_split(line, ' ')))) as i from lines)),
n as (select *, case when x - lag(end_x) over (partition by doc_id, line_no order by word_no) > 8 then 1 else 0 end as n from w), g as (select *, sum(n) over (partition by doc_id, line_no order by word_no rows between unbounded preceding and current row) as segment from n),
a as (select doc_id, line_no, segment, min(x) as x, max(end_x) as end_x, count(*) as words, string_agg(text, ' ' order by word_no) as text from g group by all)
select doc_id, line_no, cast(segment as bigint) as segment, x, end_x, text from a qualify sum(words) over (partition by doc_id, line_no) >= 3 and count(*) over (partition by doc_id, line_no) >= 2""")
def _(s, d):
    w = X.lines(s, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text")).withColumn("x", 60.0 * F.col("word_no"))
    return L.column_segments(w.withColumn("end_x", F.col("x") + 6 * F.length("text")))


# cells: four words of a line at varied places; in most lines the later ones are amounts; some lines have one cell or a footer
CELLS = """w as (select doc_id, line_no, string_split(line, ' ') as w from lines),
cells as (select doc_id, line_no // 40 as page, line_no as row_no, 18.0::double * (line_no % 40) as y, 80.0::double + 120 * i + (length(w[i + 1]) % 3) * 5 as x, 80.0::double + 120 * i + (length(w[i + 1]) % 3) * 5 + 6 * length(w[i + 1]) as end_x,
  case when line_no % 70 = 2 and i = 0 then 'Telefax 1' when line_no % 7 < 3 and i > 0 then i || ',' || lpad(cast(length(w[i + 1]) as varchar), 3, '0') else w[i + 1] end as text from (select *, unnest(range(case when line_no % 7 < 4 then least(4, len(w)) else 1 end)) as i from w))"""


def cells(s, d):
    n = F.col("line_no")
    w = X.lines(s, d).select("doc_id", "line_no", F.posexplode(F.slice(F.split("line", " "), F.lit(1), F.when(n % 7 < 4, 4).otherwise(1))).alias("i", "w"))
    size, i = F.length("w"), F.col("i")
    x = F.lit(80.0) + 120 * i + (size % 3) * 5
    text = F.when((n % 70 == 2) & (i == 0), "Telefax 1").when((n % 7 < 3) & (i > 0), F.concat(i.cast("string"), F.lit(","), F.lpad(size.cast("string"), 3, "0"))).otherwise(F.col("w"))
    return w.select("doc_id", F.floor(n / 40).cast("long").alias("page"), n.alias("row_no"), (18.0 * (n % 40)).alias("y"), x.alias("x"), (x + 6 * size).alias("end_x"), text.alias("text"))


AMOUNT_OF = "regexp_replace(regexp_replace({0}, '^[$₹€£¥+]+', ''), '^\\(+|\\)+$', '', 'g')"
AMOUNT = f"(regexp_matches({AMOUNT_OF.format('text')}, '{L.COMMA_NUMBER}') or regexp_matches({AMOUNT_OF.format('text')}, '{L.DECIMAL_NUMBER}') or (regexp_matches({AMOUNT_OF.format('text')}, '{L.FIGURES}') and (contains(text, '%') or regexp_matches(text, '{L.CURRENCY_START}'))))"


def _islands(source: str, flag: str, name: str) -> str:
    return f"""{name}_f as (select *, case when {flag} and not coalesce(lag({flag}) over (partition by doc_id, page order by row_no), false) then 1 else 0 end as st from {source}),
{name}_r as (select *, sum(st) over (partition by doc_id, page order by row_no rows between unbounded preceding and current row) as run from {name}_f),
{name} as (select doc_id, page, row_no, min(row_no) over (partition by doc_id, page, run) as table_row from {name}_r where {flag} qualify count(*) over (partition by doc_id, page, run) >= 2)"""


ROWS = f"""{CELLS}, gaps as (select *, x - lag(end_x) over (partition by doc_id, page, row_no order by x) as gap from cells),
rows_ as (select doc_id, page, row_no, min(y) as y, coalesce(max(gap) > 15, false) as is_row, coalesce(max(gap) >= 12, false) as several, bool_or({AMOUNT}) as amount, bool_or(regexp_matches(text, '{L.FOOTER}')) as footer from gaps group by all),
{_islands('rows_', 'is_row', 'found')}"""
FILTERED = f"""{ROWS}, nf as (select f.*, r.amount from found f join rows_ r using (doc_id, page, row_no) where not footer), lt as (select *, max(case when amount then row_no end) over (partition by doc_id, page, table_row) as last from nf),
filtered as (select doc_id, page, table_row, row_no from lt where row_no <= last qualify count(*) over (partition by doc_id, page, table_row) >= 2)"""


@query("cluster_rows")
def _(s, d):
    jitter = cells(s, d).withColumn("y", F.col("y") + F.length("text") % 3)
    return L.cluster_rows(jitter.drop("row_no")).select("doc_id", "page", "row_no", "x", "text")


@query("cluster_columns")
def _(s, d):
    return cells(s, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x")).alias("x")).select("doc_id", "page", F.size(L.mean_anchors(F.col("x"))).alias("columns"), F.size(L.anchors(F.col("x"), 20.0)).alias("anchors"))


@query("detect_tables", with_("lines") + f", {ROWS} select doc_id, page, table_row, row_no from found")
def _(s, d):
    return L.detect_tables(cells(s, d)).drop("cells")


@query("filter_table_rows", with_("lines") + f", {FILTERED} select doc_id, page, table_row, row_no from filtered")
def _(s, d):
    return L.filter_table_rows(L.detect_tables(cells(s, d))).drop("cells")


@query("assign_cells", with_("lines") + f", {FILTERED} select doc_id, page, table_row, row_no, cast(floor((x - 80) / 120) as bigint) as col, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from cells join filtered using (doc_id, page, row_no)")
def _(s, d):
    # places differ by 10 at most within a column of the cells, so that its anchor is the nearest of all
    return L.assign_cells(L.filter_table_rows(L.detect_tables(cells(s, d))))


@query("bridge_table_rows", with_("lines") + f""", {ROWS}, b as (select *, several or coalesce(lag(several) over w and lead(several) over w and lead(y) over w - lag(y) over w < 40, false) as kept from rows_ window w as (partition by doc_id, page order by row_no)),
{_islands('b', 'kept', 'bridged')} select doc_id, page, table_row, row_no from bridged join rows_ using (doc_id, page, row_no) qualify bool_or(amount) over (partition by doc_id, page, table_row)""")
def _(s, d):
    return L.bridge_table_rows(cells(s, d)).drop("cells")


@query("merge_continuation_rows", with_("lines") + ", r as (select doc_id, line_no, case when line_no % 4 = 1 then cast(line_no as varchar) else '' end as serial, line from lines), c as (select *, count(*) filter (where serial <> '') over (partition by doc_id order by line_no rows between unbounded preceding and current row) as record_no from r) select doc_id, record_no, max(serial) as serial, coalesce(string_agg(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ' ' order by line_no) filter (where regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''), '') as label from c where record_no > 0 group by all")
def _(s, d):
    n = F.col("line_no")
    return L.merge_continuation_rows(X.lines(s, d).select("doc_id", n.alias("row_no"), F.when(n % 4 == 1, n.cast("string")).otherwise("").alias("serial"), F.col("line").alias("label")))


GRID = "m as (select doc_id, line_no, case line_no % 5 when 1 then 'Item ' || line_no || ' 1,200 30% (45)' when 2 then replace(left(line, 30), ' ', '    ') else line end as line from lines)"
CUT = "list_filter(regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '{}'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g') <> '')"


@query("text_grid_tables", with_("lines") + f""", {GRID}, s as (select *, len({CUT.format('\\s{3,}')}) as cells, len({CUT.format('\\s+')}) as words, len(list_filter({CUT.format('\\s+')}, lambda c: regexp_matches(c, '^[(]?[$₹]?\\d[\\d,.]*%?[)]?$'))) as numbers from m),
g as (select doc_id, 0 as page, line_no as row_no, cells >= 2 or (words >= 4 and numbers >= 3 and numbers >= 0.4 * words) as is_grid from s), {_islands('g', 'is_grid', 'grids')} select doc_id, table_row as first_line, count(*) as lines from grids group by all""")
def _(s, d):
    n = F.col("line_no")
    line = F.when(n % 5 == 1, F.concat(F.lit("Item "), n.cast("string"), F.lit(" 1,200 30% (45)"))).when(n % 5 == 2, F.regexp_replace(F.substring("line", 1, 30), " ", "    ")).otherwise(F.col("line"))
    return L.text_grid_tables(X.lines(s, d).select("doc_id", "line_no", line.alias("line")))


@query("chunk_flat")
def _(s, d):
    return C.chunk_flat(X.table(s, d, "documents"))


@query("split_large_tables")
def _(s, d):
    p = part_tables(s, d).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.array("p_name", F.col("p_size").cast("string")).alias("r")))).alias("l"))
    return C.split_large_tables(p.select("table_id", F.array(F.lit("Name"), F.lit("Size")).alias("headers"), F.transform("l", lambda x: x.r).alias("rows")), 120)


@query("split_large_lists")
def _(s, d):
    return C.split_large_lists(X.table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("list_id"), F.split("text", "\n").alias("items")), 300)


@query("merge_adjacent_chunks")
def _(s, d):
    c = X.chunks(s, d).withColumn("group_id", F.when(F.col("chunk_index") % 6 == 4, F.col("group_id")))
    return C.merge_adjacent(c, 300)


@query("chunk_sections")
def _(s, d):
    return C.chunk_sections(L.section_paths(levels(s, d)), 200).withColumn("path", F.array_join("path", "/"))


# blocks of tagged pages, a table at each page's end: lists and tables stand among paragraphs, under up to four headings
@query("chunk_section_blocks")
def _(s, d):
    b = I.markup_blocks(tagged_pages(s, d)).withColumnRenamed("page_id", "doc_id").withColumnRenamed("block_no", "line_no")
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\| ---"))
    cells = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^\| | \|$", ""), r" \| "))
    kinds = b.select("doc_id", "line_no", F.when(F.col("kind").isin("list", "table"), F.col("kind")).otherwise("text").alias("kind"), F.split("text", "\n").alias("items"), F.element_at(cells, 1).alias("headers"), F.slice(cells, F.lit(2), F.size(cells)).alias("rows"))
    paths = L.section_paths(b.select("doc_id", "line_no", "text", "level"))
    return C.chunk_blocks(paths.join(kinds, ["doc_id", "line_no"]), 60).withColumn("path", F.array_join("path", "/"))


@query("merge_headers")
def _(s, d):
    rows = L.assign_cells(L.filter_table_rows(L.detect_tables(cells(s, d)))).groupBy(*L.TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("l"))
    matrix = rows.groupBy(*L.TABLE).agg(F.array_sort(F.collect_list(F.struct("row_no", F.transform("l", lambda x: x.text).alias("r")))).alias("m"))
    got = matrix.select(*L.TABLE, C.merge_headers(F.transform("m", lambda x: x.r)).alias("h"))
    return got.select(*L.TABLE, F.array_join("h.headers", " | ").alias("headers"), F.size("h.rows").alias("rows"))


QUERIES, ORACLES = Q, O
