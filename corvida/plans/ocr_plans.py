"""Queries over recognised pages: list regions, list text, long paragraphs, keyed tables, whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.operators import layout as L
from corvida.operators import ocr as R
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


# lines as they would stand on pages of 40: items, what goes on with them, headings, prose with gaps; y grows by 18
ITEMS = "items as (select doc_id, line_no, line_no // 40 as page, 600.0::double as page_width, case line_no % 10 when 3 then 100.0::double else 40.0::double end as x, cast(18 * (line_no % 40) + 40 * (line_no % 40 // 6) as double) as y, 12.0::double as height, case line_no % 10 when 1 then '• ' || line when 2 then 'o Item ' || line when 5 then 'EBITDA ' || line when 6 then 'Prose ' || line else line end as text from lines)"


def items(s, d):
    n = F.col("line_no")
    text = F.when(n % 10 == 1, F.concat(F.lit("• "), "line")).when(n % 10 == 2, F.concat(F.lit("o Item "), "line")).when(n % 10 == 5, F.concat(F.lit("EBITDA "), "line")).when(n % 10 == 6, F.concat(F.lit("Prose "), "line")).otherwise(F.col("line"))
    return X.lines(s, d).select(
        "doc_id", "line_no", F.floor(n / 40).cast("long").alias("page"), F.lit(600.0).alias("page_width"), F.when(n % 10 == 3, 100.0).otherwise(40.0).alias("x"),
        (18 * (n % 40) + 40 * F.floor(n % 40 / 6)).cast("double").alias("y"), F.lit(12.0).alias("height"), text.alias("text"),
    )


FIGURES = "(^|[^a-z0-9_])(ebitda|tax expenses|profit after tax|finance costs|depreciation|operationalisation|business|network|infrastructure|cost)([^a-z0-9_]|$)"


@query("prose_list_regions", with_("lines") + f""", {ITEMS}, t as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as u, lag(page) over w as p, lag(y) over w as py from items window w as (partition by doc_id order by page, y, x, line_no)),
k as (select *, case when regexp_matches(u, '^(·|•|[oO]\\s*[A-Z0-9])') then true when p <> page or (p is not null and x <= page_width * 0.09 and y - py > height * 2.4 and regexp_matches(u, '^\\p{{Lu}}') and not regexp_matches(lower(u), '{FIGURES}')) then false end as k from t),
l as (select *, coalesce(last_value(k ignore nulls) over (partition by doc_id order by page, y, x, line_no rows between unbounded preceding and current row), false) as is_list from k),
c as (select *, case when is_list <> lag(is_list) over (partition by doc_id order by page, y, x, line_no) then 1 else 0 end as turn from l)
select doc_id, line_no, is_list, cast(sum(turn) over (partition by doc_id order by page, y, x, line_no rows between unbounded preceding and current row) as bigint) as region_no from c""")
def _(s, d):
    return R.text_regions(items(s, d)).select("doc_id", "line_no", "is_list", "region_no")


@query("format_list_text")
def _(s, d):
    return R.format_list_text(R.text_regions(items(s, d)))


@query("split_long_groups")
def _(s, d):
    return R.split_long_groups(L.paragraph_groups(items(s, d)), most=60)


def pages(s, d):
    """Recognised lines of documents: of each twenty the fourth is a numbered heading, the next are items, and a table of
    three columns with key words follows; each page's first line is its number."""
    n, words = F.col("line_no"), F.split("line", " ")
    k = n % 20
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("-"))
    cell = lambda x, t: F.struct(F.lit(float(x)).alias("x"), t.alias("text"))
    one = lambda t: F.array(cell(30, t))
    cells = (
        F.when(n % 40 == 0, one(F.concat(F.lit("Page "), (F.floor(n / 40) + 1).cast("string"), F.lit(" of 9"))))
        .when(k == 3, one(F.concat((n % 3 + 1).cast("string"), F.lit(".1 "), F.substring("line", 1, 40))))
        .when(k.between(5, 7), one(F.concat(F.lit("• "), "line")))
        .when(k == 8, F.array(cell(100, F.col("line"))))
        .when(k == 12, F.array(cell(40, F.lit("Sr. No")), cell(120, F.lit("Particulars")), cell(300, F.lit("FY26"))))
        .when(k.between(13, 16), F.array(cell(40, (k - 12).cast("string")), cell(120, word(0)), cell(300, F.concat(F.length("line").cast("string"), F.lit(",000")))))
        .when(k == 17, F.array(cell(120, word(1))))
        .otherwise(one(F.col("line")))
    )
    got = X.lines(s, d).select("doc_id", "line_no", F.floor(n / 40).cast("long").alias("page"), (30 + 18.0 * (n % 40)).alias("y"), F.explode(cells).alias("c"))
    got = got.select("doc_id", "line_no", "page", F.lit(600.0).alias("page_width"), F.lit(1000.0).alias("page_height"), F.col("c.x").alias("x"), "y", (F.col("c.x") + 5 * F.length("c.text")).alias("end_x"), (F.col("y") + 12).alias("end_y"), F.col("c.text").alias("text"))
    return got


@query("detect_keyed_tables")
def _(s, d):
    rows = R.keyed_tables(R.keyed_rows(pages(s, d).withColumn("median", F.lit(12.0))))
    return rows.select(*L.TABLE, "row_no", F.array_join(F.transform("cells", lambda c: c.text), " ").alias("text"))


@query("ocr_document_chunks")
def _(s, d):
    return R.ocr_document_chunks(pages(s, d), most=120).withColumn("path", F.array_join("path", " / "))


QUERIES, ORACLES = Q, O
