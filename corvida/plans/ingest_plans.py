"""Queries of family B: ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import ingest as I
from corvida.sources import fixtures as X
from corvida.sources.fixtures import with_

Q, O = {}, {}
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
TOKENS = "greatest(1, cast(floor(len(regexp_split_to_array({}, '\\s+')) * 1.3) as integer))"


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


@query("token_estimate", with_("lines") + f"select doc_id, line_no, {TOKENS.format('line')} as tokens from lines")
def _(s, d):
    return X.lines(s, d).select("doc_id", "line_no", T.token_estimate(F.col("line")).alias("tokens"))


@query("split_paragraphs", f"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {TRIM.format('x')}), lambda x: x <> '') as p from documents) select doc_id, i as paragraph_no, p[i + 1] as paragraph from (select *, unnest(range(len(p))) as i from p)")
def _(s, d):
    t = X.table(s, d, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("t"))
    return t.select("doc_id", F.posexplode(T.paragraphs(F.col("t"))).alias("paragraph_no", "paragraph")).withColumn("paragraph_no", F.col("paragraph_no").cast("long"))


@query("split_sentences", f"with p as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')} <> '') as p from documents) select doc_id, i as sentence_no, p[i + 1] as sentence from (select *, unnest(range(len(p))) as i from p)")
def _(s, d):
    return X.table(s, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("long"))


SQUEEZED = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_JUNK = " or ".join([*[f"regexp_matches({SQUEEZED.format('content')}, '{p}')" for p in T.JUNK_PATTERNS], *[f"{SQUEEZED.format('content')} = '{x}'" for x in T.JUNK_LINES]])


@query("drop_junk_chunks", with_("lines") + f", m as (select doc_id, line_no, case line_no % 5 when 0 then 'Page ' || line_no || ' of 9' when 1 then '(₹ in crore)' else line end as content from lines) select * from m where not ({_JUNK} or length({SQUEEZED.format('content')}) <= 1)")
def _(s, d):
    n = F.col("line_no")
    m = X.lines(s, d).select("doc_id", "line_no", F.when(n % 5 == 0, F.concat(F.lit("Page "), n.cast("string"), F.lit(" of 9"))).when(n % 5 == 1, "(₹ in crore)").otherwise(F.col("line")).alias("content"))
    return I.drop_junk(m)


MASKED = "trim(regexp_replace(regexp_replace(lower({}), '\\d+', '#', 'g'), '\\s+', ' ', 'g'))"


@query("dedupe_chunks", with_("lines") + f""", m as (select doc_id, line_no as chunk_index, case when line_no % 3 = 0 then 'Line ' || line_no when line_no % 7 = 1 then 'Telephone of desk ' || line_no || line else line end as content, case when line_no % 5 = 4 then 'g' end as group_id from lines),
s as (select *, {MASKED.format("content")} as s from m), n as (select * from (select *, row_number() over (partition by doc_id, s order by chunk_index) as n from s) where n = 1 or group_id is not null),
k as (select *, case {" ".join(f"when contains(s, '{t}') then '{t}'" for t in T.FURNITURE_TERMS)} when s = 'page # of #' then 'page' end as k from n)
select doc_id, chunk_index, content from (select *, row_number() over (partition by doc_id, k order by chunk_index) as first from k) where k is null or first = 1""")
def _(s, d):
    n = F.col("line_no")
    content = F.when(n % 3 == 0, F.concat(F.lit("Line "), n.cast("string"))).when(n % 7 == 1, F.concat(F.lit("Telephone of desk "), n.cast("string"), F.col("line"))).otherwise(F.col("line"))
    m = X.lines(s, d).select("doc_id", n.alias("chunk_index"), content.alias("content"), F.when(n % 5 == 4, "g").alias("group_id"))
    return I.dedupe(m).drop("group_id")


@query("list_runs", with_("lines") + ", m as (select doc_id, line_no, case when line_no % 4 in (1, 2) then '- ' || line else line end as line from lines), f as (select *, regexp_matches(line, '^\\s*([-*•◦▪]|\\d+[.)])\\s+') as is_item from m), g as (select *, sum(case when is_item and not coalesce(prev, false) then 1 else 0 end) over (partition by doc_id order by line_no) as run from (select *, lag(is_item) over (partition by doc_id order by line_no) as prev from f)) select doc_id, min(line_no) as first_line, count(*) as items, string_agg(line, chr(10) order by line_no) as text from g where is_item group by doc_id, run")
def _(s, d):
    m = X.lines(s, d).withColumn("line", F.when((F.col("line_no") % 4).isin(1, 2), F.concat(F.lit("- "), F.col("line"))).otherwise(F.col("line")))
    return I.list_runs(m)


LAYOUT = "layout as (select doc_id, line_no // 40 as page, 720.0::double as page_height, 80.0::double as x, 18.0::double * (line_no % 40) as y, 80.0::double + 6 * least(length(line), 80) as end_x, 18.0::double * (line_no % 40) + 12 as end_y, case when line_no % 40 = 0 then 'Report page ' || (line_no // 40) else line end as text, 12 + (length(line) * 7) % 9 as font_size, length(line) % 3 = 0 as is_bold from lines)"


def layout(s, d):
    n, size = F.col("line_no"), F.length("line")
    return X.lines(s, d).select(
        "doc_id", F.floor(n / 40).cast("long").alias("page"), F.lit(720.0).alias("page_height"), F.lit(80.0).alias("x"), (F.lit(18.0) * (n % 40)).alias("y"), (F.lit(80.0) + 6 * F.least(size, F.lit(80))).alias("end_x"),
        (F.lit(18.0) * (n % 40) + 12).alias("end_y"), F.when(n % 40 == 0, F.concat(F.lit("Report page "), F.floor(n / 40).cast("string"))).otherwise(F.col("line")).alias("text"), (12 + (size * 7) % 9).alias("font_size"), (size % 3 == 0).alias("is_bold"),
    )


LEVEL = "case when font_size > 18 then 1 when font_size > 15 then 2 when (is_bold or font_size > 13) and length(text) < 120 then 3 else 0 end"


@query("heading_level_font", with_("lines") + f""", {LAYOUT}, w as (select *, list_filter(regexp_split_to_array({TRIM.format('text')}, '\\s+'), lambda x: x <> '') as w from layout)
select doc_id, page, y, {LEVEL} as level, case when len(list_filter(w, lambda x: regexp_full_match(regexp_replace(x, '[,.%()₹$\\-]', '', 'g'), '\\d+'))) >= 2 or (len(w) between 2 and 6 and len(list_filter(w, lambda x: regexp_matches(x, '\\d'))) = len(w)) then 0 else {LEVEL} end as strict_level from w""")
def _(s, d):
    size = F.col("font_size"), F.col("is_bold"), F.col("text"), F.lit(12)
    return layout(s, d).select("doc_id", "page", "y", I.heading_level(*size).alias("level"), I.strict_heading_level(*size).alias("strict_level"))


_LOW = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_IS_FURNITURE = " or ".join([*[f"regexp_matches({_LOW}, '{p}')" for p in T.FURNITURE_PATTERNS], *[f"{_LOW} = '{x}'" for x in T.FURNITURE_LINES], *[f"contains({_LOW}, '{x}')" for x in T.FURNITURE_HOLDS]])


@query("drop_page_furniture", with_("lines") + f""", {LAYOUT}, p as (select * replace (case when y = 54 then 'Telephone: ' || doc_id when y = 72 then 'page ' || page || ' of 9' when y = 86.4 then 'on the line' else text end as text) from (select * replace (case when y = 90 then 86.4 else y end as y) from layout)),
s as (select *, {MASKED.format("text")} as k from p), o as (select doc_id, k from s group by doc_id, k having count(distinct page) >= 3)
select doc_id, page, y, text from s where not ({_IS_FURNITURE}) and not ((y < 0.12 * page_height or y > 0.86 * page_height) and (doc_id, k) in (select doc_id, k from o))""")
def _(s, d):
    # boilerplate in the margin and below it, and a repeated line exactly on the margin's limit
    y = F.col("y")
    lines = layout(s, d).withColumn("y", F.when(y == 90, 86.4).otherwise(y))
    text = F.when(y == 54, F.concat(F.lit("Telephone: "), F.col("doc_id").cast("string"))).when(y == 72, F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" of 9"))).when(y == 86.4, "on the line").otherwise(F.col("text"))
    return I.drop_page_furniture(lines.withColumn("text", text)).select("doc_id", "page", "y", "text")


@query("page_bboxes", with_("lines") + f", {LAYOUT} select doc_id, page, min(x) as x, min(y) as y, floor((max(end_x) - min(x)) * 10) / 10 as width, floor((max(end_y) - min(y)) * 10) / 10 as height from layout group by doc_id, page")
def _(s, d):
    return I.page_boxes(layout(s, d), ["doc_id"])


@query("ingest_summary", with_("chunks") + f"select doc_id, count(*) as chunks, count(*) filter (where chunk_type = 'SECTION') as sections, count(*) filter (where chunk_type = 'TEXT') as texts, round(avg({TOKENS.format('content')}), 4) as mean_tokens from chunks group by doc_id")
def _(s, d):
    return I.ingest_summary(X.chunks(s, d))


def tagged_pages(s, d):
    """pages, each with a table of its own at its end."""
    extra = "<h4>Facts</h4><table class=x><tr><th>Name</th><th>Value</th></tr><tr><td>page</td><td><b>"
    html = F.concat("html", F.lit(extra), F.col("page_id").cast("string"), F.lit("</b></td></tr></table><p>end"))
    return X.table(s, d, "pages").withColumn("html", html)


# elements end where others begin, which SQL here has no pattern for: a test holds all pages against a parser
@query("markup_blocks")
def _(s, d):
    return I.markup_blocks(tagged_pages(s, d)).withColumn("path", F.array_join("path", " > "))


QUERIES, ORACLES = Q, O
