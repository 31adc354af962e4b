"""Queries over routes, labels, merges of hits and answers from tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvida.functions import questions as U
from corvida.functions import text as T
from corvida.operators import answers, context, merge, tables, text_index, vector_index
from corvida.operators import retrieve as R
from corvida.plans.retrieve_plans import GROUP_STEPS, LEXICAL, QUESTIONS, SECTION_STEPS, SIDES, TABLE, USER_QUESTIONS, hybrid_questions, sides, user_questions, vectors
from corvida.plans.shape_plans import _TABLE_TERMS, MARKDOWN, PAIRS, PARTS, TOKENS, pairs, part_chunks, part_tables, table_questions
from corvida.sources import fixtures as X
from corvida.sources.fixtures import with_
from corvida.sources.folders import shared_folder, written

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


def _any(words: list[str], text: str = "q", how: str = "contains") -> str:
    listed = ", ".join("'" + w + "'" for w in words)
    return f"(len(list_filter([{listed}], lambda x: {how}({text}, x))) > 0)"


#: Beginnings that make the questions of the conversations meet every routing rule.
STARTS = [
    "", "Compare ", "What is ", "Hello ", "Who are you, ", "12% of ", "Define ", "As you said, ", "Total under column 3 of ", "Revenue and EBITDA for ",
    "In the documents, ", "What is the optimal ", "Which compare versus ", "Thanks", "12 * (3 + 4)",
]
ASKED = f"""{USER_QUESTIONS}, p as (select *, [{', '.join(repr(s) for s in STARTS)}] as starts from questions),
asked as (select query_id, case when query_id % {len(STARTS)} >= {len(STARTS) - 2} then starts[query_id % {len(STARTS)} + 1] else starts[query_id % {len(STARTS)} + 1] || query end as query,
  query_id % 13 <> 0 as has_documents, case when query_id % 2 = 0 then 'assistant: [Source: a.txt]' else '' end as history, case query_id % 3 when 0 then 'agentic.' when 1 then 'Direct' end as label from p)"""


def asked(s, d):
    n, i = len(STARTS), F.col("query_id")
    start = F.element_at(F.array(*[F.lit(x) for x in STARTS]), (i % n + 1).cast("int"))
    return user_questions(s, d).select(
        "query_id", F.when(i % n >= n - 2, start).otherwise(F.concat(start, "query")).alias("query"), (i % 13 != 0).alias("has_documents"),
        F.when(i % 2 == 0, "assistant: [Source: a.txt]").otherwise("").alias("history"), F.when(i % 3 == 0, "agentic.").when(i % 3 == 1, "Direct").alias("label"),
    )


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(q, '{pattern}'))"


@query("route_queries", f"""with {ASKED}, l as (select *, lower(query) as q, upper(coalesce(label, '')) as u from asked)
select query_id, case when not has_documents then 'SINGLE_SHOT' when {_any(U.OUTSIDE_DOCUMENTS)} or {_any(U.SPECULATIVE)} then 'DIRECT'
  when {_any(U.GREETINGS, 'q', 'starts_with')} or {_any([g.strip() for g in U.GREETINGS], 'rtrim(q)', 'equals')} or {_any(U.ABOUT_THE_CONVERSATION)} then 'DIRECT'
  when regexp_full_match(q, '{U.ARITHMETIC_LINE}') or (regexp_matches(q, '[0-9]') and {_any(U.ARITHMETIC_PHRASES)}) or {_any(U.WORLD_KNOWLEDGE)} then 'DIRECT'
  when contains(history, '[Source:') and {_any(U.FOLLOW_UPS)} then 'DIRECT' when {_any(U.TABLE_LOOKUPS)} or {_any(U.NAMED_DOCUMENTS)} or {_any(U.BRIDGES)} then 'AGENTIC'
  when {_any(U.LOOKUP_STARTS, 'q', 'starts_with')} and not {_any(U.LOOKUP_EXCLUDED)} and {_count('[[:<:]](and|including)[[:>:]]').replace('[[:<:]]', chr(92) + 'b').replace('[[:>:]]', chr(92) + 'b')} <= 3 then 'SINGLE_SHOT'
  when {_any(U.COMPARISONS)} then 'AGENTIC' when {_count(chr(92) + 'b(and|versus|vs|while|whereas)' + chr(92) + 'b')} >= 1 and {_count(U.METRICS)} >= 2 then 'AGENTIC'
  when contains(u, 'DIRECT') then 'DIRECT' when contains(u, 'AGENTIC') then 'AGENTIC' else 'SINGLE_SHOT' end as route from l""".replace("equals(rtrim(q), x)", "rtrim(q) = x"))
def _(s, d):
    return asked(s, d).select("query_id", U.route(F.col("query"), F.col("has_documents"), F.col("history"), F.col("label")).alias("route"))


#: A model's response: an array of the question's halves, in another case, in some responses without brackets.
RESPONSES = f"""{USER_QUESTIONS}, h as (select query_id, replace(query, '"', '') as query, left(replace(query, '"', ''), 12) as a, right(replace(query, '"', ''), 15) as b from questions),
r as (select query_id, query, a, b, case query_id % 4 when 0 then 'No list' when 1 then '["' || a || '", "' || lower(a) || '", "' || b || '"]' when 2 then 'Sure: ["' || lower(query) || '", "' || b || '"].' else '["' || a || '", "one more", "' || b || '", "another", "last"]' end as response from h)"""


def responses(s, d):
    q = F.regexp_replace("query", '"', "")
    i = F.col("query_id") % 4
    h = user_questions(s, d).select("query_id", q.alias("query"), F.substring(q, 1, 12).alias("a"), F.substr(q, F.greatest(F.lit(1), F.length(q) - 14)).alias("b"))
    mark = F.lit('", "')
    listed = lambda *c: F.concat(F.lit('["'), F.array_join(F.array(*c), '", "'), F.lit('"]'))
    return h.withColumn("response", F.when(i == 0, "No list").when(i == 1, listed(F.col("a"), F.lower("a"), F.col("b"))).when(i == 2, F.concat(F.lit('Sure: ["'), F.lower("query"), mark, F.col("b"), F.lit('"].'))).otherwise(listed(F.col("a"), F.lit("one more"), F.col("b"), F.lit("another"), F.lit("last"))))


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("parse_subqueries", f"""with {RESPONSES}, i as (select query_id, {TRIM.format('query')} as own, list_filter(list_transform(regexp_extract_all(regexp_extract(response, '(?s)\\[.*\\]'), '"([^"]+)"', 1)[1:4], lambda x: {TRIM.format('x')}), lambda x: x <> '') as items from r),
u as (select query_id, own, list_filter(items, lambda x, n: list_position(list_transform(items, lambda y: lower(y)), lower(x)) = n) as items from i)
select query_id, array_to_string(case when list_contains(list_transform(items, lambda y: lower(y)), lower(own)) then items else list_filter(list_concat(items[1:3], [own]), lambda x: x <> '') end, '|') as subqueries from u""")
def _(s, d):
    return responses(s, d).select("query_id", F.array_join(U.subqueries(F.col("response"), F.col("query")), "|").alias("subqueries"))


LABELS = ["direct answer", "Agentic", "single", "REQUERY, then supplement", "Supplement it", "use", "Insufficient: ask for more : now ", "INSUFFICIENT", "Sufficient: yes", "vector", "BM25"]


@query("parse_labels", f"""with {USER_QUESTIONS}, r as (select query_id, [{', '.join(repr(x) for x in LABELS)}][query_id % {len(LABELS)} + 1] as x from questions)
select query_id, case when contains(upper(x), 'DIRECT') then 'DIRECT' when contains(upper(x), 'AGENTIC') then 'AGENTIC' else 'SINGLE_SHOT' end as route,
  case when contains(upper(x), 'REQUERY') then 'REQUERY' when contains(upper(x), 'SUPPLEMENT') then 'SUPPLEMENT' else 'USE' end as action,
  case when starts_with(upper(x), 'INSUFFICIENT') and strpos(x, ':') > 0 then trim(substr(x, strpos(x, ':') + 1)) end as gap, case lower(x) when 'vector' then 'VECTOR' when 'bm25' then 'BM25' else 'HYBRID' end as mode from r""")
def _(s, d):
    x = F.element_at(F.array(*[F.lit(v) for v in LABELS]), (F.col("query_id") % len(LABELS) + 1).cast("int"))
    return user_questions(s, d).select("query_id", U.route_label(x).alias("route"), U.relevance_label(x).alias("action"), U.gap_query(x).alias("gap"), U.retrieval_mode(x).alias("mode"))


# D: hits of the vector questions
MODES = "modes as (select doc_id as query_id, case doc_id // 20 % 3 when 0 then 'VECTOR' when 1 then 'BM25' else 'HYBRID' end as mode, case doc_id // 20 % 2 when 0 then 'SUPPLEMENT' else 'USE' end as action from documents where doc_id % 20 = 0)"


def modes(s, d):
    n = F.floor(F.col("doc_id") / 20)
    return X.table(s, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.when(n % 3 == 0, "VECTOR").when(n % 3 == 1, "BM25").otherwise("HYBRID").alias("mode"), F.when(n % 2 == 0, "SUPPLEMENT").otherwise("USE").alias("action"))


def shown(hits):
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def written_sides(s, d):
    """Both sides, searched once each, for queries that go on from them more than once."""
    q, v, x = sides(s, d)
    return q, written(v, "vector-side"), written(x, "lexical-side")


@query("retrieve_by_mode", with_("chunks") + f""", {SIDES}, {MODES}, u as (select 'VECTOR' as mode, query_id, chunk_id, vector_score as score from v where v_rank <= 5 union all select 'BM25', query_id, chunk_id, 1.0 / (60 + lexical_rank) from l where lexical_rank <= 5 union all select 'HYBRID', query_id, chunk_id, score from h where rank <= 5),
hits as (select query_id, chunk_id, score, chunk_index, group_id from u join modes using (query_id, mode) join chunks using (chunk_id)){GROUP_STEPS}{SECTION_STEPS}
select query_id, chunk_id, rank, round(score, 6) as score from placed""")
def _(s, d):
    q, v, x = written_sides(s, d)
    vector = v.where("rank <= 5").withColumnRenamed("vector_score", "score")
    hits = merge.by_mode(modes(s, d), vector, x.where("lexical_rank <= 5").withColumnRenamed("lexical_rank", "rank"), R.hybrid(q, v, x))
    return shown(merge.expanded(written(hits, "hits"), X.chunks(s, d)))


#: Documents' first three lines, the first twelve words of each, are a question and its two rephrasings. What it is labelled
#: after each try goes by its number: used at once, after one try, or never.
TRIES = """tries as (select doc_id as query_id, n - 1 as attempt, array_to_string(list_slice(string_split(string_split(text, chr(10))[n], ' '), 1, 12), ' ') as query, doc_id // 20 % 3 as patience from documents, range(1, 4) t(n) where doc_id % 20 = 0 and len(string_split(text, chr(10))) >= n)"""


def tries(s, d):
    """(query_id, attempt, query, action)."""
    line = lambda x: F.array_join(F.slice(F.split(x, " "), 1, 12), " ")
    docs = X.table(s, d, "documents").where("doc_id % 20 = 0")
    got = docs.select(F.col("doc_id").alias("query_id"), (F.floor(F.col("doc_id") / 20) % 3).alias("patience"), F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("attempt", "l"))
    return got.select("query_id", "attempt", line(F.col("l")).alias("query"), F.when(F.col("attempt") < F.col("patience"), "REQUERY").otherwise("USE").alias("action"))


@query("requery_replace", with_("chunks") + f""", {TRIES}, questions as (select query_id * 10 + attempt as query_id, query from tries), {LEXICAL},
found as (select query_id // 10 as query_id, query_id % 10 as attempt, chunk_id, lexical_rank as rank, 1.0 / (60 + lexical_rank) as score from lexical where lexical_rank <= 5),
has as (select query_id, bool_or(attempt = 1) as one, bool_or(attempt = 2) as two from found group by query_id),
used as (select distinct t.query_id, case when patience >= 2 and one and two then 2 when patience >= 1 and one then 1 else 0 end as attempt from tries t join has using (query_id))
select query_id, chunk_id, rank, round(score, 6) as score from found join used using (query_id, attempt)""".replace("found as (select distinct w", "matched as (select distinct w").replace("from found qualify", "from matched qualify"))
def _(s, d):
    t = written(tries(s, d), "tries")
    index = text_index.create(X.chunks(s, d), f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
    search = lambda q: text_index.topk(index, q).withColumnRenamed("lexical_rank", "rank")
    return shown(merge.requery(search, t))


@query("supplement_and_gap_merge", with_("chunks") + f""", {SIDES}, {MODES}, v5 as (select * from v where v_rank <= 5), l3 as (select *, 1.0 / (60 + lexical_rank) as score from l where lexical_rank <= 3),
b as (select query_id, chunk_id, v_rank as pos, vector_score as score from v5 union all select query_id, chunk_id, 100 + lexical_rank, score from l3 semi join (select query_id from modes where action = 'SUPPLEMENT') m using (query_id)),
o as (select query_id, chunk_id, min(pos) as pos, arg_min(score, pos) as score from b group by all), s as (select *, row_number() over (partition by query_id order by score desc, pos, chunk_id) as rank from o qualify rank <= 5),
gaps as (select query_id, chunk_id, v_rank as pos, vector_score as score from v5 union all select query_id, chunk_id, 100 + lexical_rank, score from l3 anti join v5 using (query_id, chunk_id))
select 'supplement' as kind, query_id, chunk_id, rank, round(score, 6) as score from s union all select 'gap', query_id, chunk_id, row_number() over (partition by query_id order by pos, chunk_id), round(score, 6) from gaps""")
def _(s, d):
    _, v, x = written_sides(s, d)
    hits, extra = v.where("rank <= 5").withColumnRenamed("vector_score", "score"), x.withColumnRenamed("lexical_rank", "rank")
    return shown(merge.supplement(hits, extra, modes(s, d))).withColumn("kind", F.lit("supplement")).unionByName(shown(merge.gap_merge(hits, extra)).withColumn("kind", F.lit("gap")))


@query("search_documents", with_("chunks") + f""", {QUESTIONS}, {LEXICAL.replace("<= 30", "<= 60")}, most as (select query_id, least(greatest(query_id // 20 % 14 - 2, 1), 10) as most from questions),
t as (select l.query_id, lexical_rank as rank, 1.0 / (60 + lexical_rank) as score, file_name, content from lexical l join chunks c using (chunk_id) join most m on m.query_id = l.query_id where lexical_rank <= most),
p as (select query_id, count(*) as n, string_agg(rank || '. ' || file_name || ' (' || printf('%.3f', cast(score as double)) || ')' || chr(10) || content, chr(10) || chr(10) order by rank) as t from t group by query_id)
select q.query_id, case when n is null then 'no_results' else 'success' end as status, coalesce(n, 0) as result_count, coalesce(t, '') as passages from questions q left join p using (query_id)""")
def _(s, d):
    q, c = hybrid_questions(s, d), X.chunks(s, d)
    hits = R.lexical_topk(q, c, 10).withColumnRenamed("lexical_rank", "rank").join(c.select("chunk_id", "file_name", "content"), "chunk_id")
    return merge.search_results(q.select("query_id", (F.floor(F.col("query_id") / 20) % 14 - 2).alias("max_results")), hits)


@query("ann_vector_topk")
def _(s, d):
    q, v = vectors(s, d)
    index = vector_index.build(v, f"{shared_folder(s)}/cells-{uuid.uuid4().hex}")
    return vector_index.search(index, q, vector_index.audited_probes(index, q, v))


@query("ann_recall_curve")
def _(s, d):
    q, v = vectors(s, d)
    return vector_index.recall_curve(vector_index.build(v, f"{shared_folder(s)}/cells-{uuid.uuid4().hex}"), q, v)


# E
@query("trim_last_chunk", with_("chunks", "lines") + f""", {PAIRS}, t as (select query_id, chunk_id, content, {TOKENS.format('content')} as own, sum({TOKENS.format('content')}) over (partition by query_id order by rank rows between unbounded preceding and current row) as upto from pairs),
o as (select *, cast(400 - (upto - own) - 24 as integer) as budget from t where upto > 400 and upto - own <= 400)
select query_id, chunk_id, cast(budget as bigint) as budget, array_to_string(list_slice(regexp_split_to_array(content, '\\s+'), 1, greatest(1, cast(floor(budget / 1.3) as integer))), ' ') as content from o where budget > 80""")
def _(s, d):
    return context.trim_last_chunk(pairs(s, d), 400)


@query("reduce_table_lines")
def _(s, d):
    c = part_chunks(s, d).withColumn("query", F.concat(F.lit("Part "), F.regexp_extract("content", r"Part (\d+)", 1), F.lit(" size")))
    return context.reduce_table_lines(c, 60).select("chunk_id", "content")


# F: the question names the size and the third column, so all rows of a table score alike and its first ones are best
def table_rows(s, d, most):
    return table_questions(s, d, F.lit("what is the combined size and col 3 of part"), most)


@query("requested_columns", f"with {MARKDOWN} select distinct chunk_id as query_id, 'Size|Col 3' as labels from ordered")
def _(s, d):
    q, _, rows = table_rows(s, d, 5)
    return answers.requested_columns(q, rows).select("query_id", F.array_join("labels", "|").alias("labels"))


@query("table_lookup", f"with {MARKDOWN} select chunk_id as query_id, 'Part ' || p_partkey || ' — Size: ' || p_size || '; Col 3: ' || price || ' (Source: ' || chunk_id || '.txt)' as answer, true as confident from ordered where row_no = 0")
def _(s, d):
    q, _, rows = table_rows(s, d, 5)
    return answers.lookup(q, rows)


TABLE_SUM = f"""{MARKDOWN}, n as (select chunk_id, row_no, col, label, value, try_cast(value as double) as number from cells where row_no in (0, 1, 2) and try_cast(value as double) is not null),
o as (select chunk_id, label, value, min(number) as number, min(row_no * 10 + col) as pos from n group by all),
sums as (select chunk_id as query_id, string_agg(value, ' + ' order by pos) || ' = ' || case when abs(sum(number) - trunc(sum(number))) < 0.0001 then cast(cast(trunc(sum(number)) as bigint) as varchar) else printf('%.2f', sum(number)) end || ' (Source: ' || chunk_id || '.txt)' as answer from o group by chunk_id having count(*) between 2 and 8)"""


@query("table_sum", f"with {TABLE_SUM} select * from sums")
def _(s, d):
    q, c, rows = table_rows(s, d, 3)
    return answers.sums(q, rows, c)


FACT_LINES = "string_agg('- ' || chunk_id || '.txt: Part ' || p_partkey || ' | Name: Part ' || p_partkey || ' | Size: ' || p_size || ' | Col 3: ' || price, chr(10) order by row_no)"


#: The same, added up in the order shown: whether a sum of cents comes out whole goes by the order of its parts.
TABLE_SUM_IN_ORDER = TABLE_SUM.replace("sum(number)", "sum(number order by pos)")


@query("inject_table_facts", f"""with {TABLE_SUM_IN_ORDER}, f as (select chunk_id as query_id, {FACT_LINES} as facts from ordered where row_no in (0, 1, 2) group by chunk_id)
select chunk_id as query_id, chunk_id, 1 as rank, 1.0::double as score, length(content) as chars from tbl
union all select f.query_id, 'table-facts:' || f.query_id, 0, {answers.FIRST_SCORE}, length(case when answer is not null then '{answers.VERIFIED}' || answer || '{answers.VERIFIED_FACTS}' || facts || '{answers.VERIFIED_END}' else '{answers.FACTS}' || facts || '{answers.FACTS_END}' end) from f left join sums using (query_id)""")
def _(s, d):
    q, c, rows = table_rows(s, d, 3)
    hits = c.select(F.col("chunk_id").alias("query_id"), "chunk_id", F.lit(1).alias("rank"), F.lit(1.0).alias("score"), "content")
    found = tables.facts(rows).join(answers.sums(q, rows, c), "query_id", "left").withColumn("confidence", F.when(F.col("answer").isNotNull(), "HIGH").otherwise("MEDIUM"))
    return answers.inject_facts(hits, found).select("query_id", "chunk_id", "rank", "score", F.length("content").cast("long").alias("chars"))


#: Tables of parts in which every fifth size is missing, each asked one of these kinds of question about its last part, N.
KINDS = [
    "what size has part N, by name?", "which part has the highest value, and what is the combined size of part N?", "what is the combined size of part N and of nothing else?",
    "which table lists zebras?", "what amount has part N under column 9?", "who made part N?", "what is the total of col 3 and size, by name, of part N?", "what value has part N in col 3?",
]


def asked_tables(s, d):
    """(questions, chunks, their rows)."""
    size = F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("string"))
    row = F.array(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")), size, F.format_string("%.2f", F.col("p_retailprice").cast("double")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.max("p_partkey") % len(KINDS) + 1).cast("int"))
    got = part_tables(s, d).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("rows"), F.replace(kind, F.lit("N"), F.max("p_partkey").cast("string")).alias("query"))
    c = got.select(F.col("table_id").alias("chunk_id"), F.concat("table_id", F.lit(".txt")).alias("file_name"), "query", tables.to_markdown(F.array(F.lit("Name"), F.lit("Size"), F.lit("")), F.transform("rows", lambda x: x.r)).alias("content"))
    q = c.select(F.col("chunk_id").alias("query_id"), "query")
    return q, c, tables.rank_rows(q, c, c.select(F.col("chunk_id").alias("query_id"), "chunk_id", F.lit(1.0).alias("score")))


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SAME = "(contains({0}, {1}) or contains({1}, {0}))"
ANSWERED = f"""parts as (select *, p_brand || '.' || p_partkey // {PARTS} as chunk_id, case when p_size % 5 > 0 then cast(p_size as varchar) end as size, printf('%.2f', cast(p_retailprice as double)) as price from part),
tbl as (select chunk_id, chunk_id || '.txt' as file_name, '| Name | Size | Col 3 |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| Part ' || p_partkey || ' | ' || coalesce(size, '-') || ' | ' || price || ' |', chr(10) order by p_partkey) as content,
  replace(([{", ".join("'" + k + "'" for k in KINDS)}])[max(p_partkey) % {len(KINDS)} + 1], 'N', cast(max(p_partkey) as varchar)) as query from parts group by chunk_id),
numbered as (select *, row_number() over (partition by chunk_id order by p_partkey) - 1 as row_no from parts),
cells as (select chunk_id, row_no, 0 as col, 'Name' as label, 'Part ' || p_partkey as value from numbered union all select chunk_id, row_no, 1, 'Size', size from numbered where size is not null union all select chunk_id, row_no, 2, 'Col 3', price from numbered),
asked as (select chunk_id, file_name, content, query, {_TABLE_TERMS.format("query")} as q, {_NORM.format("query")} as nq from tbl where len(list_filter({TABLE}, lambda x: contains(lower(query), x))) > 0),
shared as (select chunk_id, q, len(list_intersect(q, {_TABLE_TERMS.format("file_name || ' ' || content")})) as n from asked),
told as (select c.chunk_id, c.row_no, any_value(n) + count(*) filter (where len(list_filter(q, lambda t: contains({_NORM.format("value")}, t) or contains({_NORM.format("label")}, t))) > 0) as row_score from cells c join shared using (chunk_id) group by all),
best as (select * from (select *, row_number() over (partition by chunk_id order by row_score desc, row_no) as place, max(row_score) over (partition by chunk_id) as top from told) where place <= 5 and (row_score > 0 or top = 0)),
shown as (select b.chunk_id, place, row_score, arg_min(value, col) as name, string_agg(label || ': ' || value, ' | ' order by col) as line from best b join cells using (chunk_id, row_no) group by all),
f as (select chunk_id, string_agg('- ' || chunk_id || '.txt: ' || name || ' | ' || line, chr(10) order by place) as facts, max(row_score) as top, arg_min(name, place) as first from shown group by chunk_id),
numbers as (select b.chunk_id, b.place, c.col, c.label, c.value, n.value as name, try_cast(c.value as double) as number from best b join cells c using (chunk_id, row_no) join cells n on n.chunk_id = b.chunk_id and n.row_no = b.row_no and n.col = 0 where row_score > 0 and try_cast(c.value as double) is not null),
extreme as (select chunk_id, name || ' — ' || label || ': ' || value || ' (Source: ' || chunk_id || '.txt)' as answer from numbers join asked using (chunk_id) where regexp_matches(lower(query), 'highest|largest|lowest')
  qualify row_number() over (partition by chunk_id order by case when contains(lower(query), 'lowest') then number else -number end, place, col) = 1),
operands as (select chunk_id, label, value, min(number) as number, min(place * 10 + col) as pos from numbers join asked using (chunk_id)
  where regexp_matches(lower(query), 'sum|combined|total of') and len(list_filter(q, lambda t: contains({_NORM.format("file_name || ' ' || content || ' ' || label || ' ' || value")}, t))) > 0 group by all),
total as (select chunk_id, string_agg(value, ' + ' order by pos) || ' = ' || case when abs(sum(number order by pos) - trunc(sum(number order by pos))) < 0.0001 then cast(cast(trunc(sum(number order by pos)) as bigint) as varchar) else printf('%.2f', sum(number order by pos)) end || ' (Source: ' || chunk_id || '.txt)' as answer from operands group by chunk_id having count(*) between 2 and 8),
named as (select chunk_id, query, list_filter(['Name', 'Size', 'Col 3'], lambda l: length({_NORM.format("l")}) > 1 and contains(nq, {_NORM.format("l")})) as l from asked),
labels as (select chunk_id, list_concat(l, list_filter(list_transform(regexp_extract_all(lower(query), '\\bcol(?:umn)?\\s*(\\d+)\\b', 1), lambda n: 'Col ' || n), lambda x: not list_contains(l, x))) as l from named),
looked as (select chunk_id, any_value(n.name) || ' — ' || string_agg(c.label || ': ' || c.value, '; ' order by c.col) || ' (Source: ' || chunk_id || '.txt)' as answer from best b join cells c using (chunk_id, row_no) join labels using (chunk_id) join (select chunk_id, row_no, value as name from cells where col = 0) n using (chunk_id, row_no)
  where place = 1 and row_score >= 2 and (len(l) = 0 or len(list_filter(l, lambda x: {_SAME.format(_NORM.format("x"), _NORM.format("c.label"))})) > 0) group by chunk_id)"""


@query("table_answers", f"""with {ANSWERED} select f.chunk_id as query_id, facts, coalesce(e.answer, t.answer, k.answer) as answer, case when coalesce(e.answer, t.answer, k.answer) is null then 'MEDIUM' else 'HIGH' end as confidence
from f left join extreme e using (chunk_id) left join total t using (chunk_id) left join looked k using (chunk_id)""")
def _(s, d):
    q, c, rows = asked_tables(s, d)
    return answers.table_answers(q, rows, c)


@query("asked_columns", f"with {ANSWERED} select chunk_id as query_id, array_to_string(l, '|') as labels from labels where chunk_id in (select chunk_id from best where row_score > 0)")
def _(s, d):
    q, _, rows = asked_tables(s, d)
    return answers.requested_columns(q.where(T.is_table_question(F.col("query"))), rows).select("query_id", F.array_join("labels", "|").alias("labels"))


QUERIES, ORACLES = Q, O
