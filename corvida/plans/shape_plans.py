"""Queries of families E to H: context, tables, conversations, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import chat, context, evaluate, tables
from corvida.plans.retrieve_plans import QUESTIONS, VECTOR_HITS, hybrid_questions, vector_side
from corvida.sources import fixtures as X
from corvida.sources.fixtures import with_
from corvida.sources.folders import written

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


# E: every fourth-line block of a document against its first line as the question
PAIRS = "pairs as (select c.doc_id as query_id, c.chunk_id, c.chunk_index as rank, c.content, c.file_name, q.line as query, 1.0 / (1 + c.chunk_index) as score from chunks c join lines q on q.doc_id = c.doc_id and q.line_no = 0)"


def pairs(s, d):
    q = X.lines(s, d).where("line_no = 0").select("doc_id", F.col("line").alias("query"))
    return X.chunks(s, d).join(q, "doc_id").select(F.col("doc_id").alias("query_id"), "chunk_id", F.col("chunk_index").alias("rank"), "content", "file_name", "query", (1 / (1 + F.col("chunk_index"))).alias("score"))


@query("reduce_sentences", with_("chunks", "lines") + f""", {PAIRS},
s as (select query_id, chunk_id, content, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9_]+'), lambda w: length(w) > 2)) as q,
  list_filter(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 10) as s from pairs),
e as (select *, unnest(range(1, len(s) + 1)) as i from s),
r as (select query_id, chunk_id, s[i] as sentence, i, row_number() over (partition by chunk_id order by len(list_intersect(q, list_distinct(list_filter(regexp_split_to_array(lower(s[i]), '[^a-z0-9_]+'), lambda w: length(w) > 2)))) desc, i) as n from e),
b as (select chunk_id, string_agg(sentence, ' ' order by i) as best from r where n <= 5 group by chunk_id)
select s.query_id, s.chunk_id, case when len(list_filter(string_split(content, chr(10)), lambda x: starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '|'))) > 0 or len(s) <= 5 or len(q) = 0 then content else best end as content
from s left join b using (chunk_id)""")
def _(s, d):
    return context.reduce_sentences(pairs(s, d)).select("query_id", "chunk_id", "content")


@query("classify_chunk_shape", with_("chunks") + "select chunk_id, len(list_filter(string_split(content, chr(10)), lambda x: starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '|'))) > 0 as is_table from chunks")
def _(s, d):
    return X.chunks(s, d).select("chunk_id", context.is_table_chunk(F.col("content")).alias("is_table"))


TOKENS = "greatest(1, cast(floor(len(regexp_split_to_array({}, '\\s+')) * 1.3) as integer))"


@query("pack_context", with_("chunks", "lines") + f", {PAIRS}, t as (select *, sum({TOKENS.format('content')}) over (partition by query_id order by rank rows between unbounded preceding and current row) as tokens from pairs) select query_id, chunk_id, cast(tokens as bigint) as tokens from t where tokens <= 400")
def _(s, d):
    return context.pack_context(pairs(s, d), 400).select("query_id", "chunk_id", "tokens")


INSTRUCTIONS = "Answer the question from the documents below and name the source of what you say."
_WORDS = "(case when regexp_matches({0}, '^\\s*$') then 0 else len(regexp_split_to_array(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+')) end)"


@query("budgeted_prompt", with_("chunks", "lines") + f""", {PAIRS}, w as (select *, {len(INSTRUCTIONS.split())} + {_WORDS.format("query")} as fixed, {_WORDS.format("'[Source: ' || file_name || ', relevance: ' || printf('%.2f', score) || ']' || chr(10) || content")} + case when rank > 0 then 1 else 0 end as own from pairs),
u as (select *, fixed + sum(own) over (partition by query_id order by rank rows between unbounded preceding and current row) as upto from w),
o as (select *, floor(upto * 1.3) <= 672 as fits, cast(672 - floor((upto - own) * 1.3) - 24 as bigint) as remaining, floor((upto - own) * 1.3) <= 672 or rank = 0 as first_over from u)
select query_id, chunk_id, cast(null as bigint) as budget from o where fits union all select query_id, chunk_id, remaining from o where not fits and first_over and remaining > 80""")
def _(s, d):
    hits = pairs(s, d)
    questions = hits.where("rank = 0").select("query_id", "query", F.lit(None).cast("string").alias("note"))
    return context.budgeted_chunks(questions, hits.drop("query"), INSTRUCTIONS, 1000, 200).select("query_id", "chunk_id", "budget")


@query("context_string", with_("chunks", "lines") + f", {PAIRS} select query_id, string_agg('[Source: ' || file_name || ', relevance: ' || printf('%.2f', round(score, 2)) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from pairs group by query_id")
def _(s, d):
    return context.context_strings(pairs(s, d))


@query("citations", with_("chunks", "lines") + f", {PAIRS} select query_id, count(*) as n, min(file_name) as title, cast(sum(length(left(content, 200))) as bigint) as chars from pairs group by query_id")
def _(s, d):
    c = context.citations(pairs(s, d)).select("query_id", context.parse_citations(F.col("sources")).alias("s"))
    return c.select("query_id", F.size("s").cast("long").alias("n"), F.element_at("s", 1).title.alias("title"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x.snippet)).alias("chars"))


# F: tables of parts, one for each brand and run of PARTS part keys, so that none grows with the data
PARTS = 500


def part_tables(s, d):
    """part with table_id, the brand and its run of keys."""
    return X.table(s, d, "part").withColumn("table_id", F.concat_ws(".", "p_brand", F.floor(F.col("p_partkey") / PARTS).cast("string")))


def part_chunks(s, d):
    row = F.array(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.format_string("%.2f", F.col("p_retailprice").cast("double")))
    got = part_tables(s, d).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("rows"))
    return got.select(F.col("table_id").alias("chunk_id"), F.concat("table_id", F.lit(".txt")).alias("file_name"), tables.to_markdown(F.array(F.lit("Name"), F.lit("Size"), F.lit("")), F.transform("rows", lambda x: x.r)).alias("content"))


MARKDOWN = f"""parts as (select *, p_brand || '.' || p_partkey // {PARTS} as table_id from part),
tbl as (select table_id as chunk_id, table_id || '.txt' as file_name, '| Name | Size | Col 3 |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| Part ' || p_partkey || ' | ' || p_size || ' | ' || printf('%.2f', cast(p_retailprice as double)) || ' |', chr(10) order by p_partkey) as content from parts group by table_id),
ordered as (select table_id as chunk_id, row_number() over (partition by table_id order by p_partkey) - 1 as row_no, p_partkey, p_size, printf('%.2f', cast(p_retailprice as double)) as price from parts),
cells as (select chunk_id, row_no, 0 as col, 'Name' as label, 'Part ' || p_partkey as value from ordered union all select chunk_id, row_no, 1, 'Size', cast(p_size as varchar) from ordered union all select chunk_id, row_no, 2, 'Col 3', price from ordered)"""


@query("table_to_markdown", f"with {MARKDOWN} select chunk_id, file_name, content from tbl")
def _(s, d):
    return part_chunks(s, d)


@query("markdown_cells", f"with {MARKDOWN} select chunk_id, cast(row_no as integer) as row_no, cast(col as integer) as col, label, value from cells")
def _(s, d):
    return tables.markdown_cells(part_chunks(s, d))


@query("parse_number", f"with {MARKDOWN} select chunk_id, cast(row_no as integer) as row_no, cast(col as integer) as col, -try_cast(value as double) as number from cells")
def _(s, d):
    c = tables.markdown_cells(part_chunks(s, d))
    return c.select("chunk_id", "row_no", "col", T.parse_number(F.concat(F.lit("(₹"), F.col("value"), F.lit(")"))).alias("number"))


def table_questions(s, d, query, most=5):
    """(questions, chunks, their rows by score): each table is asked the same kind of question, a column over the chunks."""
    c = part_chunks(s, d)
    q = c.select(F.col("chunk_id").alias("query_id"), query.alias("query"))
    own = c.select(F.col("chunk_id").alias("query_id"), "chunk_id", F.lit(1.0).alias("score"))
    return q, c, tables.rank_rows(q, c, own, most)


def last_part():
    """The question about the size of a table's last part."""
    return F.concat(F.lit("what size has part "), F.regexp_extract("content", r"Part (\d+) [^\n]*$", 1), F.lit(", by name?"))


_TABLE_TERMS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({}), '[^a-z0-9₹$%.''-]+'), lambda w: regexp_replace(w, '^[''.-]+|[''.-]+$', '', 'g')), lambda w: length(w) > 2 and not list_contains([" + ", ".join(f"'{w}'" for w in T.TABLE_STOP_WORDS) + "], w)))"
ROWS_RANKED = f"""{MARKDOWN}, asked as (select chunk_id, {_TABLE_TERMS.format("'what size has part ' || p_partkey || ', by name?'")} as q from ordered qualify row_number() over (partition by chunk_id order by row_no desc) = 1),
shared as (select t.chunk_id, q, len(list_intersect(q, {_TABLE_TERMS.format("file_name || ' ' || content")})) as n from tbl t join asked using (chunk_id)),
norm as (select chunk_id, row_no, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) as l, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) as v from cells),
told as (select c.chunk_id, c.row_no, any_value(n) + count(*) filter (where len(list_filter(q, lambda t: contains(v, t) or contains(l, t))) > 0) as row_score from norm c join shared using (chunk_id) group by all),
best as (select *, row_number() over (partition by chunk_id order by row_score desc, row_no) as place from told where row_score > 0 qualify place <= 5)"""


@query("table_extreme", f"""with {MARKDOWN}, n as (select *, try_cast(value as double) as number from cells where row_no in (0, 1, 2, 3, 4))
select chunk_id as query_id, 'Part ' || o.p_partkey || ' — ' || n.label || ': ' || n.value || ' (Source: ' || chunk_id || '.txt)' as answer
from n join ordered o using (chunk_id, row_no) where number is not null qualify row_number() over (partition by chunk_id order by number desc, row_no, col) = 1""")
def _(s, d):
    q, _, rows = table_questions(s, d, F.lit("which part has the highest size or col 3"))
    return tables.extremes(rows, q)


@query("rank_table_rows", f"with {ROWS_RANKED} select chunk_id as query_id, cast(place as integer) as place, chunk_id, chunk_id || '.txt' as file_name, cast(row_no as integer) as row_no, cast(row_score as integer) as row_score from best")
def _(s, d):
    return table_questions(s, d, last_part())[2].drop("cells", "headers")


@query("table_facts", f"with {ROWS_RANKED} select chunk_id as query_id, string_agg('- ' || chunk_id || '.txt: Part ' || p_partkey || ' | Name: Part ' || p_partkey || ' | Size: ' || p_size || ' | Col 3: ' || price, chr(10) order by place) as facts from best join ordered using (chunk_id, row_no) group by chunk_id")
def _(s, d):
    return tables.facts(table_questions(s, d, last_part())[2])


# G
@query("session_rollup", with_("messages") + "select session_id, count(*) as message_count, max(created_at) as updated_at from messages group by session_id")
def _(s, d):
    return chat.session_rollup(X.messages(s, d))


@query("session_titles", with_("messages") + "select s.id, case when id % 5 = 0 then 'Kept' when t is null then 'New Chat' when length(left(t, 45)) = 45 then left(t, 45) || '…' else t end as title from (select distinct session_id as id from messages) s left join (select session_id, arg_min(content, turn) as t from messages where role = 'user' group by session_id) m on m.session_id = s.id")
def _(s, d):
    m = X.messages(s, d)
    sessions = m.select(F.col("session_id").alias("id")).distinct().select("id", F.when(F.col("id") % 5 == 0, "Kept").otherwise(chat.UNTITLED).alias("title"), F.lit(0).alias("message_count"))
    return chat.session_titles(m, sessions)


@query("session_recency", with_("messages") + "select recency, count(*) as sessions from (select session_id, case max(turn) % 4 when 2 then 'Today' when 1 then 'Yesterday' else 'Earlier' end as recency from messages where session_id % 7 <> 0 group by session_id) group by recency")
def _(s, d):
    se = X.messages(s, d).groupBy("session_id").agg(F.max("turn").alias("t")).select(F.col("session_id").alias("id"), (F.col("session_id") % 7 == 0).alias("is_pinned"), F.timestamp_seconds(F.unix_seconds(F.lit("2024-03-01 12:00:00").cast("timestamp")) + (F.col("t") % 4) * 86400).alias("updated_at"))
    return chat.session_recency(se, F.lit("2024-03-03 09:00:00").cast("timestamp")).groupBy("recency").agg(F.count("*").alias("sessions"))


@query("purge_empty_sessions", "select distinct conv_id as id from conversations where role = 'system'")
def _(s, d):
    m = X.messages(s, d)
    return chat.purge_empty(m.select(F.col("session_id").alias("id")).distinct(), m.where("role = 'system'"))


@query("truncate_from_message", with_("messages") + ", a as (select session_id, max(turn) as turn from messages where role = 'assistant' group by session_id), p as (select session_id, turn, lag(role) over (partition by session_id order by turn) as asked, lag(turn) over (partition by session_id order by turn) as cut from messages), c as (select session_id, cut from p join a using (session_id, turn) where asked = 'user') select m.id, m.session_id from messages m left join c using (session_id) where c.cut is null or m.turn < c.cut")
def _(s, d):
    m = X.messages(s, d)
    answers = m.where("role = 'assistant'").groupBy("session_id").agg(F.max("turn").alias("turn"))
    return chat.truncate_from(m, chat.regenerate_cuts(m, answers)).select("id", "session_id")


@query("agent_steps_codec", with_("messages") + "select session_id, count(*) as steps, string_agg(role || '::turn ' || turn, '|' order by turn) as raw from messages group by session_id")
def _(s, d):
    m = X.messages(s, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("type"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("description")))).alias("s"))
    m = m.select("session_id", chat.encode_steps(F.transform("s", lambda x: F.struct(x.type, x.description))).alias("raw"))
    return m.select("session_id", F.size(chat.decode_steps(F.col("raw"))).cast("long").alias("steps"), "raw")


@query("strip_thinking", with_("messages") + """, t as (select id, content, regexp_replace(content, '^\\s+', '') as bare from messages)
select id, 'Before ' || case when bare = '' then '' when regexp_matches(bare, '\\s$') then bare else bare || ' ' end || 'after' as visible, 'a' || chr(10) || 'b|x|y|open' as reasoning from t""")
def _(s, d):
    text = F.concat(F.lit("Before <think>a\nb</think> "), "content", F.lit("<think>x</think> <|channel>thoughty<channel|> after <think>open"))
    return X.messages(s, d).select("id", chat.visible_text(text).alias("visible"), F.array_join(chat.reasoning_text(text), "|").alias("reasoning"))


@query("current_user_message", with_("messages") + "select session_id, regexp_replace(list_last(list_filter(string_split(string_agg(role || ': ' || replace(content, chr(10), ' '), chr(10) order by turn), chr(10)), lambda x: starts_with(x, 'user:'))), '^user:\\s*|\\s+$', '', 'g') as asked from messages group by session_id having bool_or(role = 'user')")
def _(s, d):
    m = X.messages(s, d)
    p = m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.concat_ws(": ", x.role, F.regexp_replace(x.content, "\n", " "))), "\n").alias("p"), F.bool_or(F.col("role") == "user").alias("asks"))
    return p.where("asks").select("session_id", chat.current_user_message(F.col("p")).alias("asked"))


@query("history_window", with_("messages") + ", w as (select * from messages qualify row_number() over (partition by session_id order by turn desc) <= 4), l as (select *, max(case when role = 'user' then turn end) over (partition by session_id) as latest from w) select session_id, coalesce(string_agg(role || ': ' || content, chr(10) order by turn) filter (where turn is distinct from latest), '') as history from l group by session_id")
def _(s, d):
    return chat.history_window(X.messages(s, d), 4)  # sessions here have eight turns at most


@query("history_budget", with_("messages") + ", w as (select session_id, turn, sum(len(regexp_split_to_array(content, '\\s+'))) over (partition by session_id order by turn desc rows between unbounded preceding and current row) as words from messages) select session_id, turn, cast(words as bigint) as words from w where words <= 300")
def _(s, d):
    return chat.history_budget(X.messages(s, d), 300)


# sessions ask their last user message with the ten messages before as history and the first blocks of the document of
# their number as evidence; a prompt has 512 tokens
@query("prompt_history", with_("messages", "chunks") + f""", w as (select * from messages qualify row_number() over (partition by session_id order by turn desc) <= 10), l as (select *, max(case when role = 'user' then turn end) over (partition by session_id) as latest from w),
h as (select session_id as query_id, coalesce(string_agg(role || ': ' || content, chr(10) order by turn) filter (where turn is distinct from latest), '') as history, coalesce(arg_max(content, turn) filter (where role = 'user'), '') as query from l group by session_id),
used as (select doc_id as query_id, sum({_WORDS.format("'[Source: ' || file_name || ', relevance: ' || printf('%.2f', 1.0 / (1 + chunk_index)) || ']' || chr(10) || content")}) + count(*) - 1 as used from chunks where chunk_index < 2 group by doc_id),
fixed as (select h.query_id, history, {len(INSTRUCTIONS.split())} + {_WORDS.format("query")} + coalesce(used, 0) as fixed from h left join used using (query_id)),
parts as (select query_id, fixed, unnest(string_split(history, chr(10))) as line, unnest(range(len(string_split(history, chr(10))))) as pos from fixed),
upto as (select query_id, pos, regexp_replace(line, '\\s+$', '') as line, fixed + sum({_WORDS.format("line")}) over (partition by query_id order by pos desc rows between unbounded preceding and current row) as upto from parts where not regexp_matches(line, '^\\s*$')),
told as (select query_id, string_agg(line, chr(10) order by pos) as history, max(upto) as words from upto where floor(upto * 1.3) <= 512 group by query_id)
select f.query_id, coalesce(t.history, '') as history, cast(floor(coalesce(words, fixed) * 1.3) as bigint) as tokens from fixed f left join told t using (query_id)""")
def _(s, d):
    m = X.messages(s, d)
    asked = m.where("role = 'user'").groupBy("session_id").agg(F.max_by("content", "turn").alias("query"))
    q = chat.history_window(m).join(asked, "session_id", "left").select(F.col("session_id").alias("query_id"), "query", F.lit(None).cast("string").alias("note"), "history")
    blocks = X.chunks(s, d).where("chunk_index < 2").select(F.col("doc_id").alias("query_id"), "file_name", "content", (1 / (1 + F.col("chunk_index"))).alias("score"))
    return context.budgeted_history(q, blocks, INSTRUCTIONS, 700, 60)


# H: the twenty best chunks of each question by vectors, each content once, and the first ten of these; a fifth of the
# questions ended before it had any final chunks. A question expects the first chunks of its document and, every other
# one, the hash of the first one too; every third has no evidence, and some have sub-queries. A question without a vector
# has no hits.
RANKED = f"""{QUESTIONS}, {VECTOR_HITS},
retrieved as (select v.query_id, v_rank as rank, chunk_id, md5(c.content) as hash, c.doc_id, c.group_id from v join chunks c using (chunk_id)),
deduped as (select * replace (row_number() over (partition by query_id order by rank) as rank) from (select * from retrieved qualify row_number() over (partition by query_id, hash order by rank) = 1)),
final as (select * from deduped where rank <= 10 and query_id // 20 % 5 <> 4),
trace as (select * from final union all select query_id, rank, chunk_id, null, null, null from deduped where query_id not in (select query_id from final)),
expected as (select doc_id as query_id, 'id' as kind, chunk_id as value from chunks where doc_id % 20 = 0 and doc_id % 60 <> 0 and chunk_index < 3
  union select doc_id, 'hash', md5(content) from chunks where doc_id % 40 = 0 and doc_id % 60 <> 0 and chunk_index = 0
  union select doc_id, 'doc', cast(doc_id + k as varchar) from documents, (values (0), (20)) as t(k) where doc_id % 20 = 0 and doc_id % 60 <> 0),
t as (select r.*, i.value is not null as is_id, h.value is not null as is_hash, o.value is not null as is_doc, case when h.value is not null then 'hash:' || r.hash when i.value is not null then 'id:' || r.chunk_id end as key from trace r
  left join expected i on i.query_id = r.query_id and i.kind = 'id' and i.value = r.chunk_id left join expected h on h.query_id = r.query_id and h.kind = 'hash' and h.value = r.hash left join expected o on o.query_id = r.query_id and o.kind = 'doc' and o.value = cast(r.doc_id as varchar)),
e as (select query_id, count(*) filter (where kind = 'id') as n_id, count(*) filter (where kind = 'hash') as n_hash, count(*) filter (where kind = 'doc') as n_doc from expected group by query_id),
f as (select query_id, {", ".join(f"greatest(count(distinct chunk_id) filter (where is_id and rank <= {k}), count(distinct hash) filter (where is_hash and rank <= {k})) as h_{k}" for k in (3, 5, 10))},
  count(distinct key) filter (where rank <= 5) as keys_5, count(*) filter (where rank <= 5) as n_5, min(rank) filter (where key is not null) as first, count(distinct doc_id) filter (where is_doc) as docs, count(group_id) > count(distinct group_id) as grouped from t group by query_id),
g as (select query_id, sum(1 / log2(r + 1)) as dcg from (select query_id, key, min(rank) as r from t where key is not null and rank <= 5 group by all) group by query_id),
j as (select q.query_id, case when coalesce(n_hash, 0) > 0 then n_hash else coalesce(n_id, 0) end as asked, coalesce(n_id, 0) + coalesce(n_hash, 0) = 0 as empty, * exclude (query_id) from questions q left join e using (query_id) left join f using (query_id) left join g using (query_id)),
scores as (select query_id, {", ".join(f"case when empty then 1 else least(1, coalesce(h_{k}, 0) / asked) end as recall_{k}" for k in (3, 5, 10))},
  case when coalesce(n_5, 0) = 0 then (case when empty then 1 else 0 end) else keys_5 / n_5 end as precision_5, case when empty then 1 else coalesce(1.0 / first, 0) end as mrr,
  case when empty then 1 when coalesce(n_5, 0) = 0 then 0 else coalesce(dcg, 0) / list_sum(list_transform(range(1, least(asked, n_5) + 1), lambda i: 1 / log2(i + 1))) end as ndcg_5, case when not empty and first is not null then 1.0 else 0.0 end as hit,
  case when coalesce(n_doc, 0) = 0 then 1 else coalesce(docs, 0) / n_doc end as per_doc_recall, case when query_id // 20 % 2 = 0 or coalesce(n_id, 0) = 0 or query_id in (select r.query_id from retrieved r join expected i on i.query_id = r.query_id and i.kind = 'id' and i.value = r.chunk_id) then 1.0 else 0.0 end as sub_query_coverage, coalesce(grouped, false) as group_expansion_hit from j)"""


def traces(s, d):
    """(retrieved, deduped, final)."""
    _, v = vector_side(s, d)
    c = X.chunks(s, d).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("content_hash"), "doc_id", "group_id")
    hits = v.join(c, "chunk_id").select("query_id", "rank", "chunk_id", "content_hash", "doc_id", "group_id")
    retrieved, deduped, final = evaluate.stages(written(hits, "hits"))
    return retrieved, deduped, final.where(F.floor(F.col("query_id") / 20) % 5 != 4)


@query("trace_stages", with_("chunks") + f""", {RANKED}, ids_1 as (select query_id, string_agg(chunk_id, ',' order by rank) as retrieved_ids from retrieved group by query_id), ids_2 as (select query_id, string_agg(chunk_id, ',' order by rank) as deduped_ids from deduped group by query_id),
ids_3 as (select query_id, string_agg(chunk_id, ',' order by rank) as final_ids, string_agg(hash, ',' order by rank) as final_hashes from final group by query_id)
select query_id, retrieved_ids, deduped_ids, coalesce(final_ids, '') as final_ids, coalesce(final_hashes, '') as final_hashes from ids_1 join ids_2 using (query_id) left join ids_3 using (query_id)""")
def _(s, d):
    retrieved, deduped, final = traces(s, d)
    hashes = final.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content_hash"))).alias("l")).select("query_id", F.array_join("l.content_hash", ",").alias("final_hashes"))
    ids = evaluate.trace_ids(retrieved, deduped, final).join(hashes, "query_id", "left")
    return ids.select("query_id", *[F.array_join(c, ",").alias(c) for c in ("retrieved_ids", "deduped_ids", "final_ids")], F.coalesce("final_hashes", F.lit("")).alias("final_hashes"))


def scores(s, d):
    c = X.chunks(s, d).where("doc_id % 20 = 0 and doc_id % 60 <> 0")
    of = lambda df, kind, value: df.select(F.col("doc_id").alias("query_id"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    docs = X.table(s, d, "documents").where("doc_id % 20 = 0 and doc_id % 60 <> 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(20))).alias("k"))
    expected = of(c.where("chunk_index < 3"), "id", F.col("chunk_id")).unionByName(of(c.where("doc_id % 40 = 0 and chunk_index = 0"), "hash", F.md5(F.col("content").cast("binary")))).unionByName(of(docs, "doc", F.col("doc_id") + F.col("k")))
    samples = hybrid_questions(s, d).select("query_id", (F.floor(F.col("query_id") / 20) % 2).cast("int").alias("sub_queries"))
    retrieved, deduped, final = traces(s, d)
    return evaluate.retrieval_scores(evaluate.evidence(deduped, final), expected, samples, retrieved)


for _name, _cols in {"recall_at_k": ["recall_3", "recall_5", "recall_10"], "precision_at_5": ["precision_5"], "mrr": ["mrr"], "ndcg_at_5": ["ndcg_5"], "hit_doc_subquery_scores": ["hit", "per_doc_recall", "sub_query_coverage"]}.items():
    _more = ["group_expansion_hit"] if _name == "hit_doc_subquery_scores" else []
    O[_name] = with_("chunks") + f", {RANKED} select query_id, {', '.join([f'round(cast({c} as double), 6) as {c}' for c in _cols] + _more)} from scores"
    Q[_name] = (lambda cols, more: lambda s, d: scores(s, d).select("query_id", *[F.round(c, 6).alias(c) for c in cols], *more))(_cols, _more)


@query("stage_latency", "with t as (select user_id as query_id, event_type as stage, cast(sum(cast(floor(abs(value)) as bigint)) as bigint) as ms from events group by all) select * from t union all select query_id, 'total', cast(sum(ms) as bigint) from t group by query_id")
def _(s, d):
    e = X.table(s, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.floor(F.abs("value")).cast("long")).alias("ms"))
    return evaluate.stage_latency(e.groupBy(F.col("user_id").alias("query_id")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ms"))).alias("latency")))


#: A run's samples with all their scores; the judged ones are shares of the documents' lengths, latencies come from events.
SCORED = RANKED + """, ms as (select user_id as query_id, cast(sum(cast(floor(abs(value)) as bigint)) as bigint) as latency from events group by user_id),
scored as (select s.*, (d.n_chars % 101) / 100 as faithfulness, (d.n_chars % 11) / 10 as correctness, coalesce(latency, 0) as latency_ms, q.query as question from scores s join documents d on d.doc_id = s.query_id join questions q using (query_id) left join ms using (query_id)),
summary as (select count(*) as sample_count, round(avg(recall_5), 6) as recall, round(avg(per_doc_recall), 6) as per_doc_recall, round(avg(mrr), 6) as mrr, round(avg(faithfulness), 6) as faithfulness, round(avg(correctness), 6) as correctness,
  (select latency_ms from (select latency_ms, row_number() over (order by latency_ms) - 1 as i, count(*) over () as n from scored) where i = floor((n - 1) * 0.95)) as p95_latency from scored)"""


def scored(s, d):
    ms = X.table(s, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.sum(F.floor(F.abs("value")).cast("long")).alias("latency"))
    judged = X.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), (F.col("n_chars") % 101 / 100).alias("faithfulness"), (F.col("n_chars") % 11 / 10).alias("correctness"))
    got = scores(s, d).join(judged, "query_id").join(hybrid_questions(s, d).withColumnRenamed("query", "question"), "query_id").join(ms, "query_id", "left")
    return got.withColumn("latency_ms", F.coalesce("latency", F.lit(0)).cast("long"))


def rounded(summary):
    return summary.select("sample_count", *[F.round(m, 6).alias(m) for m in evaluate.MEANS], "p95_latency")


@query("eval_summary", with_("chunks") + f", {SCORED} select * from summary")
def _(s, d):
    return rounded(evaluate.summarize(scored(s, d)))


BASELINE = {"recall": 0.99, "per_doc_recall": 0.5, "mrr": 0.5, "faithfulness": 0.6, "correctness": 0.9, "p95_latency": 100.0}
_FALLS = [f"select '{m}' as metric, cast({m} as double) as value, {v}::double as was from summary where {m} {'> ' + str(v) + ' * (1 + 0.3)' if m == 'p95_latency' else '< ' + str(v) + ' - ' + str(evaluate.TOLERANCES[m])}" for m, v in BASELINE.items() if m in evaluate.TOLERANCES]


@query("baseline_gate", with_("chunks") + f", {SCORED} " + " union all ".join(_FALLS))
def _(s, d):
    # of literals: rows of createDataFrame come from Python workers of their own on every executor
    base = s.range(1).select(F.explode(F.create_map(*[F.lit(x) for row in BASELINE.items() for x in row])).alias("metric", "value"))
    return evaluate.gate(evaluate.metrics(rounded(evaluate.summarize(scored(s, d)))), base)


_PERCENT = "cast(cast(floor({} * 100 + 0.5) as bigint) as varchar) || '%'"


@query("lowest_recall", with_("chunks") + f""", {SCORED}, lines as (select unnest(['| Metric | Value |', '|---|---:|', '| Recall@5 | ' || {_PERCENT.format("recall")} || ' |', '| Multi-doc recall | ' || {_PERCENT.format("per_doc_recall")} || ' |', '| MRR | ' || {_PERCENT.format("mrr")} || ' |',
  '| Faithfulness | ' || {_PERCENT.format("faithfulness")} || ' |', '| Correctness | ' || {_PERCENT.format("correctness")} || ' |', '| Latency p95 | ' || p95_latency || ' ms |']) as line, unnest(range(8)) as line_no from summary)
select cast(line_no as integer) as line_no, line from lines union all select cast(7 + row_number() over (order by recall_5, query_id) as integer), '- `' || query_id || '` ' || {_PERCENT.format("recall_5")} || ': ' || question from scored qualify row_number() over (order by recall_5, query_id) <= 10""")
def _(s, d):
    got = scored(s, d)
    return evaluate.report(rounded(evaluate.summarize(got)), got)


SAMPLED = """single as (select chunk_id, row_number() over (order by md5('seed' || chunk_id), chunk_id) - 1 as no from chunks),
tab as (select chunk_id, row_number() over (order by md5('table' || chunk_id), chunk_id) - 1 as no from chunks where chunk_index % 3 = 1 or contains(content, ' | ') or starts_with(content, 'Table')),
doc as (select n.no, doc_id, row_number() over (partition by n.no order by md5('pair' || n.no || doc_id), doc_id) as place from (select distinct doc_id from chunks) cross join (select unnest(range(20)) as no) n),
own as (select no, place, chunk_id from doc join chunks using (doc_id) where place <= 2 qualify row_number() over (partition by no, doc_id order by md5('pair' || no || chunk_id), chunk_id) = 1)"""


@query("sample_chunks", with_("chunks") + f", {SAMPLED} select 'single' as kind, chunk_id as chunks from single where no < 20 union all select 'table', chunk_id from tab where no < 20 union all select 'pair', string_agg(chunk_id, ',' order by place) from own group by no")
def _(s, d):
    c = X.chunks(s, d).select("chunk_id", "doc_id", "content", F.when(F.col("chunk_index") % 3 == 1, F.col("group_id")).alias("group_id"))
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("chunk_id").alias("chunks"))
    pairs = evaluate.pair_sample(c, 20, "pair").groupBy("no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x.chunk_id), ",").alias("chunks"))
    return one("single", evaluate.seeded_sample(c, "chunk_id", 20, "seed")).unionByName(one("table", evaluate.table_sample(c, 20, "table"))).unionByName(pairs.select(F.lit("pair").alias("kind"), "chunks"))


QUERIES, ORACLES = Q, O
