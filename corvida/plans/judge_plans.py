"""Queries over traces, judged scores and generated evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import evaluate, judging
from corvida.operators import retrieve as R
from corvida.operators import store as S
from corvida.plans.retrieve_plans import SIDES, hybrid_questions, sides
from corvida.plans.shape_plans import PAIRS, RANKED, pairs, scores, traces
from corvida.plans.store_plans import FNV, HASHED
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


@query("trace_chunks", with_("chunks", "lines") + f", {PAIRS}, hashed as (select *, {FNV.format('lower(trim(content))')} as h from pairs) select query_id, rank, chunk_id, {HASHED.format('h')} as content_hash, left(content, 600) as content_preview from hashed")
def _(s, d):
    return judging.trace_chunks(pairs(s, d).select("query_id", "rank", "chunk_id", "content"))


@query("trace_rollup", with_("chunks") + f""", {SIDES}, t as (select h.*, case when retrieval_source in ('hybrid', 'lexical') then array_to_string(list_transform(list_filter(terms, lambda t: not regexp_matches(t, '[-&]')), lambda t: t || '*'), ' OR ') end as expression from h join terms using (query_id) where rank <= 5),
n as (select query_id, retrieval_source, count(*) as n from t group by all), p as (select query_id, string_agg(retrieval_source || ':' || n, ',' order by retrieval_source) as sources from n group by query_id)
select query_id, count(*) filter (where retrieval_source in ('hybrid', 'vector', 'vector_fallback')) as vector_hits, count(*) filter (where retrieval_source in ('hybrid', 'lexical')) as lexical_hits, count(distinct expression) as expressions, string_agg(cast(chunk_id as varchar), ',' order by rank) as chunk_ids, any_value(sources) as sources from t join p using (query_id) group by query_id""")
def _(s, d):
    q, v, x = sides(s, d)
    h = R.hybrid(q, v, x).join(q, "query_id")
    return judging.trace_rollup(h.withColumn("expression", F.when(F.col("retrieval_source").isin("hybrid", "lexical"), T.match_expression(F.col("query")))))


@query("evidence_order", with_("chunks") + ", t as (select doc_id as query_id, coalesce(list(chunk_id order by chunk_index) filter (where chunk_index > 2), []) as final, list(chunk_id order by chunk_index) as deduped from chunks group by doc_id) select query_id, array_to_string(case when len(final) > 0 then final else deduped end, ',') as evidence from t")
def _(s, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x)
    t = X.chunks(s, d).groupBy(F.col("doc_id").alias("query_id")).agg(ids.alias("l"))
    t = t.select("query_id", F.transform(F.filter("l", lambda x: x.chunk_index > 2), lambda x: x.chunk_id).alias("final"), F.transform("l", lambda x: x.chunk_id).alias("deduped"))
    return t.select("query_id", F.array_join(judging.evidence_order(F.col("final"), F.col("deduped")), ",").alias("evidence"))


PROMPTS = f"""{PAIRS}, e as (select query_id, string_agg('[' || chunk_id || ' | ' || file_name || ']' || chr(10) || left(content, 600), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from pairs group by query_id),
sm as (select doc_id as query_id, line as question, 'gold ' || doc_id as gold_answer, doc_id % 5 = 0 as expected_refusal, 'answer ' || doc_id as answer from lines where line_no = 0),
prompts as (select query_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Gold answer:' || chr(10) || gold_answer || chr(10) || chr(10) || 'Expected refusal: ' || expected_refusal || chr(10) || chr(10)
  || 'Retrieved context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Answer:' || chr(10) || answer as prompt from sm left join e using (query_id))"""


def prompts(s, d):
    i = F.col("doc_id").cast("string")
    samples = X.lines(s, d).where("line_no = 0").select(F.col("doc_id").alias("query_id"), F.col("line").alias("question"), F.concat(F.lit("gold "), i).alias("gold_answer"), (F.col("doc_id") % 5 == 0).alias("expected_refusal"), F.concat(F.lit("answer "), i).alias("answer"))
    evidence = pairs(s, d).select("query_id", "rank", "chunk_id", "file_name", F.substring("content", 1, 600).alias("preview"))
    return judging.judge_prompts(samples, evidence)


@query("judge_prompts", with_("chunks", "lines") + f", {PROMPTS} select * from prompts")
def _(s, d):
    return prompts(s, d)


KEY = "sha256('" + judging.CACHE_VERSION + "' || chr(10) || '" + judging.JUDGE_INSTRUCTION + "' || chr(10) || chr(10) || prompt)"


@query("judge_cache_misses", with_("chunks", "lines") + f", {PROMPTS} select query_id, {KEY} as key from prompts where {KEY} not in (select {KEY} from prompts where query_id % 3 = 0)")
def _(s, d):
    p = prompts(s, d)
    return judging.judge_cache_misses(p, p.where("query_id % 3 = 0").select(judging.judge_key(F.col("prompt")).alias("key")))


#: Responses of a judge with a document's whole text for a rationale: good ones, one without a field, one out of range, one
#: with a blank rationale, one without JSON.
RAW = """raw as (select doc_id as query_id, case doc_id % 5 when 0 then translate(text, '{}', '')
  when 1 then '{"faithfulness": 0.5, "correctness": 1, "citationCorrectness": 0, "rationale": ' || to_json(text) || '}'
  when 2 then 'x {"faithfulness": 0.5, "correctness": 1.5, "citationCorrectness": 0, "refusalCorrectness": 1, "rationale": ' || to_json(text) || '}'
  when 3 then '{"faithfulness": 0.5, "correctness": 1, "citationCorrectness": 0, "refusalCorrectness": 1, "rationale": " "}'
  else 'Here: {"faithfulness": 0.' || n_chars % 10 || ', "correctness": 0.25, "citationCorrectness": 1, "refusalCorrectness": 0, "rationale": ' || to_json(text) || '} done' end as raw from documents)"""


def json_text(name: str):
    """`"name":"…"}`: the end of an object whose last field holds the text."""
    return F.expr(f"substring(to_json(named_struct('{name}', text)), 2)")


def raw(s, d):
    i = F.col("doc_id")
    good = F.concat(F.lit('Here: {"faithfulness": 0.'), (F.col("n_chars") % 10).cast("string"), F.lit(', "correctness": 0.25, "citationCorrectness": 1, "refusalCorrectness": 0, '), json_text("rationale"), F.lit(" done"))
    lacking = F.concat(F.lit('{"faithfulness": 0.5, "correctness": 1, "citationCorrectness": 0, '), json_text("rationale"))
    beyond = F.concat(F.lit('x {"faithfulness": 0.5, "correctness": 1.5, "citationCorrectness": 0, "refusalCorrectness": 1, '), json_text("rationale"))
    blank = F.lit('{"faithfulness": 0.5, "correctness": 1, "citationCorrectness": 0, "refusalCorrectness": 1, "rationale": " "}')
    text = F.when(i % 5 == 0, F.translate("text", "{}", "")).when(i % 5 == 1, lacking).when(i % 5 == 2, beyond).when(i % 5 == 3, blank).otherwise(good)
    return X.texts(s, d).select(i.alias("query_id"), text.alias("raw"))


NAMES = ", ".join(f"try_cast(j->>'{x}' as double) as {x}" for x in judging.SCORES)
VALID = f"""{RAW}, j as (select query_id, try_cast(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') as json) as j from raw), f as (select query_id, {NAMES}, j->>'rationale' as rationale from j),
valid as (select * from f where {' and '.join(f'{x} between 0 and 1' for x in judging.SCORES)} and regexp_replace(rationale, '^\\s+|\\s+$', '', 'g') <> '')"""


@query("judge_scores_valid", f"with {VALID} select * from valid")
def _(s, d):
    return raw(s, d).select("query_id", judging.judge_score(F.col("raw")).alias("j")).where("j is not null").select("query_id", "j.*")


@query("judge_scores_resolved", f"""with {VALID}, m as (select query_id - 1 as query_id, faithfulness, correctness, citationCorrectness, refusalCorrectness, rationale from valid)
select d.doc_id as query_id, case when v.query_id is not null then 'cached' when m.query_id is not null then 'fresh' else 'missing' end as source, {', '.join(f'coalesce(v.{x}, m.{x}, 0) as {x}' for x in judging.SCORES)}, coalesce(v.rationale, m.rationale, 'Judge output missing after retries') as rationale
from documents d left join valid v on v.query_id = d.doc_id left join m on m.query_id = d.doc_id""")
def _(s, d):
    r = raw(s, d)
    return judging.resolve_scores(r, r, r.select((F.col("query_id") - 1).cast("int").alias("query_id"), "raw"), r.where("query_id % 5 = 0"))


@query("score_run", with_("chunks") + f", {RANKED}, r as (select query_id, count(*) as hits from trace group by query_id) select query_id, hits, round(cast(recall_5 as double), 6) as recall_5, round(cast(mrr as double), 6) as mrr from r join scores using (query_id)")
def _(s, d):
    _, deduped, final = traces(s, d)
    runs = evaluate.evidence(deduped, final).groupBy("query_id").agg(F.count("*").alias("hits"))
    return judging.score_run(hybrid_questions(s, d).select("query_id"), runs, scores(s, d).select("query_id", F.round("recall_5", 6).alias("recall_5"), F.round("mrr", 6).alias("mrr")))


ENDINGS = ["", " under col 3 and col 4", " in the first chunk", " of Chunk 1", " Col 2"]


@query("natural_questions", f"""with q as (select conv_id * 1000 + turn as query_id, text || [{', '.join(repr(x) for x in ENDINGS)}][(conv_id + turn) % {len(ENDINGS)} + 1] as question from conversations)
select query_id from q where len(list_filter([{', '.join(repr(x) for x in judging.UNNATURAL)}], lambda x: contains(lower(question), x))) = 0 and len(regexp_extract_all(lower(question), '\\bcol\\s*\\d+\\b')) <= 1""")
def _(s, d):
    c = X.table(s, d, "conversations")
    end = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), ((F.col("conv_id") + F.col("turn")) % len(ENDINGS) + 1).cast("int"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", end).alias("q")).where(judging.is_natural(F.col("q"))).select("query_id")


@query("generated_item_parse", "select doc_id, case doc_id % 3 when 1 then 'cost of 5% ' else '' end || text as question, source as gold_answer, '' as rationale, case doc_id % 3 when 0 then 'hard' else 'medium' end as difficulty from documents where doc_id % 3 <> 2 and text is not null and source is not null")
def _(s, d):
    good = F.expr("to_json(named_struct('question', text, 'goldAnswer', source, 'difficulty', 'hard', 'unknown', 1))")
    wrong = F.concat(F.lit('Item: {"question": "cost of 5\\% '), F.expr("substring(to_json(named_struct('question', text)), 14, length(to_json(named_struct('question', text))) - 14)"), F.lit(", "), F.expr("substring(to_json(named_struct('goldAnswer', source)), 2)"))
    r = X.texts(s, d).where("text is not null").select("doc_id", F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, wrong).otherwise(F.concat(F.lit("{broken "), F.translate("text", "{}", ""))).alias("raw"))
    return r.select("doc_id", judging.generated_item(F.col("raw")).alias("g")).where("g is not null").select("doc_id", "g.*")


TYPES = "i as (select item_id as id, ['single_hop', 'multi_hop', 'table_lookup', 'adversarial'][item_id % 4 + 1] as type, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') || case when item_id % 3 = 0 then ' combined' else '' end as question, 'g' || item_id as gold_answer from benchmark)"


def items(s, d):
    i = F.col("item_id")
    b = X.table(s, d, "benchmark")
    kinds = F.array(*[F.lit(x) for x in ("single_hop", "multi_hop", "table_lookup", "adversarial")])
    it = b.select(i.alias("id"), F.element_at(kinds, (i % 4 + 1).cast("int")).alias("type"), F.concat(F.array_join(F.slice(F.split("text", " "), 1, 6), " "), F.when(i % 3 == 0, " combined").otherwise("")).alias("question"), F.concat(F.lit("g"), i.cast("string")).alias("gold_answer"))
    # evidence: the first chunk of the document with the item's id, and for several hops that of the next one
    c = X.chunks(s, d).where("chunk_index = 0").select("doc_id", "chunk_id", "content")
    wanted = it.where("type <> 'adversarial'").select("id", F.explode(F.when(F.col("type") == "multi_hop", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("place")).withColumn("doc_id", F.col("id") + F.col("place"))
    return it, wanted.join(c, "doc_id")


BUILT = f"""c0 as (select doc_id, chunk_id, {FNV.format('lower(trim(content))')} as h from chunks where chunk_index = 0), c as (select doc_id, chunk_id, {HASHED.format('h')} as hash from c0), w as (select id, unnest(case when type = 'multi_hop' then [0, 1] else [0] end) as place from i where type <> 'adversarial'), e as (select w.id, string_agg(chunk_id, ',' order by place) as ids, string_agg(hash, ',' order by place) as hashes, string_agg(cast(doc_id as varchar), ',' order by doc_id) as docs, count(*) as n from w join c on c.doc_id = w.id + w.place group by w.id)"""


@query("build_samples", with_("chunks") + f""", {TYPES}, {BUILT}, q as (select *, len(list_filter([{', '.join(repr(x) for x in judging.CALCULATIONS)}], lambda x: contains(lower(question), x))) > 0 as computes from i)
select q.id, type, question, gold_answer, coalesce(ids, '') as expected_chunk_ids, coalesce(hashes, '') as expected_content_hashes, coalesce(docs, '') as expected_doc_ids, case when type in ('single_hop', 'adversarial') then 'SINGLE_SHOT' else 'AGENTIC' end as expected_route, type = 'adversarial' as expected_refusal,
  case when type = 'adversarial' then 'adversarial' when type = 'table_lookup' then 'table' when type = 'multi_hop' and n > 1 then 'multi_doc' else 'narrative' end as source_type, type <> 'adversarial' and computes as requires_calculation from q left join e using (id)""")
def _(s, d):
    got = judging.build_samples(*items(s, d))
    return got.withColumns({c: F.array_join(c, ",") for c in ("expected_chunk_ids", "expected_content_hashes", "expected_doc_ids")})


@query("validate_samples", with_("chunks") + f", {TYPES}, {BUILT} select id from i left join e using (id) where type = 'adversarial' or (n > 0 and id % 5 <> 0 and exists (select 1 from chunks k where k.chunk_index = 0 and k.doc_id between i.id and i.id + case when type = 'multi_hop' then 1 else 0 end and regexp_replace(k.content, '^\\s+|\\s+$', '', 'g') <> ''))")
def _(s, d):
    it, ev = items(s, d)
    samples = judging.build_samples(it, ev)
    verdicts = it.select("id", F.when(F.col("id") % 5 == 0, "No").otherwise("Yes.").alias("response"))
    return judging.valid_samples(samples, ev.select("chunk_id", "content"), verdicts)


#: Sets of 50 items, each one JSON document; every third has no version.
@query("eval_dataset_json", "select item_id // 50 as set_no, cast(item_id as varchar) as id, case when item_id % 2 = 0 then text else '' end as gold_answer, 'medium' as difficulty, false as expected_refusal, case when item_id // 50 % 3 = 0 then 'v1' else 'v' || item_id // 50 end as version from benchmark")
def _(s, d):
    i = F.col("item_id")
    one = F.struct(i.cast("string").alias("id"), F.lit("single_hop").alias("type"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("question"), F.when(i % 2 == 0, F.col("text")).alias("gold_answer"), F.lit(1).alias("unknown"))
    sets = X.table(s, d, "benchmark").groupBy(F.floor(i / 50).cast("long").alias("set_no")).agg(F.collect_list(one).alias("samples"))
    json = sets.select("set_no", F.to_json(F.struct(F.when(F.col("set_no") % 3 > 0, F.concat(F.lit("v"), F.col("set_no").cast("string"))).alias("version"), "samples")).alias("json"))
    return judging.read_dataset(json, "set_no").select("set_no", "id", "gold_answer", "difficulty", "expected_refusal", "version")


@query("run_artifacts_json", with_("messages") + "select cast(session_id as varchar) as run_id, cast(turn as varchar) as query_id, role as route, id as chunk_ids, turn * 10 as latency_ms, content as answer from messages")
def _(s, d):
    t = F.col("turn").cast("string")
    trace = F.struct(t.alias("sampleId"), F.struct(t.alias("queryId"), F.col("role").alias("route"), F.array("id").alias("finalChunkIds"), (F.col("turn") * 10).alias("totalLatencyMs"), F.lit("x").alias("unknown")).alias("trace"))
    runs = X.messages(s, d).groupBy("session_id").agg(F.collect_list(trace).alias("traces"), F.collect_list(F.struct(t.alias("sampleId"), F.col("content").alias("answer"))).alias("answers"))
    traces, answers, _ = judging.read_run(runs.select(F.to_json(F.struct(F.col("session_id").cast("string").alias("runId"), "traces", "answers")).alias("json")))
    return traces.join(answers, ["run_id", "query_id"]).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


QUERIES, ORACLES = Q, O
