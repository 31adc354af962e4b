"""Traces of runs, judged scores and generated evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators.store import content_hash

# Version and instruction in a judge prompt's key, phrases of unnatural questions, words that ask to compute.
CACHE_VERSION = "structured-v1"
JUDGE_INSTRUCTION = "You are a strict RAG evaluator. Use the structured JSON schema exactly."
UNNATURAL = [
    "provided chunks", "expected chunks", "chunk 1", "chunk 2", "first chunk", "second chunk", "associated numerical identifier",
    "based on the provided documents",
]
CALCULATIONS = ["sum", "combined", "total of", "difference", "increase", "decrease", "highest", "lowest", "largest", "smallest"]
SCORES = ["faithfulness", "correctness", "citationCorrectness", "refusalCorrectness"]
SAMPLE = (
    "id string, type string, question string, expected_chunk_ids array<string>, expected_doc_ids array<string>, gold_answer string, "
    "rationale string, difficulty string, expected_route string, expected_refusal boolean"
)
TRACE = "struct<queryId:string,route:string,finalChunkIds:array<string>,totalLatencyMs:bigint>"


def trace_chunks(hits: DataFrame, preview: int = 600) -> DataFrame:
    """hits (query_id, rank, chunk_id, content, …) with the content's hash and its first `preview` characters for it."""
    return hits.withColumn("content_hash", content_hash(F.col("content"))).withColumn("content_preview", F.substring("content", 1, preview)).drop("content")


def trace_rollup(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, chunk_id, retrieval_source, expression) to one row per question: counts of vector and lexical
    hits and of expressions, hits by source, ids in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id.cast("string")), ",")
    per = hits.groupBy("query_id", "retrieval_source").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "retrieval_source", F.col("n").cast("string")))).alias("s"))
    source = F.col("retrieval_source")
    got = hits.groupBy("query_id").agg(F.count_if(source.isin("hybrid", "vector", "vector_fallback")).alias("vector_hits"), F.count_if(source.isin("hybrid", "lexical")).alias("lexical_hits"), F.countDistinct("expression").alias("expressions"), ids.alias("chunk_ids"))
    return got.join(per, "query_id").select("query_id", "vector_hits", "lexical_hits", "expressions", "chunk_ids", F.array_join("s", ",").alias("sources"))


def evidence_order(final: Column, deduped: Column) -> Column:
    """The final list, else the one without repeats."""
    return F.when(F.size(F.coalesce(final, F.array().cast("array<string>"))) > 0, final).otherwise(F.coalesce(deduped, F.array().cast("array<string>")))


def judge_prompts(samples: DataFrame, evidence: DataFrame) -> DataFrame:
    """samples (query_id, question, gold_answer, expected_refusal, answer), evidence (query_id, rank, chunk_id, file_name,
    preview) to (query_id, prompt); a sample without evidence has an empty context."""
    part = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit(" | "), F.col("file_name"), F.lit("]\n"), F.col("preview"))
    context = evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x.p), "\n\n---\n\n").alias("context"))
    sections = [("Question:\n", "question"), ("Gold answer:\n", "gold_answer"), ("Expected refusal: ", "expected_refusal"), ("Retrieved context:\n", "context"), ("Answer:\n", "answer")]
    parts = [F.concat(F.lit(head), F.coalesce(F.col(c).cast("string"), F.lit(""))) for head, c in sections]
    return samples.join(context, "query_id", "left").select("query_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def judge_key(prompt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{CACHE_VERSION}\n{JUDGE_INSTRUCTION}\n\n"), prompt).cast("binary"), 256)


def judge_cache_misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts (query_id, prompt) whose key is not in cache(key)."""
    return prompts.withColumn("key", judge_key(F.col("prompt"))).join(cache.select("key"), "key", "left_anti").select("query_id", "key")


def judge_score(raw: Column) -> Column:
    """The outermost JSON object of a response as a struct; null unless it has all fields, scores of 0 to 1 and a rationale."""
    schema = ", ".join(f"{s} double" for s in SCORES) + ", rationale string"
    got = F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), schema)
    valid = T.trimmed(got["rationale"]) != ""
    for s in SCORES:
        valid = valid & got[s].between(0, 1)
    return F.when(valid, got)


def resolve_scores(samples: DataFrame, cached: DataFrame, fresh: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per sample the first valid one of three responses (query_id, raw), else zeros and the reason."""
    got = samples.select("query_id")
    for name, side in (("cached", cached), ("fresh", fresh), ("fallback", fallback)):
        got = got.join(side.select("query_id", judge_score(F.col("raw")).alias(name)), "query_id", "left")
    best = F.coalesce("cached", "fresh", "fallback")
    came = F.when(F.col("cached").isNotNull(), "cached").when(F.col("fresh").isNotNull(), "fresh").when(F.col("fallback").isNotNull(), "fallback").otherwise("missing")
    return got.select("query_id", came.alias("source"), *[F.coalesce(best[s], F.lit(0.0)).alias(s) for s in SCORES], F.coalesce(best["rationale"], F.lit("Judge output missing after retries")).alias("rationale"))


def score_run(samples: DataFrame, traces: DataFrame, *scores: DataFrame) -> DataFrame:
    """Samples that have a trace, with the columns of every score table (query_id, …); missing scores stay null."""
    got = samples.join(traces, "query_id")
    for s in scores:
        got = got.join(s, "query_id", "left")
    return got


def is_natural(question: Column) -> Column:
    """None of the phrases that only generated questions have, and at most one `col n`."""
    return ~T.has_any(question, UNNATURAL) & (F.regexp_count(F.lower(question), F.lit(r"\bcol\s*\d+\b")) <= 1)


def generated_item(raw: Column) -> Column:
    """question, goldAnswer, rationale and difficulty from the JSON between the outer braces; where that can't be read,
    with stray backslashes removed; null if it still can't or lacks question or answer."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    schema = "question string, goldAnswer string, rationale string, difficulty string"
    parsed = [F.from_json(b, schema) for b in (body, F.regexp_replace(body, r'\\([^"\\/bfnrtu])', "$1"))]
    whole = [F.when(p["question"].isNotNull() & p["goldAnswer"].isNotNull(), p) for p in parsed]
    got = F.coalesce(*whole)
    return F.when(got.isNotNull(), F.struct(got["question"].alias("question"), got["goldAnswer"].alias("gold_answer"), F.coalesce(got["rationale"], F.lit("")).alias("rationale"), F.coalesce(got["difficulty"], F.lit("medium")).alias("difficulty")))


def build_samples(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """items (id, type, question, gold_answer), chunks (id, place, chunk_id, doc_id, content) to samples with expected ids,
    hashes and documents, route, kind of source and whether it asks to compute. Types: single_hop, multi_hop,
    table_lookup, adversarial; an adversarial item has no chunks and is refused."""
    is_table = F.exists(F.split("content", "\n"), lambda x: F.startswith(T.trimmed(x), F.lit("|")))
    c = chunks.withColumn("h", content_hash(F.col("content"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "h"))).alias("l"), F.array_sort(F.collect_set("doc_id")).alias("docs"), F.bool_or(is_table).alias("table"))
    got = items.join(c, "id", "left")
    kind = F.when(F.col("type") == "adversarial", "adversarial").when((F.col("type") == "table_lookup") | ((F.col("type") == "single_hop") & F.col("table")), "table").when((F.col("type") == "multi_hop") & (F.size("docs") > 1), "multi_doc").otherwise("narrative")
    none = F.array().cast("array<string>")
    refused = F.col("type") == "adversarial"
    return got.select(
        "id", "type", "question", "gold_answer", F.coalesce(F.transform("l", lambda x: x.chunk_id), none).alias("expected_chunk_ids"), F.coalesce(F.transform("l", lambda x: x.h), none).alias("expected_content_hashes"),
        F.coalesce(F.transform("docs", lambda x: x.cast("string")), none).alias("expected_doc_ids"), F.when(F.col("type").isin("single_hop", "adversarial"), "SINGLE_SHOT").otherwise("AGENTIC").alias("expected_route"),
        refused.alias("expected_refusal"), kind.alias("source_type"), (~refused & T.has_any(F.col("question"), CALCULATIONS)).alias("requires_calculation"),
    )


def valid_samples(samples: DataFrame, chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """samples (id, expected_refusal, expected_chunk_ids): refusals without evidence; others whose evidence in chunks
    (chunk_id, content) isn't blank and whose verdict (id, response) holds YES."""
    refused = samples.where(F.col("expected_refusal") & (F.size("expected_chunk_ids") == 0)).select("id")
    told = chunks.where(T.trimmed(F.col("content")) != "").select("chunk_id")
    asked = samples.where(~F.col("expected_refusal")).select("id", F.explode("expected_chunk_ids").alias("chunk_id")).join(told, "chunk_id", "left_semi").select("id").distinct()
    return refused.unionByName(asked.join(verdicts.where(F.contains(F.upper("response"), F.lit("YES"))).select("id"), "id", "left_semi"))


def read_dataset(raw: DataFrame, *keys: str) -> DataFrame:
    """raw (json, keys) of evaluation sets to one row per sample with its set's keys and version; unknown fields are ignored,
    missing ones get defaults."""
    got = raw.select(*keys, F.from_json("json", f"version string, description string, samples array<struct<{SAMPLE.replace(' ', ':').replace(',:', ',')}>>").alias("d"))
    got = got.select(*keys, F.coalesce("d.version", F.lit("v1")).alias("version"), F.inline("d.samples"))
    none = F.array().cast("array<string>")
    defaults = {"expected_chunk_ids": none, "expected_doc_ids": none, "gold_answer": F.lit(""), "rationale": F.lit(""), "difficulty": F.lit("medium"), "expected_refusal": F.lit(False)}
    return got.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def read_run(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """raw (json) of run artifacts to traces (run_id, query_id, route, chunk_ids, latency_ms), answers (run_id, query_id,
    answer) and documents (run_id, doc_id, chunk_count, status)."""
    schema = f"runId string, manifest struct<documents:array<struct<docId:string,chunkCount:bigint,status:string>>>, traces array<struct<sampleId:string,trace:{TRACE}>>, answers array<struct<sampleId:string,answer:string>>"
    got = raw.select(F.from_json("json", schema).alias("r")).select(F.col("r.runId").alias("run_id"), "r.*")
    t = got.select("run_id", F.explode("traces").alias("t")).select("run_id", F.col("t.sampleId").alias("query_id"), F.col("t.trace.route").alias("route"), F.col("t.trace.finalChunkIds").alias("chunk_ids"), F.col("t.trace.totalLatencyMs").alias("latency_ms"))
    a = got.select("run_id", F.explode("answers").alias("a")).select("run_id", F.col("a.sampleId").alias("query_id"), "a.answer")
    d = got.select("run_id", F.explode("manifest.documents").alias("d")).select("run_id", F.col("d.docId").alias("doc_id"), F.col("d.chunkCount").alias("chunk_count"), "d.status")
    return t, a, d
