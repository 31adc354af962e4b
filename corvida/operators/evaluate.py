"""Scores of retrieval runs: recall, precision, rank measures, latencies, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a metric may fall by (p95: grow by, as a share).
TOLERANCES = {"recall": 0.02, "per_doc_recall": 0.03, "faithfulness": 0.05, "correctness": 0.10, "p95_latency": 0.30}


def stages(hits: DataFrame, final: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retrieved, deduped, final) of hits (query_id, rank, chunk_id, content_hash, doc_id, group_id): all of them, the best
    one of each content, ranked anew, and the first `final` of those."""
    once = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "content_hash").orderBy("rank"))).where("n = 1").drop("n")
    deduped = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return hits, deduped, deduped.where(F.col("rank") <= final)


def trace_ids(retrieved: DataFrame, deduped: DataFrame, final: DataFrame) -> DataFrame:
    """One row per question with hits: retrieved_ids, deduped_ids, final_ids, each in order of rank; empty where a stage
    left none."""
    listed = None
    for name, rows in (("retrieved", retrieved), ("deduped", deduped), ("final", final)):
        ids = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l")).select("query_id", F.col("l.chunk_id").alias(f"{name}_ids"))
        listed = ids if listed is None else listed.join(ids, "query_id", "full_outer")
    return listed.select("query_id", *[F.coalesce(F.col(f"{n}_ids"), F.array().cast(dict(listed.dtypes)[f"{n}_ids"])).alias(f"{n}_ids") for n in ("retrieved", "deduped", "final")])


def evidence(deduped: DataFrame, final: DataFrame) -> DataFrame:
    """What a trace is scored by: its final chunks, or, of a question without any, the ids of its deduped ones alone."""
    bare = deduped.join(final.select("query_id").distinct(), "query_id", "left_anti")
    none = [F.lit(None).cast(dict(final.dtypes)[c]).alias(c) for c in ("content_hash", "doc_id", "group_id")]
    return final.select("query_id", "rank", "chunk_id", "content_hash", "doc_id", "group_id").unionByName(bare.select("query_id", "rank", "chunk_id", *none))


def retrieval_scores(ranked: DataFrame, expected: DataFrame, samples: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Per sample: recall_k, precision_5, mrr, ndcg_5, hit, per_doc_recall, sub_query_coverage, group_expansion_hit.

    ranked: (query_id, rank 1, 2, …, chunk_id, content_hash, doc_id, group_id), see evidence(), a bounded number for a
    sample; retrieved: (query_id, chunk_id), all that was found, by which alone sub-queries are covered; expected:
    (query_id, kind, value), kind being id, hash or doc; samples: (query_id, sub_queries), their number. A hit is relevant
    by its id or its hash, and counts once for each hash (else id). Recall is the better of both kinds over the number of
    expected hashes, or of ids without any. Without expected ids and hashes recall, mrr and ndcg are 1, precision is 1 if
    nothing was retrieved, and hit 0; without expected documents per_doc_recall is 1; without sub-queries or expected ids
    sub_query_coverage is 1.
    """
    want = expected.distinct()
    of = lambda kind, name: want.where(F.col("kind") == kind).select("query_id", F.col("value").alias(name), F.lit(True).alias(f"is_{kind}"))
    r = ranked.join(of("id", "chunk_id"), ["query_id", "chunk_id"], "left").join(of("hash", "content_hash"), ["query_id", "content_hash"], "left")
    r = r.withColumn("doc_id", F.col("doc_id").cast("string")).join(of("doc", "doc_id"), ["query_id", "doc_id"], "left")
    key = F.when(F.col("is_hash"), F.concat(F.lit("hash:"), "content_hash")).when(F.col("is_id"), F.concat(F.lit("id:"), "chunk_id"))
    r = r.withColumn("key", key)
    some = lambda test, c: F.size(F.collect_set(F.when(test, F.col(c))))
    upto = lambda k: F.col("rank") <= k
    found = r.groupBy("query_id").agg(
        *[F.greatest(some(F.col("is_id") & upto(k), "chunk_id"), some(F.col("is_hash") & upto(k), "content_hash")).alias(f"h_{k}") for k in ks],
        some(upto(5), "key").alias("keys_5"), F.count_if(upto(5)).alias("n_5"), F.min(F.when(F.col("key").isNotNull(), F.col("rank"))).alias("first"),
        some(F.col("is_doc"), "doc_id").alias("docs"),
        (F.count_if(F.col("group_id").isNotNull()) > F.size(F.collect_set("group_id"))).alias("group_expansion_hit"),
    )
    gains = r.where(F.col("key").isNotNull() & upto(5)).groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    gains = gains.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    covered = retrieved.select("query_id", "chunk_id").join(of("id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("any_id", F.lit(True))
    size = want.groupBy("query_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("id", "hash", "doc")])
    s = samples.select("query_id", "sub_queries").join(size, "query_id", "left").join(found, "query_id", "left").join(gains, "query_id", "left").join(covered, "query_id", "left")
    s = s.fillna(0, ["n_id", "n_hash", "n_doc", "n_5", "keys_5", "docs", *[f"h_{k}" for k in ks]]).fillna(0.0, ["dcg"]).fillna(False, ["any_id", "group_expansion_hit"])
    empty = (F.col("n_id") == 0) & (F.col("n_hash") == 0)
    asked = F.when(F.col("n_hash") > 0, F.col("n_hash")).otherwise(F.col("n_id"))
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= F.least(asked, "n_5")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return s.select(
        "query_id", *[F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), F.col(f"h_{k}") / asked)).alias(f"recall_{k}") for k in ks],
        F.when(F.col("n_5") == 0, F.when(empty, 1.0).otherwise(0.0)).otherwise(F.col("keys_5") / F.col("n_5")).alias("precision_5"),
        F.when(empty, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(empty, 1.0).when(ideal == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg_5"),
        F.when(~empty & F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
        F.when(F.col("n_doc") == 0, 1.0).otherwise(F.col("docs") / F.col("n_doc")).alias("per_doc_recall"),
        F.when((F.col("sub_queries") == 0) | (F.col("n_id") == 0) | F.col("any_id"), 1.0).otherwise(0.0).alias("sub_query_coverage"),
        "group_expansion_hit",
    )


#: Columns of a scored run whose means its summary holds.
MEANS = {"recall": "recall_5", "per_doc_recall": "per_doc_recall", "mrr": "mrr", "faithfulness": "faithfulness", "correctness": "correctness"}


def summarize(scored: DataFrame) -> DataFrame:
    """scored (MEANS, latency_ms) to one row: sample_count, the means, p95_latency; zeros for an empty run."""
    means = scored.agg(F.count("*").alias("sample_count"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(m) for m, c in MEANS.items()])
    p95 = index_percentile(scored, "latency_ms").withColumnRenamed("p95", "p95_latency")
    return means.join(p95)  # two tables of one row each


def metrics(summary: DataFrame) -> DataFrame:
    """A summary as (metric, value) rows, as gate() takes them."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in [*MEANS, "p95_latency"])
    return summary.selectExpr(f"stack({len(MEANS) + 1}, {pairs}) as (metric, value)")


def report(summary: DataFrame, scored: DataFrame, most: int = 10) -> DataFrame:
    """(line_no, line) of a report: a table of the summary's values, then the `most` samples (query_id, question, recall_5)
    of lowest recall, equal ones by id. Shares are whole percents, halves rounded up."""
    percent = lambda c: F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))
    names = {"recall": "Recall@5", "per_doc_recall": "Multi-doc recall", "mrr": "MRR", "faithfulness": "Faithfulness", "correctness": "Correctness"}
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    told = [F.lit("| Metric | Value |"), F.lit("|---|---:|"), *[row(n, percent(F.col(m))) for m, n in names.items()], row("Latency p95", F.concat(F.col("p95_latency").cast("string"), F.lit(" ms")))]
    head = summary.select(F.posexplode(F.array(*told)).alias("line_no", "line"))
    w = Window.orderBy("recall_5", "query_id")
    worst = scored.orderBy("recall_5", "query_id").limit(most).select((F.row_number().over(w) + len(told) - 1).alias("line_no"), F.concat(F.lit("- `"), F.col("query_id").cast("string"), F.lit("` "), percent(F.col("recall_5")), F.lit(": "), F.coalesce("question", F.lit(""))).alias("line"))
    return head.unionByName(worst)


def index_percentile(df: DataFrame, value: str, share: float = 0.95, cells: int = 1024) -> DataFrame:
    """The whole number at index trunc((n - 1) * share) of the ascending order of the non-null ones; 0 for none.

    Each pass counts the values in `cells` equal intervals and goes on in the one that holds the index, so no task orders
    them all and only `cells` counts are gathered; two or three passes do for milliseconds, seven for any long."""
    v = df.select(F.col(value).cast("long").alias("v"))
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).head()
    if n == 0:
        low = high = 0
    index = int((n - 1) * share)
    while low < high:
        width = -(-(high - low + 1) // cells)
        counts = dict(v.where(F.col("v").between(low, high)).groupBy(F.expr(f"(v - ({low}L)) div {width}L").alias("cell")).count().collect())
        for cell in sorted(counts):
            if index < counts[cell]:
                low, high = low + cell * width, min(high, low + cell * width + width - 1)
                break
            index -= counts[cell]
    return df.sparkSession.range(1).select(F.lit(low).cast("long").alias("p95"))


def stage_latency(traces: DataFrame) -> DataFrame:
    """traces: (query_id, latency map<string, bigint>) to one row per stage and one for the total."""
    stages = traces.select("query_id", F.explode("latency").alias("stage", "ms"))
    return stages.unionByName(stages.groupBy("query_id").agg(F.sum("ms").alias("ms")).withColumn("stage", F.lit("total")))


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics of current (metric, value) that fall short of baseline (metric, value) by more than the tolerance; none
    for an empty baseline."""
    both = current.join(baseline.withColumnRenamed("value", "was"), "metric")
    worse = F.lit(False)
    for metric, t in TOLERANCES.items():
        bad = F.col("value") > F.col("was") * (1 + t) if metric == "p95_latency" else F.col("value") < F.col("was") - t
        worse = worse | ((F.col("metric") == metric) & bad)
    return both.where(worse).select("metric", "value", "was")


def seeded(seed: str, *keys: Column) -> Column:
    """An order that depends on seed and keys alone, the same on every run and partitioning."""
    return F.md5(F.concat(F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the seeded order."""
    return df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def table_sample(chunks: DataFrame, n: int, seed: str) -> DataFrame:
    """As seeded_sample, of chunks that look like tables: grouped, with cells between bars, or starting with `Table`."""
    content = F.col("content")
    return seeded_sample(chunks.where(F.col("group_id").isNotNull() | F.contains(content, F.lit(" | ")) | F.startswith(content, F.lit("Table"))), "chunk_id", n, seed)


def pair_sample(chunks: DataFrame, n: int, seed: str) -> DataFrame:
    """(no, place, chunk_id): n times two chunks, one each of two documents drawn for that number; of a single document any
    two of its chunks; nothing if there are fewer than two chunks. The rank cuts run before the shuffles."""
    ids = chunks.select("doc_id", "chunk_id")
    few = ids.select("doc_id").distinct().limit(2).count() < 2
    if ids.limit(2).count() < 2:
        return ids.limit(0).select(F.lit(0).alias("no"), F.lit(0).alias("place"), "chunk_id")
    no = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("no")
    drawn = lambda by, *keys: F.row_number().over(Window.partitionBy(*by).orderBy(seeded(seed, *keys), keys[-1]))
    if few:
        return ids.select(no, "chunk_id").withColumn("place", drawn(["no"], F.col("no"), F.col("chunk_id"))).where("place <= 2").select("no", "place", "chunk_id")
    docs = ids.select("doc_id").distinct().select(no, "doc_id").withColumn("place", drawn(["no"], F.col("no"), F.col("doc_id"))).where("place <= 2")
    own = docs.join(ids, "doc_id").withColumn("n", drawn(["no", "doc_id"], F.col("no"), F.col("chunk_id"))).where("n = 1")
    return own.select("no", "place", "chunk_id")
