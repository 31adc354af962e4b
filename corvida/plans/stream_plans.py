"""Streams over the given tables, run to the end of what is there; the query returns the table that the stream left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.sources import fixtures as X
from corvida.sources.fixtures import with_
from corvida.sources.folders import shared_folder
from corvida.streaming import streams as S

Q, O = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], O[name] = f, sql
        return f

    return keep


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream. A table may be one file or a folder of them; a stream takes either by a pattern only."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _last(counts: DataFrame, path: str, key: str) -> DataFrame:
    """What a stream of grouped results gave last."""
    S.keep_latest(counts, f"{path}/table", [key], f"{path}/state").awaitTermination()
    return S.results(counts.sparkSession, f"{path}/table", ", ".join(f"{c} {t}" for c, t in counts.dtypes)).read().select(*counts.columns)


#: A document's lines come in two parts, the first of half its blocks. While a document waits for the second, those of one
#: collection are cancelled; those of another are cancelled when done; a part that isn't text comes for those of a third.
CANCELLED_EARLY, CANCELLED_LATE, BROKEN = "src3", "src5", "src4"
LEFT = f"source not in ('{CANCELLED_EARLY}', '{CANCELLED_LATE}', '{BROKEN}')"


def blocks_of_lines(text: str | None) -> list[str]:
    """Blocks of four lines; a null text is an error."""
    lines = text.split("\n")
    return ["\n".join(lines[i : i + X.BLOCK]) for i in range(0, len(lines), X.BLOCK)]


def ingested(s, d):
    """The folder of an ingestion in three runs of one stream: first parts; cancels, second parts and first parts once more;
    late cancels."""
    path = folder(s)
    lines = F.split("text", "\n")
    first = F.floor((F.size(lines) + X.BLOCK - 1) / X.BLOCK / 2).cast("int") * X.BLOCK
    docs = X.texts(s, d).where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", lines.alias("lines"), first.alias("first"))
    event = lambda df, seq, kind, text: df.select("doc_id", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"), at(F.lit(seq)))
    of = lambda source: docs.where(F.col("source") == source)
    opening = event(docs.where("first > 0"), 1, "PART", F.array_join(F.expr("slice(lines, 1, first)"), "\n"))
    closing = event(docs, 3, "LAST", F.when(F.col("source") != BROKEN, F.array_join(F.expr("slice(lines, first + 1, size(lines))"), "\n")))
    steps = [opening, event(of(CANCELLED_EARLY), 2, "CANCEL", F.lit(None)).unionByName(closing).unionByName(opening), event(of(CANCELLED_LATE), 4, "CANCEL", F.lit(None))]
    for step in steps:
        step.write.mode("append").parquet(f"{path}/events")
        events = s.readStream.schema(step.schema).parquet(f"{path}/events")
        S.ingest(events, blocks_of_lines, path, f"{path}/state").awaitTermination()
    return path


@query("stream_ingest", with_("chunks") + f"select c.doc_id, c.chunk_index, c.content from chunks c where {LEFT.replace('source', 'collection_id')}")
def _(s, d):
    return S.ingest_tables(s, ingested(s, d))[0].read().select("doc_id", "chunk_index", "content")


@query("stream_ingest_status", with_("docs") + f"select id as doc_id, case when collection_id = '{BROKEN}' then 'FAILED' else 'READY' end as status, case when collection_id = '{BROKEN}' then 0 else chunk_count end as chunks from docs where collection_id not in ('{CANCELLED_EARLY}', '{CANCELLED_LATE}')")
def _(s, d):
    return S.ingest_tables(s, ingested(s, d))[1].read().select("doc_id", "status", "chunks")


@query("stream_collection_counts", "select source as collection_id, count(*) as documents, cast(sum((len(string_split(text, chr(10))) + 3) // 4) as bigint) as chunks from documents group by source")
def _(s, d):
    docs = stream(s, d, "documents").select("doc_id", F.col("source").alias("collection_id"), F.floor((F.size(F.split("text", "\n")) + X.BLOCK - 1) / X.BLOCK).cast("long").alias("chunk_count"), at("doc_id"))
    return _last(S.collection_counts(S.once(docs, ["doc_id"], "at", "3650 days")), folder(s), "collection_id")


def at(seconds):
    """When a row came, which the tables don't tell: so many seconds after the start."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(X.START)) + (F.col(seconds) if isinstance(seconds, str) else seconds)).alias("at")


@query("stream_session_activity", with_("messages") + "select session_id, count(*) as message_count, max(created_at) as updated_at from messages group by session_id")
def _(s, d):
    got = stream(s, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("created_at"), "turn")
    return _last(S.session_activity(S.once(got.select("*", at("created_at")), ["session_id", "turn"], "at", "3650 days")), folder(s), "session_id")


# each message between marks, cut every seven characters
@query("stream_thinking_split", with_("messages") + "select id as message_id, 'seen ' || content as visible, 'thought ' || content as reasoning from messages where content is not null")
def _(s, d):
    m = stream(s, d, "conversations").where("text is not null").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.concat(F.lit("seen <think>thought "), "text", F.lit("</think>"), "text").alias("t"))
    last = F.floor((F.length("t") - 1) / 7).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("seq"), F.substring(F.col("t"), i * 7 + 1, F.lit(7)).alias("text"), (i == last).alias("is_last")))
    path = folder(s)
    parts = S.thinking_split(m.select("message_id", F.explode(cuts).alias("f")).select("message_id", "f.*"))
    parts.writeStream.format("parquet").option("path", f"{path}/parts").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    both = s.read.schema(parts.schema).parquet(f"{path}/parts").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "is_reasoning", "text"))).alias("p"))
    text = lambda keep: F.array_join(F.transform(F.filter("p", keep), lambda p: p.text), "")
    return both.select("message_id", text(lambda p: ~p.is_reasoning).alias("visible"), text(lambda p: p.is_reasoning).alias("reasoning"))


@query("stream_eval_progress", with_("questions", "gold") + "select count(*) as samples, avg(hit) as recall, avg(hit) as mrr from (select query_id, case when query_id in (select query_id from gold) then 1.0::double else 0.0::double end as hit from questions)")
def _(s, d):
    path = folder(s)
    found = X.gold(s, d).select("query_id").distinct().withColumn("hit", F.lit(1.0))
    hit = F.coalesce("hit", F.lit(0.0))
    score = lambda b: b.select(F.col("item_id").cast("long").alias("query_id")).join(found, "query_id", "left").select("query_id", hit.alias("recall"), hit.alias("mrr"))
    S.eval_progress(stream(s, d, "benchmark"), score, f"{path}/scores", f"{path}/state").awaitTermination()
    return S.eval_summary(s, f"{path}/scores")


QUERIES, ORACLES = Q, O
