"""Queries of family A: sources, sinks and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import store as S
from corvida.operators import stored
from corvida.sources import fixtures as X
from corvida.sources.fixtures import with_
from corvida.sources.folders import shared_folder

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


@query("documents_by_collection", with_("docs") + "select * from docs where collection_id = 'src1'")
def _(s, d):
    return S.by_collection(X.documents(s, d), "src1")


@query("chunks_in_order", with_("chunks") + "select chunk_id, doc_id, chunk_index, content from chunks where collection_id = 'src2'")
def _(s, d):
    return S.in_order(X.chunks(s, d), collection_id="src2").select("chunk_id", "doc_id", "chunk_index", "content")


@query("messages_by_session", with_("messages") + "select * from messages")
def _(s, d):
    return X.messages(s, d).orderBy("session_id", "created_at")


@query("upsert_latest", with_("docs") + "select id, case when chunk_count > 3 then 'READY' else status end as status, case when chunk_count > 3 then created_at + 1 else created_at end as created_at from docs")
def _(s, d):
    old = X.documents(s, d).select("id", "status", "created_at")
    new = X.documents(s, d).where("chunk_count > 3").select("id", F.lit("READY").alias("status"), (F.col("created_at") + 1).alias("created_at"))
    return S.upsert_latest(old, new, "id", "created_at")


@query("delete_cascade", with_("docs", "chunks") + "select c.chunk_id, c.doc_id from chunks c where c.doc_id not in (select id from docs where collection_id = 'src3' or chunk_count > 20)")
def _(s, d):
    docs = X.documents(s, d)
    return S.delete_cascade(docs, X.chunks(s, d), docs.where("collection_id = 'src3' or chunk_count > 20"))[1].select("chunk_id", "doc_id")


@query("delete_collections", with_("collections") + "select * from collections where is_default or id not in ('src1', 'default-collection')")
def _(s, d):
    c = X.collections(s, d)
    return S.delete_collections(c, c.where("id in ('src1', 'default-collection')"))


@query("collections_ordered", with_("collections") + "select * from collections")
def _(s, d):
    return X.collections(s, d).orderBy(F.desc("is_default"), "created_at")


SESSIONS = "select session_id as id, max(created_at) as updated_at, count(*) as message_count, session_id % 7 = 0 as is_pinned from messages group by session_id"


def sessions(s, d):
    return X.messages(s, d).groupBy("session_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("message_count")).select(F.col("session_id").alias("id"), "updated_at", "message_count", (F.col("session_id") % 7 == 0).alias("is_pinned"))


@query("sessions_ordered", with_("messages") + SESSIONS)
def _(s, d):
    return sessions(s, d).orderBy(F.desc("is_pinned"), F.desc("updated_at"))


# the same tables, written in partitions: by collection, and messages by a bucket of their session
def folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("stored_collection", with_("chunks") + "select chunk_id, doc_id, chunk_index, content from chunks where collection_id = 'src2'")
def _(s, d):
    table = stored.save(X.chunks(s, d).select("chunk_id", "doc_id", "chunk_index", "content", "collection_id"), folder(s, "chunks"), "collection_id")
    return S.in_order(table.read(), collection_id="src2").drop("collection_id")


@query("stored_session", with_("messages") + "select id, turn, role, content from messages where session_id = 3")
def _(s, d):
    table = stored.save(X.messages(s, d).withColumn("bucket", stored.bucket("session_id")), folder(s, "messages"), "bucket")
    return stored.of_key(table, "session_id", 3).select("id", "turn", "role", "content")


@query("stored_delete_cascade", with_("docs", "chunks") + ", gone as (select id from docs where collection_id = 'src3' or (collection_id = 'src4' and chunk_count > 2)) select id as doc_id, coalesce(n, 0) as chunks from docs left join (select doc_id, count(*) as n from chunks group by doc_id) c on c.doc_id = docs.id where id not in (select id from gone)")
def _(s, d):
    docs = stored.save(X.documents(s, d), folder(s, "documents"), "collection_id")
    chunks = stored.save(X.chunks(s, d).select("chunk_id", "doc_id", "content", "collection_id"), folder(s, "chunks"), "collection_id")
    stored.delete_documents(docs, chunks, docs.read().where("collection_id = 'src3' or (collection_id = 'src4' and chunk_count > 2)").select("id", "collection_id"))
    n = chunks.read().groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.read().join(n, F.col("id") == F.col("doc_id"), "left").select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query("chunk_counts", with_("docs", "collections") + "select c.id, cast(coalesce(sum(d.chunk_count), 0) as bigint) as chunks, count(d.id) as documents from collections c left join docs d on d.collection_id = c.id group by c.id")
def _(s, d):
    return S.chunk_counts(X.collections(s, d), X.documents(s, d))


@query("corpus_stats", with_("docs") + "select cast(sum(chunk_count) as bigint) as chunks, bool_and(status = 'READY') as all_ready, count(*) as documents from docs")
def _(s, d):
    return S.corpus_stats(X.documents(s, d))


@query("embedded_counts", with_("chunks", "docs") + ", n as (select doc_id, count(*) filter (where vec_id is not null) as n from chunks left join embeddings on vec_id = doc_id and chunk_index % 2 = 0 group by doc_id) select id, chunk_count, coalesce(n, 0) as embedded from docs left join n on doc_id = id")
def _(s, d):
    e = X.table(s, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    c = X.chunks(s, d).join(e, (F.col("doc_id") == F.col("v")) & (F.col("chunk_index") % 2 == 0), "left")
    return S.embedded_counts(X.documents(s, d), c)


@query("hierarchy_path_codec", with_("chunks") + "select chunk_id, collection_id || '§' || hierarchy_path as path, 2 as depth from chunks")
def _(s, d):
    p = X.chunks(s, d).select("chunk_id", S.encode_path(F.array("collection_id", "hierarchy_path")).alias("path"))
    return p.withColumn("depth", F.size(S.decode_path(F.col("path"))))


@query("schema_backfill", with_("chunks") + "select chunk_id, content, 'TEXT' as chunk_type, false as is_group_head, -1 as page_start from chunks")
def _(s, d):
    current = s.createDataFrame([], "chunk_id string, content string, chunk_type string, is_group_head boolean, page_start int")
    return S.backfill(X.chunks(s, d).select("chunk_id", "content"), current, {"chunk_type": "TEXT", "is_group_head": False, "page_start": -1})


@query("embedding_cache_misses", with_("chunks") + "select distinct sha256(left(content, 8000)) as key from chunks where sha256(left(content, 8000)) not in (select sha256(left(content, 8000)) from chunks where chunk_index = 0)")
def _(s, d):
    c = X.chunks(s, d)
    cache = c.where("chunk_index = 0").select(F.sha2(F.substring("content", 1, 8000).cast("binary"), 256).alias("key")).distinct()
    return S.cache_misses(c, cache, "content")


@query("embedding_blob_decode", "select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: abs(x))), 3) as total from (select vec_id, cast(embedding as double[]) as embedding from embeddings)")
def _(s, d):
    e = X.table(s, d, "embeddings").select("vec_id", S.decode_blob(S.encode_blob(F.col("embedding"))).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"))


#: FNV-1a over the bytes of a text, in 128-bit numbers.
FNV = "list_reduce(list_transform(list_prepend(14695981039346656037::uhugeint, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1)::uhugeint[]), lambda x: x), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
HASHED = "(case when {0} >= 9223372036854775808::uhugeint then '-' || lower(to_hex(cast(18446744073709551616::uhugeint - {0} as ubigint))) else lower(to_hex(cast({0} as ubigint))) end)"


@query("content_hash", with_("chunks") + f", h as (select chunk_id, {FNV.format('lower(trim(content))')} as h from chunks) select chunk_id, {HASHED.format('h')} as hash from h")
def _(s, d):
    return X.chunks(s, d).select("chunk_id", S.content_hash(F.col("content")).alias("hash"))


@query("ingest_manifest", with_("chunks", "docs") + f", h as (select doc_id, chunk_index, {FNV.format('lower(trim(content))')} as h from chunks), l as (select doc_id, list({HASHED.format('h')} order by chunk_index) as hashes from h group by doc_id) select id, status, chunk_count, size_bytes, coalesce(hashes, []) as hashes from docs left join l on doc_id = id")
def _(s, d):
    return S.manifest(X.documents(s, d), X.chunks(s, d))


def exported(s, d):
    """Chunks with all the columns of an export: pages and boxes by their place, parts of three with a row range."""
    n = F.col("chunk_index")
    box = F.array(F.struct(n.cast("int").alias("page"), F.lit(1.5).alias("x"), (n * 2).cast("double").alias("y"), F.lit(100.0).alias("width"), F.lit(40.0).alias("height")))
    return X.chunks(s, d).select(
        "chunk_id", "chunk_type", "parent_chunk_id", "section_id", F.when(n % 2 == 0, F.col("group_id")).alias("group_id"), "is_group_head", n.cast("int").alias("page_start"), (n + 1).cast("int").alias("page_end"),
        T.token_estimate(F.col("content")).alias("token_count"), F.array("collection_id", "hierarchy_path").alias("hierarchy_path"), F.when(n % 2 == 1, box).alias("bbox"), F.when(n % 3 == 0, F.struct(n.alias("start"), (n + 3).alias("end"))).alias("row_range"), "content",
    )


EXPORTED = """x as (select *, case when chunk_index % 2 = 0 then group_id end as g, collection_id || ' > ' || hierarchy_path as path, greatest(1, cast(floor(len(regexp_split_to_array(content, '\\s+')) * 1.3) as integer)) as tokens from chunks)"""


@query("chunk_json_export", with_("chunks") + f", {EXPORTED} select chunk_id, chunk_type, parent_chunk_id, section_id, g as group_id, is_group_head, cast(chunk_index as integer) as page_start, cast(chunk_index + 1 as integer) as page_end, tokens as token_count, path as hierarchy_path, case when chunk_index % 2 = 1 then 1 else 0 end as boxes, case when chunk_index % 2 = 1 then chunk_index * 2.0 end as box_y, case when chunk_index % 3 = 0 then chunk_index + 3 end as row_end, content from x")
def _(s, d):
    back = S.import_json(S.export_json(exported(s, d)))
    got = back.withColumn("hierarchy_path", F.array_join("hierarchy_path", " > ")).withColumn("boxes", F.size("bbox")).withColumn("box_y", F.get("bbox", F.lit(0)).y).withColumn("row_end", F.col("row_range.end"))
    return got.drop("bbox", "row_range")


@query("chunk_csv_export", with_("chunks") + f""", {EXPORTED} select chunk_id as id, chunk_type as "chunkType", coalesce(parent_chunk_id, '') as "parentChunkId", section_id as "sectionId", coalesce(g, '') as "groupId", cast(is_group_head as varchar) as "isGroupHead", cast(chunk_index as varchar) as "pageStart", cast(chunk_index + 1 as varchar) as "pageEnd", cast(tokens as varchar) as "tokenCount", path as "hierarchyPath",
  case when chunk_index % 2 = 1 then '[{{"page":' || chunk_index || ',"x":1.5,"y":' || chunk_index * 2 || '.0,"width":100.0,"height":40.0}}]' else '[]' end as "bboxJson", case when chunk_index % 3 = 0 then '{{"start":' || chunk_index || ',"end":' || chunk_index + 3 || '}}' else '' end as "rowRangeJson", content from x""")
def _(s, d):
    return S.export_csv(exported(s, d))


@query("chunk_csv_roundtrip", with_("chunks") + f", {EXPORTED} select chunk_id, tokens as token_count, g as group_id, is_group_head, path as hierarchy_path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as content from x where trim(content) <> ''")
def _(s, d):
    folder = f"{shared_folder(s)}/chunks-{uuid.uuid4().hex}"
    S.write_csv(exported(s, d), folder)
    return S.read_csv(s, folder).withColumn("hierarchy_path", F.array_join("hierarchy_path", " > ")).withColumn("content", F.regexp_replace("content", "\r\n?", "\n"))


@query("assign_chunk_ids", with_("lines") + "select doc_id, line, row_number() over (partition by doc_id order by line_no) - 1 as chunk_index, doc_id || '_' || (row_number() over (partition by doc_id order by line_no) - 1) as chunk_id from lines where line <> ''")
def _(s, d):
    return S.dense_ids(X.lines(s, d).where("line <> ''"), "doc_id", ["line_no"]).select("doc_id", "line", "chunk_index", "chunk_id")


QUERIES, ORACLES = Q, O
