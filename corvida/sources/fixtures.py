"""Tables of the retrieval model derived from the given ones, with the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work on their texts. A table whose files give fewer splits than there are cores (one row group is
    one task, however long) is dealt over the cores; what moves is a split a core at most. A larger one is read as it lies."""
    d, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(texts(spark, sf_dir))


def blocks(documents: DataFrame) -> DataFrame:
    """Blocks of four lines; the first block of a document heads its group and is its section."""
    d = documents.withColumn("l", F.split("text", "\n"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / BLOCK).cast("int")), lambda i: F.array_join(F.slice("l", i * BLOCK + 1, F.lit(BLOCK)), "\n"))
    got = d.select("doc_id", "source", "lang", F.posexplode(blocks).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    head = F.col("chunk_index") == 0
    doc = F.col("doc_id").cast("string")
    return got.select(
        F.concat_ws("_", doc, F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", F.concat("source", F.lit(".txt")).alias("file_name"), "chunk_index", "content",
        F.col("source").alias("collection_id"), F.col("lang").alias("hierarchy_path"), F.when(head, "SECTION").otherwise("TEXT").alias("chunk_type"),
        F.concat(F.lit("g"), doc).alias("group_id"), head.alias("is_group_head"), F.when(~head, F.concat(doc, F.lit("_0"))).alias("parent_chunk_id"), F.concat(F.lit("s"), doc).alias("section_id"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("file_name"), F.col("source").alias("collection_id"),
        F.floor((F.size(F.split("text", "\n")) + BLOCK - 1) / BLOCK).cast("long").alias("chunk_count"), F.when(F.length("text") > 0, "READY").otherwise("FAILED").alias("status"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.col("doc_id").cast("long").alias("created_at"),
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").cast("long").alias("created_at")).select(F.col("source").alias("id"), F.lit(False).alias("is_default"), "created_at")
    return own.unionByName(spark.sql("select id, is_default, created_at from values ('default-collection', true, 0L), ('empty-collection', false, 999999999L) as t(id, is_default, created_at)"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve words of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("query"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) of documents that hold a passage whole. A passage's first three words and a document's windows
    of three words meet in an equi-join before the texts are compared."""
    key = lambda c: F.array_join(F.slice(F.split(c, r"\s+"), 2, 3), " ")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), key("text").alias("key"))
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(3)), " "))
    keys = F.element_at(F.transform(F.array(F.split("text", r"\s+")), windows), 1)
    d = texts(spark, sf_dir).select("doc_id", "text")
    # windows carry ids alone; the texts come back for the documents that share a key with a passage
    held = d.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).join(b.select("key").distinct(), "key", "left_semi")
    offered = held.join(b, "key").select("query_id", "doc_id", "passage").distinct()
    return offered.join(d, "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id").distinct()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.col("text").alias("content"), (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("created_at"),
    )


#: The same tables in SQL, to stand in a WITH clause.
SQL = {
    "lines": "lines as (select doc_id, source, lang, i as line_no, string_split(text, chr(10))[i + 1] as line from (select *, unnest(range(len(string_split(text, chr(10))))) as i from documents))",
    "chunks": """chunks as (select doc_id || '_' || i as chunk_id, doc_id, source || '.txt' as file_name, i as chunk_index,
      array_to_string(list_slice(string_split(text, chr(10)), i * 4 + 1, i * 4 + 4), chr(10)) as content, source as collection_id, lang as hierarchy_path,
      case when i = 0 then 'SECTION' else 'TEXT' end as chunk_type, 'g' || doc_id as group_id, i = 0 as is_group_head,
      case when i > 0 then doc_id || '_0' end as parent_chunk_id, 's' || doc_id as section_id
      from (select *, unnest(range((len(string_split(text, chr(10))) + 3) // 4)) as i from documents))""",
    "docs": """docs as (select doc_id as id, source || '.txt' as file_name, source as collection_id, (len(string_split(text, chr(10))) + 3) // 4 as chunk_count,
      case when length(text) > 0 then 'READY' else 'FAILED' end as status, cast(strlen(text) as bigint) as size_bytes, cast(doc_id as bigint) as created_at from documents)""",
    "collections": """collections as (select source as id, false as is_default, cast(min(doc_id) as bigint) as created_at from documents group by source
      union all select 'default-collection', true, 0 union all select 'empty-collection', false, 999999999)""",
    "questions": "questions as (select item_id as query_id, array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') as query from benchmark)",
    "gold": "gold as (select distinct b.item_id as query_id, d.doc_id from documents d join benchmark b on contains(d.text, b.text))",
    "messages": "messages as (select conv_id || '_' || turn as id, conv_id as session_id, cast(turn as bigint) as turn, role, text as content, cast(conv_id as bigint) * 1000 + turn as created_at from conversations)",
}


def with_(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names) + "\n"
