"""Reading and keeping the document, chunk, collection, session and message tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_collection(documents: DataFrame, collection: str | None = None) -> DataFrame:
    """Documents of one collection (null, empty or "all": every one), newest first."""
    got = documents if collection in (None, "", "all") else documents.where(F.col("collection_id") == collection)
    return got.orderBy(F.desc("created_at"), "id")


def in_order(chunks: DataFrame, **scope: object) -> DataFrame:
    for column, value in scope.items():
        chunks = chunks.where(F.col(column) == value)
    return chunks.orderBy("doc_id", "chunk_index")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace: of the rows with a key the one with the highest version, new before old on a tie. Keys meet in
    one grouping whose partial maxima run before the shuffle."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row"))
    return latest.select(key, "_row.*").drop("_new")


def delete_cascade(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the document ids in `gone`."""
    ids = gone.select(F.col("id").alias("_gone"))
    return documents.join(ids, documents.id == F.col("_gone"), "left_anti"), chunks.join(ids, chunks.doc_id == F.col("_gone"), "left_anti")


def delete_collections(collections: DataFrame, gone: DataFrame) -> DataFrame:
    """Collections without those in `gone`; the default one always stays."""
    ids = gone.select(F.col("id").alias("_gone"))
    return collections.where("is_default").unionByName(collections.where("not is_default").join(ids, F.col("id") == F.col("_gone"), "left_anti"))


def chunk_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks and documents per collection, zero for empty ones."""
    n = documents.groupBy("collection_id").agg(F.sum("chunk_count").alias("chunks"), F.count("*").alias("documents"))
    got = collections.join(n, F.col("id") == F.col("collection_id"), "left")
    return got.select("id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.bool_and(F.col("status") == "READY"), F.lit(True)).alias("all_ready"), F.count("*").alias("documents"))


def embedded_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_count, embedded): chunks of each document and how many of them have an embedding."""
    n = chunks.groupBy("doc_id").agg(F.count_if(F.col("embedding").isNotNull()).alias("n"))
    return documents.join(n, F.col("id") == F.col("doc_id"), "left").select("id", "chunk_count", F.coalesce("n", F.lit(0)).cast("long").alias("embedded"))


def encode_path(parts: Column) -> Column:
    return F.array_join(parts, "§")


def decode_path(path: Column) -> Column:
    return F.when(F.trim(path) == "", F.array().cast("array<string>")).otherwise(F.split(path, "§"))


def backfill(old: DataFrame, current: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of an older schema brought to the current one, missing columns filled with defaults."""
    return current.limit(0).unionByName(old, allowMissingColumns=True).fillna(defaults)


def cache_misses(items: DataFrame, cache: DataFrame, text: str = "text", first: int = 8000) -> DataFrame:
    """Distinct texts whose key, the sha-256 of the first 8000 characters, is not in cache(key)."""
    keyed = items.select(F.sha2(F.substring(F.col(text), 1, first).cast("binary"), 256).alias("key")).distinct()
    return keyed.join(cache.select("key"), "key", "left_anti")


def write_csv(chunks: DataFrame, path: str) -> None:
    """Chunks as quoted CSV with a header; paths joined by " > ", quotes doubled, line ends kept inside cells."""
    chunks.select(F.col("chunk_id").alias("Chunk_ID"), F.col("token_count").alias("Token_Count"), F.col("group_id").alias("Group_ID"), F.col("is_group_head").alias("Is_Group_Head"), F.array_join("hierarchy_path", " > ").alias("Hierarchy_Path"), F.col("content").alias("Content")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark, path: str) -> DataFrame:
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("Chunk_ID string, Token_Count int, Group_ID string, Is_Group_Head boolean, Hierarchy_Path string, Content string").csv(path)
    got = got.where(F.trim(F.coalesce("Content", F.lit(""))) != "")
    return got.select(F.col("Chunk_ID").alias("chunk_id"), F.col("Token_Count").alias("token_count"), F.when(F.trim("Group_ID") != "", F.col("Group_ID")).alias("group_id"), F.coalesce("Is_Group_Head", F.lit(False)).alias("is_group_head"), F.when(F.trim("Hierarchy_Path") == "", F.array().cast("array<string>")).otherwise(F.split("Hierarchy_Path", " > ")).alias("hierarchy_path"), F.col("Content").alias("content"))


#: Fields of an exported chunk: its name, the column, the type, and what stands for a null.
EXPORT = (
    ("id", "chunk_id", "string"), ("chunkType", "chunk_type", "string"), ("parentChunkId", "parent_chunk_id", "string"), ("sectionId", "section_id", "string"),
    ("groupId", "group_id", "string"), ("isGroupHead", "is_group_head", "boolean"), ("pageStart", "page_start", "int"), ("pageEnd", "page_end", "int"),
    ("tokenCount", "token_count", "int"), ("hierarchyPath", "hierarchy_path", "array<string>"), ("bbox", "bbox", "array<struct<page:int,x:double,y:double,width:double,height:double>>"),
    ("rowRange", "row_range", "struct<start:bigint,end:bigint>"), ("content", "content", "string"),
)


def export_json(chunks: DataFrame) -> DataFrame:
    """(json): one object of 13 fields per chunk (columns as in EXPORT), nulls written, no boxes as an empty array."""
    boxes = F.coalesce("bbox", F.array().cast(dict((n, t) for n, _, t in EXPORT)["bbox"]))
    fields = [(boxes if c == "bbox" else F.col(c)).alias(n) for n, c, _ in EXPORT]
    return chunks.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def import_json(exported: DataFrame) -> DataFrame:
    got = exported.select(F.from_json("json", ", ".join(f"{n} {t}" for n, _, t in EXPORT)).alias("r"))
    return got.select(*[F.col(f"r.{n}").alias(c) for n, c, _ in EXPORT])


def export_csv(chunks: DataFrame) -> DataFrame:
    """The 13 fields as CSV columns: paths joined by " > ", boxes and row range as JSON, nulls as empty text."""
    as_text = {"hierarchy_path": lambda c: F.array_join(c, " > "), "bbox": lambda c: F.coalesce(F.to_json(c), F.lit("[]")), "row_range": lambda c: F.to_json(c)}
    names = {"bbox": "bboxJson", "rowRange": "rowRangeJson"}
    return chunks.select(*[F.coalesce(as_text.get(c, lambda x: x.cast("string"))(F.col(c)), F.lit("")).alias(names.get(n, n)) for n, c, _ in EXPORT])


def decode_blob(blob: Column) -> Column:
    """Little-endian float32 bytes to array<float>; null for null."""

    @F.pandas_udf("array<float>")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4")[: len(b) // 4])

    return of(blob)


def encode_blob(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return of(vector)


GRID = 1 << 24


def content_hash(text: Column) -> Column:
    """FNV-1a, 64 bits, over the UTF-8 bytes of the trimmed lower-case text, as signed hex. Texts of like length step
    together, byte place by byte place, in wrapping 64-bit arithmetic; a grid of them holds GRID bytes at most, or one text."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        raw = [None if t is None else t.strip().lower().encode() for t in texts]
        order = sorted((i for i, b in enumerate(raw) if b is not None), key=lambda i: -len(raw[i]))
        out: list[str | None] = [None] * len(raw)
        at = 0
        while at < len(order):
            part = order[at : at + max(1, GRID // max(1, len(raw[order[at]])))]
            at += len(part)
            size = np.array([len(raw[i]) for i in part])
            grid = np.zeros((len(part), int(size.max()) if len(part) else 0), dtype=np.uint8)
            for r, i in enumerate(part):
                grid[r, : size[r]] = np.frombuffer(raw[i], dtype=np.uint8)
            h = np.full(len(part), 0xCBF29CE484222325, dtype=np.uint64)
            for c in range(grid.shape[1]):
                n = int(np.searchsorted(-size, -c, side="left"))
                h[:n] = (h[:n] ^ grid[:n, c]) * np.uint64(0x100000001B3)
            for i, v in zip(part, h.view(np.int64).tolist(), strict=True):
                out[i] = format(v, "x")
        return pd.Series(out, dtype=object)

    return of(text)


def manifest(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: status, chunk count, size and the content hashes of its chunks in order."""
    hashes = chunks.select("doc_id", "chunk_index", content_hash(F.col("content")).alias("h")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "h"))), lambda s: s.h).alias("hashes"))
    return documents.join(hashes, documents.id == hashes.doc_id, "left").select("id", "status", "chunk_count", "size_bytes", F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))


def latest_first(table: DataFrame, *order: Column) -> DataFrame:
    return table.orderBy(*order)


def dense_ids(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """chunk_index and chunk_id = {doc}_{index} in emission order within a document."""
    w = Window.partitionBy(doc).orderBy(*order)
    got = rows.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long"))
    return got.withColumn("chunk_id", F.concat_ws("_", F.col(doc).cast("string"), F.col("chunk_index").cast("string")))
