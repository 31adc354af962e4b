"""An inverted index of chunks: written once, kept up by inserts and deletes, and read by the buckets that a question's terms lie in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvida.operators import retrieve as R
from corvida.sources.folders import written

#: Tokens are dealt into buckets by their first two characters, which every term that finds them begins with too.
BUCKETS, PREFIX = 64, 2
#: Documents' texts are dealt into as many parts by their id.
TEXT_PARTS = 64
#: Ends the marker of a segment that replaces all before it.
ALONE = "-alone"


@dataclass(frozen=True)
class TextIndex:
    """Tables under `path`. Every insert is a segment, numbered from 0:

    postings (segment, bucket, token, chunk_id, doc_id, chunk_index), partitioned by segment and bucket, sorted by token;
    dictionary (segment, bucket, token, chunks), how many chunks of the segment hold a token, partitioned and sorted alike;
    texts (segment, part, and the chunks' own columns), partitioned by segment and part of the document;
    removed (segment, doc_id): documents whose rows in segments up to that one are gone.
    """

    spark: SparkSession
    path: str
    columns: str  # of the chunks, as DDL

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.path}/{name}")

    def schema(self, name: str) -> str:
        ids = self.types()
        return {
            "postings": f"token string, chunk_id {ids['chunk_id']}, doc_id {ids['doc_id']}, chunk_index {ids['chunk_index']}, segment int, bucket int",
            "dictionary": "token string, chunks long, segment int, bucket int",
            "texts": f"{self.columns}, segment int, part int",
            "removed": f"doc_id {ids['doc_id']}, upto int",
        }[name]

    def types(self) -> dict[str, str]:
        return dict(self.spark.createDataFrame([], self.columns).dtypes)

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def segments(self) -> list[int]:
        """Numbers of the segments that count: those with a marker, from the last one that was marked to stand for all before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        first = max((int(n.removesuffix(ALONE)) for n in names if n.endswith(ALONE)), default=0)
        return sorted(n for n in (int(n.removesuffix(ALONE)) for n in names) if n >= first)


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, PREFIX)), F.lit(BUCKETS)).cast("int")


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(TEXT_PARTS)).cast("int")


def create(chunks: DataFrame, path: str) -> TextIndex:
    """An index of chunks (chunk_id, doc_id, chunk_index, content and what else lexical scores look at)."""
    index = TextIndex(chunks.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes))
    insert(index, chunks)
    return index


def insert(index: TextIndex, chunks: DataFrame, alone: bool = False) -> int:
    """Writes the chunks as a new segment, which with `alone` replaces all before it, and returns its number. Each text is
    cut into tokens once. A segment counts from when its marker is there: what an insert that broke off has written is
    never read, and the next one, of the same number, overwrites it."""
    number = max(index.segments(), default=-1) + 1
    chosen = chunks.select(*index.types())
    postings = R.postings(chosen).withColumn("bucket", bucket_of(F.col("token")))
    _write(index, "postings", number, postings.repartition("bucket", "token").sortWithinPartitions("bucket", "token", "doc_id", "chunk_index"), "bucket")
    held = index.table("postings").where(F.col("segment") == number)
    counts = held.groupBy("bucket", "token").agg(F.count("*").alias("chunks"))
    _write(index, "dictionary", number, counts.repartition("bucket").sortWithinPartitions("bucket", "token"), "bucket")
    _write(index, "texts", number, chosen.withColumn("part", part_of(F.col("doc_id"))).repartition("part", "doc_id").sortWithinPartitions("part", "chunk_id"), "part")
    _mark(index, f"{number}{ALONE if alone else ''}")
    return number


def _write(index: TextIndex, name: str, segment: int, rows: DataFrame, by: str) -> None:
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{index.path}/{name}/segment={segment}")


def _mark(index: TextIndex, marker: str) -> None:
    path = index.spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/segments/{marker}")
    path.getFileSystem(index.spark._jsc.hadoopConfiguration()).mkdirs(path)


def delete(index: TextIndex, documents: DataFrame) -> None:
    """Removes documents (doc_id) from all segments there are; inserted again later, they are found again. Nothing is
    rewritten: what is removed is a table of its own, which readings leave out and compact() drops."""
    upto = max(index.segments(), default=-1)
    documents.select("doc_id").distinct().withColumn("upto", F.lit(upto)).write.mode("append").parquet(f"{index.path}/removed")


def live(index: TextIndex, name: str) -> DataFrame:
    """The rows of `postings` or `texts` in finished segments whose documents have not been removed since."""
    rows = index.table(name).where(F.col("segment").isin(index.segments()))
    if not index.exists("removed"):
        return rows
    gone = index.table("removed").groupBy("doc_id").agg(F.max("upto").alias("upto"))
    return rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["segment"] <= gone["upto"]), "left_anti")


def dictionary(index: TextIndex) -> DataFrame:
    """(token, chunks): how many live chunks hold each token. Counts of the segments are added up, and those of postings of
    removed documents, alone, are subtracted."""
    total = index.table("dictionary").where(F.col("segment").isin(index.segments())).select("token", "chunks")
    if index.exists("removed"):
        gone = index.table("removed").groupBy("doc_id").agg(F.max("upto").alias("upto"))
        rows = index.table("postings").where(F.col("segment").isin(index.segments()))
        lost = rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["segment"] <= gone["upto"]), "left_semi").groupBy("token").agg((-F.count("*")).alias("chunks"))
        total = total.unionByName(lost)
    return total.groupBy("token").agg(F.sum("chunks").alias("chunks")).where("chunks > 0")


def tokens_with(index: TextIndex, prefix: str) -> DataFrame:
    """(token, chunks) of the dictionary that start with a prefix of two characters at least: one bucket, in it a range."""
    if len(prefix) < PREFIX:
        raise ValueError(f"a prefix of {PREFIX} characters at least")
    bucket = index.spark.range(1).select(bucket_of(F.lit(prefix))).first()[0]
    found = index.table("dictionary").where((F.col("bucket") == bucket) & F.col("segment").isin(index.segments()) & F.startswith("token", F.lit(prefix)))
    return found.groupBy("token").agg(F.sum("chunks").alias("chunks"))


def candidates(index: TextIndex, questions: DataFrame, k: int = 5) -> DataFrame:
    """As `retrieve.lexical_candidates`, from the postings of the buckets that the terms lie in. The buckets, BUCKETS at
    most, come to the driver, so that they prune partitions of the scan."""
    asked = R.plain_terms(questions)
    wanted = [r[0] for r in asked.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect()]
    found = live(index, "postings").where(F.col("bucket").isin(wanted))
    return R.first_chunks(asked, found.select("token", "chunk_id", "doc_id", "chunk_index"), 6 * k)


def topk(index: TextIndex, questions: DataFrame, k: int = 5) -> DataFrame:
    """As `retrieve.lexical_topk` over the live chunks. No text is cut into tokens; texts are read by the parts of the
    candidates' documents, and of those the candidates' alone are scored."""
    found = written(candidates(index, questions, k), "candidates")
    parts = [r[0] for r in found.select(part_of(F.col("doc_id")).alias("part")).distinct().collect()]  # TEXT_PARTS at most
    texts = live(index, "texts").where(F.col("part").isin(parts))
    return R.scored_topk(questions, found, texts, k)


def compact(index: TextIndex) -> int:
    """Writes the live rows as one segment that replaces those before it, removes these and returns its number."""
    old = index.segments()
    number = insert(index, live(index, "texts").drop("segment", "part"), alone=True)
    for segment in old:
        for name in (f"segments/{segment}", f"segments/{segment}{ALONE}", *(f"{t}/segment={segment}" for t in ("postings", "dictionary", "texts"))):
            path = index.spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/{name}")
            path.getFileSystem(index.spark._jsc.hadoopConfiguration()).delete(path, True)
    index.spark.catalog.refreshByPath(index.path)
    return number
