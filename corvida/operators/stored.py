"""Tables kept in partitions: read by the partitions asked for, changed by rewriting the ones that a change touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.sources.folders import written

BUCKETS = 32


@dataclass(frozen=True)
class Stored:
    """A Parquet table at `path`, partitioned by the column `by`. `schema` is its DDL, without `by` where that is a bucket.
    Partition values are kept as text: an empty one reads back as null."""

    spark: SparkSession
    path: str
    schema: str
    by: str

    def read(self) -> DataFrame:
        """All rows; a filter on `by` reads its partitions alone."""
        return self.spark.read.schema(self.schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], self.schema)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def within(self, values: list) -> Column:
        """A filter on partitions."""
        named = F.col(self.by).isin([v for v in values if v is not None])
        return named | F.col(self.by).isNull() if None in values else named


def bucket(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def of_key(stored: Stored, key: str, value: object) -> DataFrame:
    """The rows with a value of the key that the buckets go by; its bucket alone is read."""
    kind = dict(stored.read().dtypes)[key]
    place = stored.spark.range(1).select(F.lit(value).cast(kind).alias(key)).select(bucket(key)).first()[0]
    return stored.read().where((F.col(stored.by) == place) & F.col(key).eqNullSafe(F.lit(value).cast(kind)))


def save(rows: DataFrame, path: str, by: str, spread: int = 4) -> Stored:
    """Writes rows as a new table partitioned by `by`. A partition's rows come from up to `spread` tasks, so that one value
    of very many rows is no single task."""
    stored = Stored(rows.sparkSession, path, _ddl(rows), by)
    others = [c for c in rows.columns if c != by]
    dealt = F.pmod(F.xxhash64(*others), F.lit(spread)) if others else F.lit(0)
    rows.repartition(by, dealt).write.partitionBy(by).parquet(path)
    return stored


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def touched(stored: Stored, rows: DataFrame) -> list:
    """The partitions that rows fall into: as many values at most as the driver lists folders for anyway."""
    return [r[0] for r in rows.select(stored.by).distinct().collect()]


def rewrite(stored: Stored, partitions: list, rows: DataFrame) -> None:
    """The named partitions hold these rows, in any columns' order, from now on; all others stay as they are.

    The rows are written aside first, as they may come from the partitions that they replace; a task that is lost is run
    again from there. Partitions without rows lose their files at the end. Run again with the same rows it changes nothing.
    """
    staged = written(rows.select(*[F.col(f"`{c}`") for c in stored.read().columns]), "staged")
    left = touched(stored, staged)
    empty = [p for p in partitions if p not in left]
    gone = [r[0] for r in stored.read().where(stored.within(empty)).select(F.col("_metadata.file_path")).distinct().collect()] if empty and stored.exists() else []
    if left:
        staged.repartition(stored.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(stored.by).parquet(stored.path)
    for file in gone:
        path = stored.spark._jvm.org.apache.hadoop.fs.Path(stored.spark._jvm.java.net.URI(file))
        path.getFileSystem(stored.spark._jsc.hadoopConfiguration()).delete(path, False)
    stored.spark.catalog.refreshByPath(stored.path)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, null with null."""
    test = F.lit(True)
    for k in keys:
        test = test & a[k].eqNullSafe(b[k])
    return test


def upsert(stored: Stored, rows: DataFrame, keys: list[str]) -> None:
    """rows, one for each of their keys, replace those with the same keys or are added. A key's rows lie in one partition."""
    new = written(rows, "new")
    partitions = touched(stored, new)
    if not partitions:
        return
    old = stored.read().where(stored.within(partitions))
    stay = old.join(new, same_keys(old, new, keys), "left_anti")
    rewrite(stored, partitions, stay.unionByName(new))


def delete(stored: Stored, gone: DataFrame, keys: list[str]) -> int:
    """Removes the rows with the keys of gone (keys and `by`), by rewriting the partitions that these name. Returns how
    many partitions that were."""
    ids = gone.select(*dict.fromkeys([*keys, stored.by])).distinct()
    partitions = touched(stored, ids)
    if partitions:
        old = stored.read().where(stored.within(partitions))
        rewrite(stored, partitions, old.join(ids, same_keys(old, ids, keys), "left_anti"))
    return len(partitions)


def delete_documents(documents: Stored, chunks: Stored, gone: DataFrame) -> int:
    """Documents of gone (id, and the partition column that both tables share) and their chunks, the chunks first, so that
    one broken off in between leaves no chunk without its document."""
    delete(chunks, gone.withColumnRenamed("id", "doc_id"), ["doc_id"])
    return delete(documents, gone, ["id"])
