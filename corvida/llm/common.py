"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only in local mode, where one machine is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What each open scratch() has to remove.
_OPEN: list[list["Cut"]] = []


class Cut:
    """A table written to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation of what lies before it."""

    def __init__(self, df: DataFrame, name: str, keep: bool = False):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for made in _OPEN[-1:] if not keep else []:
            made.append(self)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return Cut(df, name).df


@contextmanager
def scratch() -> Iterator[None]:
    """Tables cut inside are removed at the end, so whatever is to stay must be written before that. A query that returns
    a plan over such tables can't remove them: they stay in the shared folder, whose owner clears it after the job."""
    _OPEN.append([])
    try:
        yield
    finally:
        for made in _OPEN.pop():
            made.drop()


def unused(stem: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while stem.lower() in taken:
        stem = f"{stem}_"
    return stem


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % modulus


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, the same on every run and every partitioning."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(df: DataFrame, stratum: str, key: Column, per_stratum: int, max_strata: int = 256) -> DataFrame:
    """About per_stratum rows of each stratum (all, where it has fewer), picked by a hash of the key.

    One counting pass yields a hash threshold for each stratum, so no stratum is gathered in one task. The most
    frequent max_strata strata are used. The expected size is at most per_stratum * max_strata rows.
    """
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(max_strata).collect()
    if not counts:
        return df.limit(0)
    wanted = F.lit(False)
    for value, n in counts:
        wanted = wanted | ((F.col(stratum) == F.lit(value)) & (unit_hash(key, F.lit("sample")) < F.lit(min(1.0, per_stratum / n))))
    return df.where(wanted)
