"""Partitioned tables: pruning, changes that rewrite only what they touch, and running a change twice."""

import os
import re

import pytest
from pyspark.sql import functions as F

from corvida.operators import stored
from corvida.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, tmp_path):
    docs = X.documents(spark, SF)
    chunks = X.chunks(spark, SF).select("chunk_id", "doc_id", "chunk_index", "content", "collection_id")
    return stored.save(docs, str(tmp_path / "docs"), "collection_id"), stored.save(chunks, str(tmp_path / "chunks"), "collection_id")


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}


def ids(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_one_collection_is_one_partition(spark, tables):
    docs, chunks = tables
    for table in (docs, chunks):
        plan = table.read().where("collection_id = 'src1'")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[isnotnull\(collection_id#\d+\), \(collection_id#\d+ = src1\)\]", plan)
    assert ids(docs.read(), "id", "status") == ids(X.documents(spark, SF), "id", "status")


def test_a_delete_rewrites_its_partitions_alone(spark, tables):
    docs, chunks = tables
    gone = docs.read().where("collection_id = 'src3' or id in (7, 8)").select("id", "collection_id")
    partitions = {r[0] for r in gone.select("collection_id").distinct().collect()}
    lost = {r.id for r in gone.collect()}
    want = ids(X.documents(spark, SF).where(~F.col("id").isin(lost)), "id"), ids(X.chunks(spark, SF).where(~F.col("doc_id").isin(lost)), "chunk_id")
    before = files(docs) | files(chunks)
    assert stored.delete_documents(docs, chunks, gone) == len(partitions) < 20
    after = files(docs) | files(chunks)
    changed = {re.search(r"collection_id=(\w+)", f)[1] for f in before.keys() ^ after.keys()} | {re.search(r"collection_id=(\w+)", f)[1] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == partitions
    assert (ids(docs.read(), "id"), ids(chunks.read(), "chunk_id")) == want
    assert docs.read().where("collection_id = 'src3'").count() == 0
    stored.delete_documents(docs, chunks, spark.createDataFrame([(i, "src3") for i in lost], "id long, collection_id string"))
    assert (ids(docs.read(), "id"), ids(chunks.read(), "chunk_id")) == want


def test_upserts_by_key(spark, tmp_path):
    schema = "k string, v long, bucket int"
    table = stored.Stored(spark, str(tmp_path / "t"), schema, "bucket")
    rows = lambda *r: spark.createDataFrame(r, "k string, v long").withColumn("bucket", stored.bucket("k"))
    assert table.read().collect() == []
    stored.upsert(table, rows(), ["k"])
    stored.upsert(table, rows(("a", 1), ("b", 2), (None, 3)), ["k"])
    for _ in range(2):  # twice is once
        stored.upsert(table, rows(("b", 5), (None, 6), ("c", 7)), ["k"])
        assert sorted(((r.k or ""), r.v) for r in table.read().collect()) == [("", 6), ("a", 1), ("b", 5), ("c", 7)]
    before = files(table)
    stored.upsert(table, rows(("a", 9)), ["k"])
    assert len({os.path.dirname(f) for f in before.keys() ^ files(table).keys()}) == 1
    assert stored.delete(table, rows(("a", 0), ("b", 0), ("c", 0), (None, 0), ("z", 0)), ["k"]) > 0
    assert table.read().collect() == []
