"""The persisted inverted index: the rows of a search without it, before and after inserts and deletes; what it reads."""

import re

import pytest
from pyspark.sql import functions as F

from corvida.operators import retrieve as R
from corvida.operators import text_index as I
from corvida.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return X.chunks(spark, SF).cache(), X.questions(spark, SF)


@pytest.fixture(autouse=True)
def few_files(monkeypatch):
    monkeypatch.setattr(I, "BUCKETS", 8)
    monkeypatch.setattr(I, "TEXT_PARTS", 2)


def rows(hits):
    return sorted((r.query_id, r.chunk_id, r.lexical_score, r.lexical_rank) for r in hits.collect())


def counts(df):
    return sorted((r.token, r.chunks) for r in df.collect())


def test_inserts_deletes_and_compaction(spark, tables, tmp_path):
    chunks, questions = tables
    index = I.create(chunks.where("doc_id % 2 = 0"), str(tmp_path / "index"))

    def same(condition, searched=True):
        left = chunks.where(condition)
        assert counts(I.dictionary(index)) == counts(R.postings(left).groupBy("token").count().withColumnRenamed("count", "chunks"))
        assert not searched or rows(I.topk(index, questions)) == rows(R.lexical_topk(questions, left))

    I.insert(index, chunks.where("doc_id % 2 = 1"))
    same("true", False)
    I.delete(index, chunks.where("doc_id % 5 = 1").select("doc_id"))
    I.insert(index, chunks.where("doc_id % 10 = 1"))  # some of them come back
    same("doc_id % 5 <> 1 or doc_id % 10 = 1")
    I.delete(index, chunks.where("doc_id % 10 = 1").select("doc_id"))
    I.delete(index, chunks.where("doc_id % 10 = 1").select("doc_id"))  # twice is once
    same("doc_id % 5 <> 1", False)
    assert I.compact(index) == 3 and index.segments() == [3]
    same("doc_id % 5 <> 1")


def test_only_buckets_of_the_terms_are_read(spark, tables, tmp_path):
    index = I.create(tables[0], str(tmp_path / "index"))
    question = spark.createDataFrame([(1, "rivers")], "query_id long, query string")
    bucket = spark.range(1).select(I.bucket_of(F.lit("rivers"))).first()[0]
    plan = I.candidates(index, question)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters.*?ReadSchema: (\S+)", plan)
    assert scans and all(re.search(rf"bucket#\d+ = {bucket}\)", filters) and "content" not in schema for filters, schema in scans)


def test_prefixes_of_the_dictionary(spark, tables, tmp_path):
    chunks, _ = tables
    index = I.create(chunks, str(tmp_path / "index"))
    every = counts(I.dictionary(index))
    for prefix in ("th", "the", every[len(every) // 2][0][:3], "no such token"):
        assert counts(I.tokens_with(index, prefix)) == [c for c in every if c[0].startswith(prefix)]
    with pytest.raises(ValueError):
        I.tokens_with(index, "t")


def test_an_insert_that_broke_off_is_not_read(spark, tables, tmp_path, monkeypatch):
    chunks, questions = tables
    index = I.create(chunks.where("doc_id % 2 = 0"), str(tmp_path / "index"))
    before = counts(I.dictionary(index))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(I, "_mark", fail)
        with pytest.raises(OSError):
            I.insert(index, chunks.where("doc_id % 2 = 1"))
    assert counts(I.dictionary(index)) == before
    I.insert(index, chunks.where("doc_id % 4 = 1"))
    assert counts(I.dictionary(index)) == counts(R.postings(chunks.where("doc_id % 2 = 0 or doc_id % 4 = 1")).groupBy("token").count().withColumnRenamed("count", "chunks"))


def test_nulls_and_an_empty_index(spark, tables, tmp_path):
    chunks, questions = tables
    index = I.create(chunks.limit(0), str(tmp_path / "index"))
    assert rows(I.topk(index, questions)) == [] and counts(I.dictionary(index)) == []
    odd = spark.createDataFrame([("9_0", 9, "f", 0, None, "c", None, "TEXT", None, None, None, None), ("9_1", 9, "f", 1, "", "c", None, "TEXT", None, None, None, None)], index.columns)
    I.insert(index, odd)
    assert counts(I.dictionary(index)) == []
    I.insert(index, chunks)
    assert counts(I.dictionary(index)) == counts(R.postings(chunks).groupBy("token").count().withColumnRenamed("count", "chunks"))


def test_chunks_come_in_for_asked_prefixes_alone(spark):
    """Prefixes carry no chunks before they meet terms, and what is offered is cut before it is shuffled by chunk."""
    import re

    from corvida.operators import retrieve

    rows = [(f"{i}_{j}", i, j, f"alpha beta{i % 3} gam{j} alphabet" if i % 2 else "beta alp") for i in range(60) for j in range(3)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id int, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "alp"), (2, "beta"), (2, "gam"), (3, "none")], "query_id int, term string")
    found = retrieve.first_chunks(asked, retrieve.postings(chunks), 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Generate explode\(transform\(sequence.*places", plan)
    assert not re.search(r"Exchange hashpartitioning\(term#\d+, chunk_id", plan)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "doc_id", "chunk_index").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    holds = lambda text, terms: any(w.startswith(t) for w in text.split() for t in terms)
    want = lambda *terms: [c for c, _, _, text in rows if holds(text, terms)][:7]
    assert got == {1: want("alp"), 2: want("beta", "gam")}
