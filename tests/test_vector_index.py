"""The cell index of vectors: recall at the audited number of probes, exact search within cells, additions, pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvida.operators import retrieve as R
from corvida.operators import vector_index as V
from corvida.sources import fixtures as X


def sides(spark, sf):
    e = X.table(spark, f"/root/testdata/{sf}", "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding")


def pairs(hits):
    return {(r.query_id, r.chunk_id, round(r.vector_score, 6)) for r in hits.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return V.build(sides(spark, "sf0.1")[1], str(tmp_path_factory.mktemp("cells") / "index"))


def test_recall_at_a_tenth_of_the_cells(spark, index):
    q, v = sides(spark, "sf0.1")
    cells = len(index.centres())
    probes = V.audited_probes(index, q, v)
    assert cells >= 64 and probes <= cells / 10
    exact, found = ({p[:2] for p in pairs(h)} for h in (R.vector_topk(q, v), V.search(index, q, probes)))
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)
    curve = {r.probes: r.recall for r in V.recall_curve(index, q, v).collect()}
    assert abs(len(exact & found) / len(exact) - max(r for p, r in curve.items() if p <= probes)) < 1e-9  # all 100 questions were audited


def test_all_cells_are_an_exact_search(spark, index):
    q, v = sides(spark, "sf0.1")
    assert pairs(V.search(index, q, 10**6, 7)) == pairs(R.vector_topk(q, v, 7))


def test_only_probed_cells_are_read(spark, index):
    q, _ = sides(spark, "sf0.1")
    plan = V.search(index, q.limit(1), 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and "cell" in index.table("blocks").inputFiles()[0]


def test_cells_grow_slower_than_the_table():
    n = [10**3, 10**5, 10**7]
    cells = [V.cells_for(x) for x in n]
    assert cells == sorted(cells) and all(a / b > c / d for a, b, c, d in zip(cells, n, cells[1:], n[1:]))
    assert V.cells_for(10**12) == V.MOST_CELLS


def test_added_vectors_are_found(spark, tmp_path):
    q, v = sides(spark, "sf0.01")
    index = V.build(v.where("chunk_id % 3 > 0"), str(tmp_path / "index"))
    V.add(index, v.where("chunk_id % 3 = 0").unionByName(spark.createDataFrame([(10**6, [1.0] * 3), (10**6 + 1, None)], "chunk_id long, embedding array<float>")))
    assert index.table("vectors").count() == v.count() and index.table("blocks").selectExpr("sum(size(ids))").first()[0] == V.COPIES * v.count()
    assert pairs(V.search(index, q, 10**6)) == pairs(R.vector_topk(q, v))


def test_hot_cells_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8) + 0.01 * rng.normal(size=(300, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([hot, rng.normal(size=(100, 8)), np.zeros((1, 8))]))]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = v.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    index = V.build(v, str(tmp_path / "index"))
    assert index.table("blocks").selectExpr("max(size(ids))").first()[0] < 40
    exact = {(a, b) for a, b, _ in pairs(R.vector_topk(q.where("query_id <> 400"), v.where("chunk_id <> 400")))}
    assert {(a, b) for a, b, _ in pairs(V.search(index, q, 10**6))} == exact


def test_codes_hold_their_bounds():
    rng = np.random.default_rng(5)
    x, c, q = rng.normal(size=(200, 16)), rng.normal(size=16), rng.normal(size=(50, 16))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes, scales, wrong = V.encode_residuals(x, c)
    by_code = (q @ codes.T.astype(float)) * scales + (q @ c)[:, None]
    assert (np.abs(by_code - q @ x.T) <= wrong).all() and wrong.max() < 0.2


def test_empty_tables(spark, tmp_path):
    q, v = sides(spark, "sf0.001")
    index = V.build(v.limit(0), str(tmp_path / "none"))
    assert V.search(index, q, 3).collect() == []
    index = V.build(v, str(tmp_path / "some"))
    assert V.search(index, q.limit(0), 3).collect() == []
