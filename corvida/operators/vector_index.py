"""A cell index of vectors: written once, added to, and searched by a few cells a question."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvida.operators import retrieve as R

#: Cells for n vectors: CELLS_PER_ROOT times the root of n, so that cells and what each holds grow alike. At most MOST_CELLS,
#: which bounds what the driver and every task hold of the centres.
CELLS_PER_ROOT, LEAST_CELLS, MOST_CELLS = 4.5, 4, 1 << 16
#: Cells that a vector's code lies in: near a border of cells, a question's nearest cells may be others than a vector's own.
COPIES = 4
#: Centres are fitted on about so many vectors a cell, picked by a hash of their ids.
SAMPLE_PER_CELL = 64
#: A cell's vectors lie in blocks of about this many, so that a hot cell is many tasks.
BLOCK_ROWS = 4096
AUDITED = 256


@dataclass(frozen=True)
class VectorIndex:
    """Tables under `path`: centres (cell, centre); vectors (cell, chunk_id, e), each in its nearest cell, and blocks (cell,
    block, ids, homes, codes, scales, wrong) with each vector in its COPIES nearest, both partitioned by cell. e are unit
    vectors; a code is one signed byte a component of a vector's residual to the cell's centre, with its scale and the length
    of what the code gets wrong; a home is the cell that the vector itself lies in."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def centres(self) -> np.ndarray:
        rows = self.table("centres").orderBy("cell").select("centre").collect()
        return np.array([r[0] for r in rows], dtype=float) if rows else np.zeros((0, 0))


def unit_vectors(df: DataFrame, *columns: str) -> DataFrame:
    """df's columns and e, its embedding at length 1, and n; null, empty, partly null and zero ones are left out."""
    e = R.usable_vectors(df, *columns)
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return e.withColumn("norm", norm).where("norm > 0").withColumn("e", F.transform("e", lambda x: x / F.col("norm"))).drop("norm")


def cells_for(n: int) -> int:
    return int(min(MOST_CELLS, max(LEAST_CELLS, math.ceil(CELLS_PER_ROOT * math.sqrt(n)))))


def nearest_cells(centres: np.ndarray, most: int):
    """The `most` centres that a unit vector is nearest to, nearest first."""

    @F.pandas_udf("array<int>")
    def of(e: pd.Series) -> pd.Series:
        half, found = 0.5 * (centres**2).sum(axis=1), []
        for tile in R.tiles(len(e), len(centres)):
            found += list(np.argsort(half - np.stack(e[tile].to_list()) @ centres.T, axis=1, kind="stable")[:, :most].astype(np.int32))
        return pd.Series(found, dtype=object)

    return of


def build(vectors: DataFrame, path: str, seed: int = 7) -> VectorIndex:
    """Writes an index of vectors (chunk_id, embedding) of one length, the most frequent one; others are left out. Every
    vector is indexed; the centres alone are fitted on a sample, of SAMPLE_PER_CELL a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    unit = unit_vectors(vectors, "chunk_id")
    usual = unit.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    index = VectorIndex(spark, path)
    if usual is None:
        spark.createDataFrame([], "cell int, centre array<double>").write.parquet(f"{path}/centres")
        return index
    unit, cells = unit.where(F.col("n") == usual["n"]), cells_for(usual["count"])
    share = min(1.0, SAMPLE_PER_CELL * cells / usual["count"])
    some = unit.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    model = KMeans(k=cells, seed=seed, maxIter=6, initSteps=1).fit(some.withColumn("features", array_to_vector("e")))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _append(index, unit)
    return index


def add(index: VectorIndex, vectors: DataFrame) -> None:
    """Further vectors, into the cells there are. Vectors of another length than the index has are left out."""
    dims = index.centres().shape[1]
    _append(index, unit_vectors(vectors, "chunk_id").where(F.col("n") == dims))


def _append(index: VectorIndex, unit: DataFrame) -> None:
    centres = index.centres()
    placed = unit.withColumn("cells", nearest_cells(centres, COPIES)("e"))
    own = placed.withColumn("cell", F.col("cells")[0])
    # a cell of very many vectors is written by as many tasks as it has blocks
    _dealt(own, "chunk_id", "e").select("chunk_id", "e", "cell").write.mode("append").partitionBy("cell").parquet(f"{index.path}/vectors")
    copies = placed.select("chunk_id", "e", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
    blocks = _dealt(copies, "chunk_id", "e", "home").groupBy("cell", "block").agg(F.collect_list(F.struct("chunk_id", "e", "home")).alias("held"))
    schema = f"block int, ids array<{dict(unit.dtypes)['chunk_id']}>, homes array<int>, codes binary, scales array<double>, wrong array<double>, cell int"
    blocks.mapInArrow(_encode(centres), schema).write.mode("append").partitionBy("cell").parquet(f"{index.path}/blocks")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """rows by cell and block, a cell's blocks by a hash. The sizes are one row a cell, MOST_CELLS at most."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rows.select("cell", *columns).join(F.broadcast(sizes), "cell")
    return dealt.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")).repartition("cell", "block").select("cell", "block", *columns)


def _encode(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = held.values
                x = rows.field("e").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                codes, scales, wrong = encode_residuals(x, centres[cell])
                columns = [[block], [rows.field("chunk_id").to_pylist()], [rows.field("home").to_pylist()], [codes.tobytes()], [scales.tolist()], [wrong.tolist()], [cell]]
                numbers = pa.list_(pa.float64())
                types = [pa.int32(), pa.list_(rows.field("chunk_id").type), pa.list_(pa.int32()), pa.binary(), numbers, numbers, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["block", "ids", "homes", "codes", "scales", "wrong", "cell"])

    return run


def encode_residuals(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, wrong): scale times code is a vector's residual but for a rest of length `wrong`, rounded up."""
    residual = x - centre
    scales = np.maximum(np.abs(residual).max(axis=1), 1e-30) / 127
    codes = np.rint(residual / scales[:, None]).astype(np.int8)
    wrong = np.linalg.norm(residual - codes * scales[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scales, wrong


def _first_pass(centres: np.ndarray, k: int):
    """(questions, block) pairs to the vectors of the block that may be among a question's k best of it: those whose score by
    code, plus what the code may be wrong by, reaches the k-th best score by code less what that one may be wrong by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, asked, ids, homes, codes, scales, wrong in zip(*(batch.column(i) for i in range(7)), strict=True):
                rows, c = asked.values, centres[cell.as_py()]
                q = rows.field("e").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                code = np.frombuffer(codes.as_py(), dtype=np.int8).reshape(-1, len(c))
                s, w = (v.values.to_numpy(zero_copy_only=False) for v in (scales, wrong))
                code = code.T.astype(float)
                for tile in R.tiles(len(q), len(s)):
                    score = (q[tile] @ code) * s + (q[tile] @ c)[:, None]
                    low = score - w
                    least = np.partition(low, -min(k, low.shape[1]), axis=1)[:, -min(k, low.shape[1])]
                    who, what = np.nonzero(score + w >= least[:, None])
                    columns = [rows.field("query_id").take(pa.array(who + tile.start)), ids.values.take(pa.array(what)), homes.values.take(pa.array(what)), pa.array(low[who, what]), pa.array((score + w)[who, what])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "cell", "low", "high"])

    return run


def search(index: VectorIndex, questions: DataFrame, probes: int, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, vector_score, rank): the k best of the vectors in the `probes` cells nearest to each question.

    Blocks of codes meet blocks of questions by cell; only partitions of probed cells are read. What the codes leave in
    doubt, little more than k rows a question, is joined to its vectors and scored by them, so within the cells the result
    is exact. Questions whose vector is null, zero or of another length have no hits."""
    centres = index.centres()
    types = dict(questions.dtypes)
    if not len(centres):
        return questions.sparkSession.createDataFrame([], f"query_id {types['query_id']}, chunk_id {types['query_id']}, vector_score double, rank int")
    asked = unit_vectors(questions, "query_id").where(F.col("n") == centres.shape[1]).select("query_id", "e")
    probing = asked.withColumn("cell", F.explode(nearest_cells(centres, min(probes, len(centres)))("e")))
    wanted = [r[0] for r in probing.select("cell").distinct().collect()]  # MOST_CELLS at most; they name the partitions to read
    dealt = probing.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK_ROWS)))).cast("int"))
    met = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "e")).alias("asked")).join(index.table("blocks").where(F.col("cell").isin(wanted)), "cell")
    vectors = index.table("vectors").select("cell", "chunk_id", F.col("e").alias("v"))
    ddl = f"query_id {types['query_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, cell int, low double, high double"
    offered = met.select("cell", "asked", "ids", "homes", "codes", "scales", "wrong").mapInArrow(_first_pass(centres, k), ddl)
    offered = offered.groupBy("query_id", "chunk_id", "cell").agg(F.max("low").alias("low"), F.min("high").alias("high"))  # one of a vector's copies
    floor = R.ranked(offered.select("query_id", "chunk_id", "low"), "low", k).groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    left = offered.join(floor, "query_id").where((F.col("high") >= F.col("least")) | (F.col("n") < k)).select("query_id", "chunk_id", "cell")
    both = left.join(vectors, ["cell", "chunk_id"]).join(asked, "query_id")
    score = F.round(F.aggregate(F.zip_with("e", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 9)
    return R.ranked(both.select("query_id", "chunk_id", score.alias("vector_score")), "vector_score", k).select("query_id", "chunk_id", "vector_score", "rank")


def recall_curve(index: VectorIndex, questions: DataFrame, vectors: DataFrame, k: int = 5, audited: int = AUDITED) -> DataFrame:
    """(probes, recall, cells): the share of the true k best of about `audited` questions, picked by a hash of their ids, that lie
    in the `probes` nearest cells, for every number of probes at which it grows.

    The true ones come from an exact search of all vectors; where each lies in its question's order of cells tells the
    recall of every number of probes at once."""
    centres = index.centres()
    unit = unit_vectors(questions, "query_id").where(F.col("n") == centres.shape[1])
    share = min(1.0, audited / max(1, unit.count()))
    some = unit.where(F.pmod(F.xxhash64("query_id", F.lit("audit")), F.lit(1 << 30)) < int(share * (1 << 30))).select("query_id", "e")
    true = R.vector_topk(some.withColumnRenamed("e", "embedding"), vectors, k).select("query_id", "chunk_id")
    cells = index.table("vectors").join(true.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.explode(nearest_cells(centres, COPIES)("e")).alias("cell"))
    order = some.select("query_id", F.posexplode(nearest_cells(centres, len(centres))("e")).alias("place", "cell"))
    first = true.join(cells, "chunk_id").join(order, ["query_id", "cell"]).groupBy("query_id", "chunk_id").agg((F.min("place") + 1).alias("probes"))
    found = first.groupBy("probes").count()
    every = Window.orderBy("probes")  # of one row a number of probes, MOST_CELLS at most
    share_upto = F.sum("count").over(every) / F.sum("count").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.select("probes", share_upto.alias("recall"), F.lit(len(centres)).alias("cells"))


def audited_probes(index: VectorIndex, questions: DataFrame, vectors: DataFrame, k: int = 5, target: float = 0.92) -> int:
    """The least number of cells at which the audited questions find the share `target` of their true k best; all cells if
    there is nothing to audit."""
    enough = recall_curve(index, questions, vectors, k).where(F.col("recall") >= target).agg(F.min("probes")).first()[0]
    return enough or max(1, len(index.centres()))
