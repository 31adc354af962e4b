"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import bounded_sample, cut, fold, unit_hash

#: Words share VOCAB hashed rows of DIMS numbers, whatever the corpus holds; SPOTS of an index vector are not zero.
VOCAB, DIMS, SPOTS, NEAR, BLOCK = 1 << 14, 48, 4, 2, 256
PIECE = re.compile(r"\w+|[^\w\s]+")
STEP = 1 << 19
#: Pieces whose rows a task keeps.
CACHE = 1 << 20


def index_vectors(seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (VOCAB + 1, SPOTS) of each row's sparse random index vector; the last row, the border between
    texts, has none."""
    rng = np.random.default_rng(seed)
    spots = np.argsort(rng.random((VOCAB + 1, DIMS)), axis=1)[:, :SPOTS]
    signs = rng.choice([-1.0, 1.0], (VOCAB + 1, SPOTS))
    signs[VOCAB] = 0
    return spots, signs


def _row(piece: str) -> int:
    return zlib.crc32(piece.encode()) & (VOCAB - 1)


def _rows_of(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Hashed rows of all pieces of a whole text: words with their case, runs of signs. `known` is cleared between texts
    once it would hold more than CACHE pieces; a text that alone has more of them is hashed without it."""
    found = PIECE.findall(text or "")
    new = set(found).difference(known)
    if len(known) + len(new) > CACHE:
        known.clear()
        new = set(found)
    if len(new) > CACHE:
        return np.fromiter(map(_row, found), dtype=np.int64, count=len(found))
    known.update((w, _row(w)) for w in new)
    return np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spots, signs = index_vectors()
    total = np.zeros((VOCAB + 1) * DIMS)
    known: dict[str, int] = {}
    border = np.array([VOCAB])

    def add(parts: list[np.ndarray]) -> None:
        t = np.concatenate(parts)
        for apart in range(1, NEAR + 1):
            a, b = t[:-apart], t[apart:]
            for s in range(SPOTS):
                for word, near in ((a, b), (b, a)):
                    total[:] += np.bincount(word * DIMS + spots[near, s], weights=signs[near, s], minlength=len(total))

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for value in batch.column(0):
            rows = _rows_of(value.as_py(), known)
            held += [rows, border, border]
            size += len(rows) + 2
            if size > STEP:
                add(held)
                held, size = [], 0
    if size:
        add(held)
    task = TaskContext.get().partitionId()
    blocks = total[: VOCAB * DIMS].astype("<f4").reshape(-1, BLOCK * DIMS)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), task % 256)), pa.array([blocks[i].tobytes() for i in some], type=pa.binary())], names=["block", "salt", "sums"])


def _add_up(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK * DIMS)
    for x in part["sums"]:
        total += np.frombuffer(x, dtype="<f4")
    return pd.DataFrame({"block": [part["block"].iloc[0]], "salt": [part["salt"].iloc[0]], "sums": [total.astype("<f4").tobytes()]})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(VOCAB, DIMS) unit vectors: for each hashed word, the sum of the index vectors of the words up to NEAR places
    from it, over all texts of the corpus. Tasks add up their own texts; blocks of rows are summed in two salted
    rounds, so what a task gathers, and the fixed-size result, don't grow with the corpus. A row that never occurs has
    its own index vector."""
    ddl = "block long, salt long, sums binary"
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts, ddl)
    sums = parts.groupBy("block", "salt").applyInPandas(_add_up, ddl).withColumn("salt", F.lit(0).cast("long")).groupBy("block", "salt").applyInPandas(_add_up, ddl)
    spots, signs = index_vectors()
    own = np.zeros((VOCAB, DIMS))
    np.put_along_axis(own, spots[:VOCAB], signs[:VOCAB], axis=1)
    found = np.zeros((VOCAB, DIMS))
    for block, _, data in sums.collect():
        found[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, dtype="<f4").reshape(BLOCK, DIMS)
    found = np.sign(found) * np.log1p(np.abs(found))
    found[~found.any(axis=1)] = 0
    found = np.where(found.any(axis=1, keepdims=True), found, own) + 0.25 * own
    return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for value in batch.column(1):
                rows = _rows_of(value.as_py(), known)
                if not len(rows):
                    out.append(np.zeros(2 * DIMS + 1, dtype="<f4").tobytes())
                    continue
                total, square = np.zeros(DIMS), np.zeros(DIMS)
                for at in range(0, len(rows), 1 << 14):
                    x = vectors[rows[at : at + (1 << 14)]]
                    total += x.sum(axis=0)
                    square += np.einsum("ij,ij->j", x, x)
                mean = total / len(rows)
                out.append(np.r_[mean, np.sqrt(np.maximum(square / len(rows) - mean**2, 0)), np.log1p(len(rows)) / 10].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["doc_id", "pooled"])

    return run


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 4) -> Network:
    """Adam on weighted cross-entropy over four fifths of the rows; the other fifth sets the temperature at which their
    probabilities are most likely."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rows = (order[: len(x) // 5], order[len(x) // 5 :]) if len(x) >= 50 else (order, order)
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-3
    z = (x - mean) / scale
    weight = weight / weight.mean()
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            h = np.tanh(z[part] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[part]) * weight[part] / len(part)
            dh = d[:, None] * p["w2"] * (1 - h**2)
            g = {"w2": h.T @ d + decay * p["w2"], "b2": np.array([d.sum()]), "w1": z[part].T @ dh + decay * p["w1"], "b1": dh.sum(axis=0)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    logits = net.logits(x[held])

    def loss(t: float) -> float:
        return float((weight[held] * (np.logaddexp(0, logits / t) - y[held] * logits / t)).mean())

    net.temperature = float(min(np.geomspace(0.3, 10, 80), key=loss))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 4000, least: float = 0.7) -> DataFrame:
    """One row per input row: id, held_out (crc32 of the id as text, mod 4, is 2; false for a null id), score (0 to 1),
    predicted (1 if score >= least).

    The word vectors gather contexts from all texts. The network learns from a bounded sample of labelled rows that are
    not held out: about per_class of each class, twice that at most, weighted back to the labels' own shares. A null or
    empty text has a pooled vector of zeros and the network's score for that. Without labels of both classes every
    score is the share of class 1, or 0.5. Rows with null or repeated ids each keep their row; other columns are left
    out; an empty table gives an empty result.
    """
    pooled = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pool(word_vectors(docs, text_col)), f"doc_id {docs.schema[id_col].dataType.simpleString()}, pooled binary"), "pooled")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (fold("doc_id", 4) != 2)).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(label_col).alias("_y"))
    true = dict(marks.groupBy("_y").count().collect())
    some = bounded_sample(marks, "_y", F.col("_label_id").cast("string"), per_class, 2).orderBy(unit_hash(F.col("_label_id").cast("string"), F.lit("order"))).limit(2 * per_class)
    got = pooled.join(F.broadcast(some), F.col("doc_id") == F.col("_label_id")).select("_y", "pooled").orderBy("_y", "pooled").collect()
    y = np.array([r[0] for r in got], dtype=float)
    if len(set(y)) == 2:
        x = np.stack([np.frombuffer(r[1], dtype="<f4") for r in got]).astype(float)
        share = {c: true[c] / (y == c).sum() for c in (0, 1)}
        net = fit(x, y, np.array([share[int(c)] for c in y]))
    else:
        prior = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if len(y) else 0.0
        net = Network(np.zeros(2 * DIMS + 1), np.ones(2 * DIMS + 1), np.zeros((2 * DIMS + 1, 1)), np.zeros(1), np.zeros(1), float(prior))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(net.score(np.frombuffer(b"".join(x), dtype="<f4").reshape(len(x), -1).astype(float)))

    out = pooled.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), score("pooled").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
