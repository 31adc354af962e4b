"""Quality rules: an isolation forest over rule statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import WORD, bounded_sample, cut

SYMBOLS = b"#*$%&|<>"
SPAN = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bars", "n_marks", "n_stops", "n_echoes")
_ODD = np.random.default_rng(8).integers(1, 1 << 63, SPAN, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[str], span: int = SPAN) -> int:
    """Words in windows of `span` words that occur twice or more in the text, first occurrence included.

    Equal windows have equal hashes; windows that share a hash are then held against each other word by word.
    """
    if len(words) <= span:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=len(words))
    if len(known) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(words) - span + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(span):
        h += mixed[k : k + n] * _ODD[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    candidates = order[np.r_[same, False] | np.r_[False, same]]
    rows = ids[candidates[:, None] + np.arange(span)]
    _, group, size = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = candidates[size[group.ravel()] > 1]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + span, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    points = int(raw.sum() - raw[0x80:0xC0].sum())
    lines = text.split("\n")
    with_word = [x for x in lines if WORD.search(x)]
    return (
        len(words), points - int(raw[[0x20, *range(0x09, 0x0E)]].sum()), int(raw[list(SYMBOLS)].sum()), len(with_word) - len(set(with_word)), repeated_words(words),
        len(with_word), int(raw[65:91].sum()), int(raw[48:58].sum()), int(raw[124]), int(raw[33]), int(raw[[44, 46, 63]].sum()), sum(map(str.__eq__, words[1:], words)),
    )


def rule_counts(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return of(text)


def features(c: pd.DataFrame) -> np.ndarray:
    """Shares and rates only, so that a document's length alone never makes it odd."""
    words, chars = np.maximum(c["n_words"].to_numpy(float), 1), np.maximum(c["word_chars"].to_numpy(float), 1)
    lines = np.maximum(c["n_lines"].to_numpy(float), 1)
    return np.stack([
        np.log(chars / words), np.sqrt((c["n_symbols"] - c["n_bars"]).to_numpy(float) / words), np.sqrt(c["n_bars"].to_numpy(float) / words), np.sqrt(c["n_dup_lines"].to_numpy(float) / lines),
        np.sqrt(c["n_repeat_words"].to_numpy(float) / words), c["n_upper"].to_numpy(float) / chars, c["n_digits"].to_numpy(float) / chars, np.sqrt(c["n_marks"].to_numpy(float) / words), c["n_stops"].to_numpy(float) / words, np.sqrt(c["n_echoes"].to_numpy(float) / words),
    ], axis=1)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), cut, place of the left child (the right one follows), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for rows that few random splits set apart."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, at, left, depth in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= at[node]
                node = np.where(inner, left[node] + right, node)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def _expected(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = 128, size: int = 256, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    out = []
    for _ in range(trees):
        feature, at, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, x[rng.permutation(len(x))[:size]], 0)]
        while todo:
            node, rows, level = todo.pop()
            wide = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
            if level >= limit or not len(wide):
                depth[node] = level + _expected(len(rows))
                continue
            f = int(rng.choice(wide))
            value = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[node], at[node], left[node] = f, value, len(feature)
            goes = rows[:, f] >= value
            for part in (rows[~goes], rows[goes]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), at.append(0.0), left.append(0), depth.append(0.0)
        out.append((np.array(feature), np.array(at), np.array(left), np.array(depth)))
    return Forest(out, max(_expected(size), 1.0))


def anomaly(counts: list[Column], forest: Forest) -> Column:
    @F.pandas_udf("double")
    def of(*cols: pd.Series) -> pd.Series:
        return pd.Series(forest.score(features(pd.concat(cols, axis=1, keys=COUNTS))) if len(cols[0]) else np.empty(0))

    return of(*counts)


def pick_threshold(bins: list[tuple[int, int, int]], steps: int, max_good_lost: float) -> float:
    """bins: (score bin, rows of class 1, rows of class 0). The cut that catches most of class 0 while it loses at most
    max_good_lost of class 1; 0.65 if a class is missing."""
    good, bad = np.zeros(steps + 1), np.zeros(steps + 1)
    for b, g, d in bins:
        good[b], bad[b] = g, d
    if not good.sum() or not bad.sum():
        return 0.65
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= max_good_lost, caught - lost, -1)
    best = np.flatnonzero(gain == gain.max())
    return float(best[-1]) / steps


def isolate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, poor_share: float = 0.05, max_good_lost: float = 0.01, steps: int = 2000) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then
    anomaly (the forest's score), threshold and the further counts.

    The forest grows on a bounded sample of labelled rows: about `sample` of quality 1, and of quality 0 so many that
    they make up poor_share, since a forest finds few odd rows among many usual ones. The threshold is calibrated on
    the scores of all labelled rows, counted in `steps` bins. Counts cover every whole text; texts are read once.
    A null or empty text has counts of zero and fails the base rules. labels: (doc_id, quality); a document without a
    label is scored like any other; without labels the forest grows on a sample of all documents and the threshold is
    0.65. Rows with null or repeated ids each keep their row; other columns are left out; empty gives empty.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), rule_counts(F.col(text_col)).alias("_c")).select("doc_id", "_c.*")
    table = cut(base, "rules")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    marked = cut(table.where("n_words >= 20").join(marks, "doc_id"), "marked")
    row = F.concat_ws(":", F.col("doc_id").cast("string"), "n_words", "word_chars")
    per = bounded_sample(marked, "_quality", row, sample)
    got = per.select("_quality", *COUNTS).orderBy("_quality", *COUNTS).toPandas()
    if not len(got):
        got = table.withColumn("_quality", F.lit(1)).transform(lambda d: bounded_sample(d, "_quality", row, sample)).select("_quality", *COUNTS).orderBy(*COUNTS).toPandas()
    good, poor = got[got["_quality"] == 1], got[got["_quality"] == 0]
    few = max(1, int(poor_share * len(good) / (1 - poor_share))) if len(good) else len(poor)
    poor = poor.iloc[np.random.default_rng(5).permutation(len(poor))[:few]]
    forest = grow(features(pd.concat([good, poor]))) if len(got) else Forest([], 1.0)
    if not forest.trees:
        forest = Forest([(np.array([-1]), np.zeros(1), np.zeros(1, dtype=int), np.ones(1))], 1.0)
    scored = marked.select("_quality", F.floor(anomaly([F.col(c) for c in COUNTS], forest) * steps).cast("int").alias("bin"))
    bins = scored.groupBy("bin").agg(F.count_if(F.col("_quality") == 1), F.count_if(F.col("_quality") == 0)).collect()
    threshold = pick_threshold([tuple(b) for b in bins], steps, max_good_lost)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = table.withColumn("base_failed", failed).withColumn("anomaly", anomaly([F.col(c) for c in COUNTS], forest))
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("anomaly") < threshold)).alias("kept"), "anomaly", F.lit(threshold).alias("threshold"), *COUNTS[5:])
