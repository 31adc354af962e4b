"""Mixing sources to target weights by soft membership and distributed least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import WORD, bounded_sample, cut, unit_hash, unused

PAIRS, WORDS = 1024, 4096
#: Domains of the labels table, and what share of the mixed tokens each shall have.
DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.92, "poor": 0.03, "toxic": 0.05}
#: The domain that a mixture keeps whole.
KEPT = "good"
BATCH = 256


def domain(labels: DataFrame) -> Column:
    return F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("poor")).when(F.col("quality") == 1, F.lit("good"))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of whole texts, and rows of hashed byte-pair shares and of hashed words that occur."""
    out = np.zeros((len(texts), PAIRS + WORDS), dtype=np.float32)
    words = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        found = WORD.findall(t or "")
        words[i] = len(found)
        if not found:
            continue
        raw = np.frombuffer(t.encode(), dtype=np.uint8).astype(np.uint32)
        codes = (raw[:-1] * np.uint32(256) + raw[1:]) * np.uint32(40503) >> np.uint32(6) & np.uint32(PAIRS - 1)
        out[i, :PAIRS] = np.sqrt(np.bincount(codes, minlength=PAIRS) / len(raw))
        places = np.fromiter((zlib.crc32(w.encode()) for w in {x.strip(".,;:!?\"'()").lower() for x in found}), dtype=np.uint32) % WORDS
        out[i, PAIRS + places] = 0.3
    return words, out


@dataclass
class Softmax:
    domains: list[str]
    weight: np.ndarray
    bias: np.ndarray
    known: frozenset[str] = frozenset()  # domains with a labelled document

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, domains: list[str], epochs: int = 25, rate: float = 0.05, decay: float = 1e-3, seed: int = 2) -> Softmax:
    rng = np.random.default_rng(seed)
    w, b = np.zeros((x.shape[1], len(domains))), np.zeros(len(domains))
    mw, vw = np.zeros_like(w), np.zeros_like(w)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            p = Softmax(domains, w, b).posteriors(x[rows])
            p[np.arange(len(rows)), y[rows]] -= 1
            g = x[rows].T @ p / len(rows) + decay * w
            step += 1
            mw, vw = 0.9 * mw + 0.1 * g, 0.999 * vw + 0.001 * g**2
            w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-8)
            b -= rate * p.mean(axis=0)
    return Softmax(domains, w, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domains: tuple[str, ...] = DOMAINS, per_domain: int = 1500, seed: int = 2) -> Softmax:
    """A softmax regression on hashed features of a bounded sample of labelled rows: about per_domain of each domain,
    and at most three times as many in all. The sampled ids, so bounded, are broadcast; the texts don't move, and their
    feature rows, mostly zeros, reach the driver compressed. A domain without a labelled document has posterior 0."""
    marked = labels.select(F.col("doc_id").alias("label_id"), domain(labels).alias("domain")).where("label_id is not null").groupBy("label_id").agg(F.max("domain").alias("domain"))
    some = bounded_sample(marked, "domain", F.col("label_id").cast("string"), per_domain, len(domains)).limit(3 * per_domain)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(some), F.col("id") == F.col("label_id")).select("domain", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                x = hashed(part.column(1).to_pylist())[1].astype("<f2")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([squeeze.compress(r.tobytes()) for r in x], type=pa.binary())], names=["domain", "x"])

    got = rows.mapInArrow(features, "domain string, x binary").orderBy("domain", "x").collect()
    if not got:
        return Softmax(list(domains), np.zeros((PAIRS + WORDS, len(domains))), np.zeros(len(domains)))
    expand = zstandard.ZstdDecompressor()
    x = np.stack([np.frombuffer(expand.decompress(r[1]), dtype="<f2") for r in got]).astype(np.float32)
    y = np.array([domains.index(r[0]) for r in got])
    model = fit_softmax(x, y, list(domains), seed=seed)
    # the sample holds the domains more evenly than the labels do; posteriors are for the labels' shares
    true = dict(marked.where(F.col("domain").isNotNull()).groupBy("domain").count().collect())
    sampled = np.bincount(y, minlength=len(domains))
    model.bias += np.log([max(true.get(d, 0), 0.5) / max(n, 0.5) for d, n in zip(domains, sampled, strict=True)])
    # nothing is known of a domain without a labelled document, so no document belongs to it
    model.bias[sampled == 0] = -np.inf
    model.known = frozenset(d for d, n in zip(domains, sampled, strict=True) if n)
    return model


def memberships(text: Column, model: Softmax) -> Column:
    """struct<tokens long, p array<double>>: words of the whole text, and the posterior of each domain."""

    @F.pandas_udf("tokens long, p array<double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        tokens, p = [], []
        for at in range(0, len(texts), BATCH):
            n, x = hashed(texts.iloc[at : at + BATCH].tolist())
            tokens.append(n)
            p += list(model.posteriors(x).round(6))
        return pd.DataFrame({"tokens": np.concatenate(tokens) if tokens else np.empty(0, dtype=np.int64), "p": p})

    return of(text)


def _lean(p: Column, push: np.ndarray) -> Column:
    return sum((F.lit(float(x)) * p[i] for i, x in enumerate(push)), F.lit(1.0))


def _rate(p: Column, push: np.ndarray, most: float | None) -> Column:
    """1 and the push along the posteriors, projected to at least 0 and at most `most`."""
    rate = F.greatest(F.lit(0.0), _lean(p, push))
    return rate if most is None else F.least(F.lit(float(most)), rate)


def solve(table: DataFrame, name: str, rows: np.ndarray, wanted: np.ndarray, total: float, most: float | None = None, at_most: bool = False, stay: float = 1e-6, tolerance: float = 1e-5, rounds: int = 200) -> np.ndarray:
    """Projected gradient for the least squares of sum of rate * tokens * (rows @ p) against `wanted`, over rates from 0 to
    `most`, with a slight pull (`stay`) of every rate to 1. With at_most only an excess over `wanted` counts.

    Every gradient is a combination of the rows @ p, one number per row. The steps are added up and the projection is
    applied to the sum (lazily projected gradient), so a document's rate follows from its posteriors and that sum alone:
    rates are never gathered, and a round is one aggregation over (tokens, p), whatever came before it. Steps are scaled
    by the inverse Gram matrix of the rows that the projection leaves free and halved until the objective falls. The
    rounds end when the gradient is under `tolerance` of all tokens; it raises if `rounds` don't get there. Returns the
    sum as a push per domain, for _rate().
    """
    n, k = rows.shape
    if total <= 0 or not n:
        return np.zeros(k)
    p = F.col(f"{name}.p")
    tokens = F.col(f"{name}.tokens")
    along = [sum((F.lit(float(x)) * p[i] for i, x in enumerate(row)), F.lit(0.0)) for row in rows]

    def look(step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        push = rows.T @ step
        rate, lean = _rate(p, push, most), _lean(p, push)
        free = (rate == lean).cast("double")
        sums = [F.sum(tokens * (rate * lean - rate * rate / 2))]
        sums += [F.sum(tokens * rate * a) for a in along]
        sums += [F.sum(tokens * free * along[i] * along[j]) for i in range(n) for j in range(n)]
        got = np.array(table.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), dtype=float) / total
        value = got[0] - step @ wanted / total + stay * step @ step / 2
        return value, got[1 : 1 + n] - wanted / total + stay * step, got[1 + n :].reshape(n, n) + stay * np.eye(n)

    at = np.zeros(n)
    value, gradient, gram = look(at)
    for _ in range(rounds):
        free = ~((at >= 0) & (gradient < 0)) if at_most else np.ones(n, dtype=bool)
        if np.abs(gradient[free]).max(initial=0.0) < tolerance:
            return rows.T @ at
        move = np.zeros(n)
        move[free] = -np.linalg.solve(gram[np.ix_(free, free)], gradient[free])
        size = 1.0
        while size > 1e-12:
            new = at + size * move
            new = np.minimum(new, 0.0) if at_most else new
            found = look(new)
            if found[0] <= value + 1e-4 * gradient @ (new - at):
                break
            size /= 2
        at, (value, gradient, gram) = new, found
    raise RuntimeError(f"the rates did not settle in {rounds} rounds: gradient {np.abs(gradient).max():.2g}")


def targets(domains: list[str], have: np.ndarray, weights: dict[str, float], known: frozenset[str], budget: float | None = None) -> np.ndarray:
    """Tokens that each domain shall have in the mixture, see mix()."""
    share = np.array([weights.get(d, 0.0) if d in known and have[i] > 0 else 0.0 for i, d in enumerate(domains)])
    if share.sum() <= 0:
        return have
    share = share / share.sum()
    if budget is not None:
        return share * budget
    full = [have[i] / share[i] for i in range(len(domains)) if share[i] > 0]
    scale = have[domains.index(KEPT)] / share[domains.index(KEPT)] if share[domains.index(KEPT)] > 0 else max(full)
    return np.minimum(share * scale, have)


def _told(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, np.ndarray, frozenset[str]]:
    """docs with a column `name`: struct<tokens, p>; the tokens of each domain; the domains that labels tell of."""
    model = train(docs, labels, id_col, text_col)
    table = cut(docs.withColumn(name, memberships(F.col(text_col), model)), "memberships")
    sums = table.agg(*[F.sum(F.col(f"{name}.tokens") * F.col(f"{name}.p")[i]).alias(d) for i, d in enumerate(DOMAINS)]).first()
    return table, np.array([x or 0.0 for x in sums]), model.known


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, budget: float | None = None, name: str = "mix") -> DataFrame:
    """docs (all columns) with a column `name`, which docs must not have: struct<tokens, p, rate>.

    Rates are nonnegative; over all documents the sum of rate * tokens * p comes to the targets of the domains, as near
    as nonnegative rates can. The weights are those of the domains with a labelled document and expected tokens, brought
    to a sum of 1; without any, every rate is 1. budget: tokens wanted, of which each domain shall have its weight. At
    first KEPT, if it has a weight, keeps all of its tokens and sets the scale; the others are capped at their weights
    beside it, and one with fewer tokens than that keeps them all. A scarce domain so never costs another one's tokens.
    Empty and null texts have no tokens and a rate that moves nothing. Without labels all posteriors are equal. An empty
    table gives an empty result.
    """
    table, have, known = _told(docs, labels, id_col, text_col, name)
    push = solve(table, name, np.eye(len(DOMAINS)), targets(list(DOMAINS), have, weights or WEIGHTS, known, budget), float(have.sum()))
    return table.withColumn(name, F.struct(F.col(f"{name}.tokens").alias("tokens"), F.col(f"{name}.p").alias("p"), _rate(F.col(f"{name}.p"), push, None).alias("rate")))


def rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, p_<domain> for each domain, rate, copies (the whole number of times that the
    mixture takes the row: the rate's whole part, and one more if a hash of id and text lies under its rest)."""
    got = mix(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, "doc_id", "text", weights)
    rate = F.col("mix.rate")
    copies = F.floor(rate) + (_draw("doc_id", "text") < rate - F.floor(rate)).cast("long")
    return got.select("doc_id", F.col("mix.tokens").alias("n_tokens"), *[F.col("mix.p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate.alias("rate"), copies.cast("long").alias("copies"))


def _draw(id_col: str, text_col: str) -> Column:
    return unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))


def _thinned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, weights: dict[str, float] | None, name: str) -> DataFrame:
    """docs with struct<tokens, p, rate>, rates from 0 to 1: nearest to 1 among those at which no domain has more tokens
    beside KEPT's than its weight beside KEPT's. Without a labelled document of KEPT every rate is 1."""
    weights = weights or WEIGHTS
    table, have, known = _told(docs, labels, id_col, text_col, name)
    own = DOMAINS.index(KEPT)
    capped = [i for i, d in enumerate(DOMAINS) if i != own and d in known] if KEPT in known and have[own] > 0 else []
    if any(weights.get(DOMAINS[i], 0.0) <= 0 for i in [own, *capped]):
        raise ValueError("every domain with labelled documents needs a weight over 0")
    rows = np.zeros((len(capped), len(DOMAINS)))
    for row, i in zip(rows, capped, strict=True):
        row[i], row[own] = 1.0, -weights[DOMAINS[i]] / weights[KEPT]
    push = solve(table, name, rows, np.zeros(len(rows)), float(have.sum()), most=1.0, at_most=True)
    return table.withColumn(name, F.struct(F.col(f"{name}.tokens").alias("tokens"), F.col(f"{name}.p").alias("p"), _rate(F.col(f"{name}.p"), push, 1.0).alias("rate")))


def sample_mixture(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """docs drawn once at most, each at its rate: nothing is rounded up, so the expected shares are those that the rates
    reach. Rates are at most 1 and as near to it as the weights allow, see _thinned(); documents of KEPT end at 1 and are
    all kept, and a domain that is scarcer than its weight loses nothing. Columns and values stay as they are.
    sample_shares() tells the shares."""
    name = unused("mix", docs)
    got = _thinned(docs, labels, id_col, text_col, weights, name)
    return got.where(_draw(id_col, text_col) < F.col(f"{name}.rate")).select(*docs.columns)


def sample_shares(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """One row per domain: domain, expected tokens at the rates and their share; drawn and drawn_share: the same of the
    rows that sample_mixture() draws."""
    name = unused("mix", docs)
    got = _thinned(docs, labels, id_col, text_col, weights, name)
    mix, kept = F.col(name), (_draw(id_col, text_col) < F.col(f"{name}.rate")).cast("double")
    each = F.array(*[F.struct(F.lit(d).alias("domain"), (mix.tokens * mix.p[i] * mix.rate).alias("tokens"), (mix.tokens * mix.p[i] * kept).alias("drawn")) for i, d in enumerate(DOMAINS)])
    sums = got.select(F.inline(each)).groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("drawn").alias("drawn"))
    whole = Window.partitionBy(F.lit(1))
    return sums.select("domain", "tokens", (F.col("tokens") / F.sum("tokens").over(whole)).alias("share"), "drawn", (F.col("drawn") / F.sum("drawn").over(whole)).alias("drawn_share"))
