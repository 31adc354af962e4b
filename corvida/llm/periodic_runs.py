"""Periodic runs of words: stretches in which a passage of any length is said three times or more on end."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import WORD_BYTES, unused

#: A run is at least this long and at least this many periods long.
LEAST, TIMES = 24, 3
SMALLEST_BLOCK = 8
#: Primes k * 2**m + 1 under 2**30 with a primitive root each: lengths up to 2**23 can be transformed.
PRIMES = ((998244353, 3), (469762049, 3), (167772161, 3))
#: Elements transformed at once.
AT_ONCE = 1 << 19


@cache
def _roots(prime: int, root: int, n: int, inverse: bool) -> tuple[np.ndarray, ...]:
    """For each level, from the widest butterfly down, the powers of its root of unity."""
    out, size = [], n
    while size > 1:
        step = pow(root, (prime - 1) // size, prime)
        step = pow(step, prime - 2, prime) if inverse else step
        powers = np.ones(1, dtype=np.uint64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(step, len(powers), prime)) % np.uint64(prime)])
        out.append(powers)
        size //= 2
    return tuple(out)


def _mod(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return x - x // p * p


def ntt(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    p, (rows, n) = np.uint64(prime), x.shape
    size = n
    for w in _roots(prime, root, n, False):
        x = x.reshape(rows, n // size, 2, size // 2)
        a, b = x[:, :, 0], x[:, :, 1]
        both, apart = a + b, a + (p - b)
        x = np.stack([np.minimum(both, both - p), _mod(apart * w, p)], axis=2)
        size //= 2
    return x.reshape(rows, n)


def inverse_ntt(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Rows back from bit-reversed transforms."""
    p, (rows, n) = np.uint64(prime), x.shape
    size = 2
    for w in reversed(_roots(prime, root, n, True)):
        x = x.reshape(rows, n // size, 2, size // 2)
        a, b = x[:, :, 0], _mod(x[:, :, 1] * w, p)
        both, apart = a + b, a + (p - b)
        x = np.stack([np.minimum(both, both - p), np.minimum(apart, apart - p)], axis=2)
        size *= 2
    return _mod(x.reshape(rows, n) * np.uint64(pow(n, prime - 2, prime)), p)


def zero_mismatch(block: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shifts k < B at which the sum of squared differences of a block (rows, B) and its window (rows, 2B), from
    k on, is zero. Values are integers from -1 up.

    The sum is that of both squares less twice a convolution, taken modulo primes whose product exceeds the largest sum
    there can be, so zero under all of them is zero. Further primes are only asked about rows that have a zero so far.
    """
    rows, size = block.shape
    most = size * (int(max(block.max(), window.max())) + 1) ** 2
    zero, left, product = np.ones((rows, size), dtype=bool), np.arange(rows), 1
    for prime, root in PRIMES:
        p = np.uint64(prime)
        u, w = (block[left] % prime).astype(np.uint64), (window[left] % prime).astype(np.uint64)
        squares = np.zeros((len(left), 2 * size + 1), dtype=np.uint64)
        np.cumsum(_mod(w * w, p), axis=1, out=squares[:, 1:])
        sums = _mod(u * u, p).sum(axis=1)[:, None] + squares[:, size : 2 * size] - squares[:, :size]
        backwards = np.zeros_like(w)
        backwards[:, :size] = u[:, ::-1]
        products = inverse_ntt(_mod(ntt(backwards, prime, root) * ntt(w, prime, root), p), prime, root)[:, size - 1 : 2 * size - 1]
        zero[left] &= _mod(sums + 2 * (p - products), p) == 0
        product *= prime
        left = np.flatnonzero(zero.any(axis=1))
        if product > most or not len(left):
            return np.nonzero(zero)
    raise ValueError("a text of more distinct words than the primes can tell apart")


def next_same(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the distance to the next one like it in its text; a very large one where there is none."""
    key = (text.astype(np.int64) << 32) | ids
    order = np.argsort(key, kind="stable")
    out = np.full(len(ids), 1 << 40, dtype=np.int64)
    same = key[order[1:]] == key[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretch(words: np.ndarray, at: int, size: int, d: int) -> tuple[int, int]:
    """The longest [start, end) around words [at, at + size), which recur d later, in which all words d apart are the same."""
    first, last, step = at, at + size, 64  # words[i] == words[i + d] holds for first <= i < last
    while first > 0:
        low = max(0, first - step)
        differ = np.flatnonzero(words[low:first] != words[low + d : first + d])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, step = low, step * 2
    step, end = 64, len(words) - d
    while last < end:
        high = min(end, last + step)
        differ = np.flatnonzero(words[last:high] != words[last + d : high + d])
        if len(differ):
            last += int(differ[0])
            break
        last, step = high, step * 2
    return first, last + d


def _extend(words: np.ndarray, at: np.ndarray, dist: np.ndarray, size: int, runs: list[tuple[int, int, int]]) -> None:
    """Adds to the runs (start, end, period) of a text those that seeds belong to. Seeds: a block at `at` (ascending)
    recurs `dist` later.

    Distances are taken in ascending order. A seed whose block and recurrence both lie in a known run with a period that
    divides the distance adds nothing: the stretch that it belongs to has that period, too, so it is that run.
    """
    done = np.zeros(len(at), dtype=bool)

    def settle(start: int, end: int, period: int) -> None:
        a, b = np.searchsorted(at, [start, end])
        done[a:b] |= (at[a:b] + size + dist[a:b] <= end) & (dist[a:b] % period == 0)

    for run in runs:
        settle(*run)
    for i in np.argsort(dist, kind="stable").tolist():
        if done[i]:
            continue
        d = int(dist[i])
        start, end = _stretch(words, int(at[i]), size, d)
        a, b = np.searchsorted(at, [start, end])
        done[a:b] |= (dist[a:b] == d) & (at[a:b] + size + d <= end)
        if end - start >= max(LEAST, TIMES * d):
            runs.append((start, end, d))
            settle(start, end, d)


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as word numbers (equal words equal, from 0 up, dense), its runs (start, length, smallest period).

    At block sizes B = 8, 16, 32, ... aligned blocks are sought at distances B + 1 to 2B, the smallest ones at 1 to 8 as
    well. A run of period q in (B, 2B] holds, before its last q words, 2q words at least (16 where q is 8 or less), hence a
    whole aligned block, and the block recurs q later. A block in which some word doesn't come again within 2B words can't
    recur in time, and isn't transformed.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return found
    firsts = np.cumsum(sizes) - sizes
    words, text = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
    ahead = next_same(words, text)
    size = SMALLEST_BLOCK
    while TIMES * (size + 1) <= sizes.max() or (size == SMALLEST_BLOCK and sizes.max() >= LEAST):
        lonely = np.concatenate([[0], np.cumsum(ahead > 2 * size)])
        at = np.arange(0, len(words) - size + 1, size)
        at = at[lonely[at + size] == lonely[at]]
        seeds = []
        for offset in (1, size + 1) if size == SMALLEST_BLOCK else (size + 1,):
            for part in np.split(at, range(AT_ONCE // (2 * size) or 1, len(at), AT_ONCE // (2 * size) or 1)):
                if not len(part):
                    continue
                places = part[:, None] + offset + np.arange(2 * size)
                end = (firsts + sizes)[text[part]][:, None]
                window = np.where(places < end, words[np.minimum(places, len(words) - 1)], -1)  # -1: like no word
                row, shift = zero_mismatch(words[part[:, None] + np.arange(size)], window)
                seeds.append(np.stack([part[row], offset + shift], axis=1))
        seeds = np.concatenate(seeds) if seeds else np.zeros((0, 2), dtype=np.int64)
        seeds = seeds[np.argsort(seeds[:, 0], kind="stable")]
        owners = text[seeds[:, 0]]
        edges = np.flatnonzero(np.diff(owners)) + 1
        for part in np.split(seeds, edges) if len(seeds) else []:
            t = int(text[part[0, 0]])
            first = int(firsts[t])
            _extend(words[first : first + int(sizes[t])], part[:, 0] - first, part[:, 1], size, found[t])
        size *= 2
    return [sorted(((s, e - s, q) for s, e, q in runs), key=lambda r: (r[0], r[2])) for runs in found]


def longest_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period, compared exactly; of equal ones the first, then that of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = 1 << 18) -> DataFrame:
    """One row per row of docs: the id, n_words, runs array<struct<start,length,period>> in order of start and period, best
    (the run of most repetitions, null without one) and collapsed, the text with one period of each run left, its words
    joined by one blank.

    A run is a stretch of consecutive words that repeats with a smallest period q, at least 24 words and 3 periods long,
    which no neighbour extends. A null or empty text has no words, no runs and an empty collapsed text. Ids that are null
    or repeat are rows like any other; other columns are left out; an empty table gives an empty result. Nothing is
    shuffled; texts of about `at_once` words together, or one longer text, are worked on at once, each in time about
    n log(n)^2 of its length.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))

    def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
        if runs:
            keep = np.ones(len(words), dtype=bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        return b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, value in enumerate(batch.column(1)):
                held.append(WORD_BYTES.findall((value.as_py() or "").encode()))
                size += len(held[-1])
                if size >= at_once or i + 1 == batch.num_rows:
                    runs = find_runs([_numbered(w) for w in held])
                    short = [collapsed(w, r).decode() for w, r in zip(held, runs, strict=True)]
                    columns = [
                        batch.column(0).slice(first, len(held)), pa.array([len(w) for w in held], type=pa.int64()),
                        pa.array([[named(x) for x in r] for r in runs], type=pa.list_(one)), pa.array([named(longest_of(r)) for r in runs], type=one), pa.array(short),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "best", "collapsed"])
                    first, held, size = i + 1, [], 0

    fields = "start: bigint, length: bigint, period: bigint"
    return chosen.mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<struct<{fields}>>, best struct<{fields}>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in which a tenth of the texts (by a checksum of the id) end in a repeated passage: with n words, a = g % n and
    p = 1 + (n - a) div (3 + g % 8), g the checksum over 10, words from a on repeat words a to a + p - 1. Rewritten texts
    have single blanks. Null ids and texts without a word stay as they are."""
    words, n, a, p, g = (unused(x, docs) for x in ("words", "n", "a", "p", "g"))
    sum_of = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.when(sum_of % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    full = docs.withColumn(words, chosen).withColumn(g, F.floor(sum_of / 10)).withColumn(n, F.size(words))
    full = full.withColumn(a, F.when(F.col(n) > 0, (F.col(g) % F.col(n)).cast("int")))
    full = full.withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))).cast("int"))
    passage = F.slice(words, F.col(a) + 1, F.col(p))
    tail = F.slice(F.flatten(F.array_repeat(passage, F.ceil((F.col(n) - F.col(a)) / F.col(p)).cast("int"))), F.lit(1), F.col(n) - F.col(a))
    text = F.when(F.col(a).isNotNull(), F.array_join(F.concat(F.slice(words, F.lit(1), F.col(a)), tail), " ")).otherwise(F.col(text_col))
    return full.withColumn(text_col, text).drop(words, n, a, p, g)


def digests(docs: DataFrame) -> DataFrame:
    """The runs of documents with planted ones, as doc_id, n_runs, the run of most repetitions, and digests of all runs and
    of the collapsed text."""
    line: Column = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return detect(with_planted_runs(docs)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
