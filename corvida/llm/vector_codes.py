"""Codes of vectors: each part of a vector becomes the index of the nearest entry of that part's codebook, codebooks are
refined in rounds, and distance bounds kept from round to round save most comparisons."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import Cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers under this are worked on as 64-bit ones, larger ones as Python's.
NARROW = 1 << 28
LIMB = 30
#: A part may need more of its near entries than are kept in about this share of cases; it is then scanned in full.
BEYOND = 0.01
STATE = "vec_id {id}, label {label}, parts array<double>, code binary, upper binary, near binary, lower binary, needed binary"


def integers(rows: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's where one of them is large."""
    return rows.astype(np.int64) if not rows.size or np.abs(rows).max() < NARROW else np.vectorize(int, otypes=[object])(rows)


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    return ((parts - entries) ** 2).sum(axis=-1)


def below(square: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are not above the roots."""
    if square.dtype == object:
        return round_down(np.vectorize(lambda s: float(min(math.isqrt(s), 1 << 16)), otypes=[float])(square))
    return round_down(np.sqrt(square.astype(float)) * (1 - 1e-15))


def above(square: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are not below the roots; infinite where they can't be."""
    if square.dtype == object:
        return round_up(np.vectorize(lambda s: float(min(math.isqrt(s) + 1, 1 << 17)), otypes=[float])(square))
    return round_up(np.sqrt(square.astype(float)) * (1 + 1e-15))


def round_down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(y > x, np.nextafter(y, np.float16(-np.inf)), y)


def round_up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype(np.float16)
    return np.where(y < x, np.nextafter(y, np.float16(np.inf)), y)


class Bounds:
    """What is kept of (n, PARTS) parts: the nearest entry, a bound above its distance, the `b` entries closest after it
    and bounds below the distances of these, in order; the last of the lower bounds is the outer one, that of all others."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, needed: np.ndarray):
        self.code, self.upper, self.near, self.lower, self.needed = code, upper, near, lower, needed


def scan(parts: np.ndarray, book: np.ndarray, place: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Exact distances of parts (m, width) to all entries of their part's codebook: code, upper, near, lower."""
    m, entries = len(parts), book.shape[1]
    code, upper, near, lower = np.zeros(m, np.uint8), np.zeros(m, np.float16), np.zeros((m, b), np.uint8), np.full((m, b + 1), np.inf, np.float16)
    for at in range(0, m, 1 << 13):
        some = slice(at, at + (1 << 13))
        square = squared(parts[some][:, None, :], book[place[some]])
        order = np.argsort(square, axis=1, kind="stable")[:, : b + 2]  # ties: the lower index first
        found = np.take_along_axis(square, order, axis=1)
        code[some], upper[some] = order[:, 0], above(found[:, 0])
        near[some, : min(b, entries - 1)] = order[:, 1 : b + 1]
        lower[some, : found.shape[1] - 1] = below(found[:, 1:])
    return code, upper, near, lower


def first_bounds(parts: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    n, p, width = parts.shape
    got = scan(parts.reshape(n * p, width), book, np.tile(np.arange(p), n), b)
    return Bounds(*(x.reshape(n, p, *x.shape[1:]) for x in got), np.zeros((n, p), np.uint8))


def next_bounds(old: Bounds, parts: np.ndarray, book: np.ndarray, moved: np.ndarray, b: int) -> Bounds:
    """Bounds after the entries moved by at most `moved` (PARTS, ENTRIES).

    The upper bound grows by what its entry moved, lower bounds shrink by what theirs did, the outer one by the largest
    move; a smallest-so-far from the outside in puts them in order. Where the upper bound is under the first lower one the
    entry stays. Elsewhere its exact distance is taken, and where that doesn't settle it, exact distances of the entries
    up to the first lower bound above it decide; where even the outer bound isn't above, those of all entries do.
    `needed` counts the near entries a part had to look at (b + 1: all).
    """
    n, p, width = parts.shape
    place = np.tile(np.arange(p), n)
    flat = parts.reshape(n * p, width)
    code, near, lower = old.code.ravel().copy(), old.near.reshape(n * p, -1), old.lower.reshape(n * p, -1).astype(float)
    kept = near.shape[1]
    upper = round_up(old.upper.ravel().astype(float) + moved[place, code])
    lower[:, :kept] -= moved[place[:, None], near]
    lower[:, kept] -= moved.max(axis=1)[place]
    lower = round_down(np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1])
    b = min(b, kept)
    near, lower = near[:, :b].copy(), lower[:, : b + 1].copy()  # the bound at b is under those of all entries dropped
    needed = np.zeros(n * p, np.uint8)
    open_ = np.flatnonzero(upper >= lower[:, 0])
    own = squared(flat[open_], book[place[open_], code[open_]])
    upper[open_] = above(own)
    reach = (lower[open_] <= upper[open_][:, None]).sum(axis=1)
    needed[open_] = reach
    for z in range(1, b + 1):
        at = open_[reach == z]
        if not len(at):
            continue
        looked = np.concatenate([code[at][:, None], near[at, :z]], axis=1)
        square = squared(flat[at][:, None, :], book[place[at][:, None], looked])
        by_index = np.argsort(looked, axis=1)
        looked, square = np.take_along_axis(looked, by_index, axis=1), np.take_along_axis(square, by_index, axis=1)
        order = np.argsort(square, axis=1, kind="stable")
        looked, square = np.take_along_axis(looked, order, axis=1), np.take_along_axis(square, order, axis=1)
        code[at], upper[at] = looked[:, 0], above(square[:, 0])
        near[at, :z], lower[at, :z] = looked[:, 1:], below(square[:, 1:])
    at = open_[reach == b + 1]
    if len(at):
        code[at], upper[at], near[at], lower[at] = scan(flat[at], book, place[at], b)
    shape = lambda x: x.reshape(n, p, *x.shape[1:])
    return Bounds(*map(shape, (code, upper, near, lower, needed)))


def _binary(x: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(x).reshape(len(x), -1).view(np.uint8)
    bounds = np.arange(len(x) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(bounds), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """A binary column of equally long values as an array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


def _parts_of(column: pa.Array, width: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, width))


def _first_pass(book: np.ndarray, width: int, b: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _state(batch, first_bounds(_parts_of(batch.column(2), width), book, b))

    return run


def _state(batch: pa.RecordBatch, x: Bounds) -> pa.RecordBatch:
    columns = [*batch.columns[:3], *map(_binary, (x.code, x.upper, x.near, x.lower, x.needed))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "parts", "code", "upper", "near", "lower", "needed"])


def _next_pass(book: np.ndarray, moved: np.ndarray, width: int, kept: int, b: int, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _parts_of(batch.column(2), width)
            old = Bounds(
                _matrix(batch.column(3), np.uint8, PARTS), _matrix(batch.column(4), np.float16, PARTS), _matrix(batch.column(5), np.uint8, PARTS, kept),
                _matrix(batch.column(6), np.float16, PARTS, kept + 1), _matrix(batch.column(7), np.uint8, PARTS),
            )
            new = next_bounds(old, parts, book, moved, b)
            if not last:
                yield _state(batch, new)
                continue
            errors = [int(e) for e in squared(parts, book[np.arange(PARTS)[None, :], new.code]).sum(axis=1)]
            codes = [c.tobytes().hex() for c in np.ascontiguousarray(new.code)]
            held = pa.array([e if e < 1 << 63 else None for e in errors], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, type=pa.string()), held], names=["vec_id", "label", "code", "error"])

    return run


def _sums(entries: int, width: int, limbs: int) -> Callable:
    """Sums and counts of the parts by their entries over a partition, one row per (part, entry, position, limb): numbers are
    told as limbs of 30 bits, so that sums of any size are exact in 64 bits. Position -1 holds the counts, part -1 those of
    how many near entries were needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, needed = np.zeros((PARTS * entries, width), dtype=object), np.zeros(PARTS * entries, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _parts_of(batch.column(0), width).reshape(-1, width)
            cell = (_matrix(batch.column(1), np.uint8, PARTS) + np.arange(PARTS)[None, :] * entries).ravel()
            counts += np.bincount(cell, minlength=len(counts))
            needed += np.bincount(_matrix(batch.column(2), np.uint8, PARTS).ravel(), minlength=256)
            some = np.zeros((len(counts), width), dtype=parts.dtype)
            np.add.at(some, cell, parts)
            total += some
        rows = [(-1, int(z), 0, 0, int(needed[z])) for z in np.flatnonzero(needed)]
        for c in np.flatnonzero(counts).tolist():
            part, entry = divmod(c, entries)
            rows.append((part, entry, -1, 0, int(counts[c])))
            for i in range(width):
                left = int(total[c, i])
                for limb in range(limbs - 1):
                    rows.append((part, entry, i, limb, left & ((1 << LIMB) - 1)))
                    left >>= LIMB
                rows.append((part, entry, i, limbs - 1, left))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "position", "limb", "value"])

    return run


def refined(state: DataFrame, book: np.ndarray, limbs: int) -> tuple[np.ndarray, dict[int, int]]:
    """Each entry becomes the floor of its parts' mean, those without parts stay; and how often how many near entries were
    needed. What comes to the driver is as large as the codebooks, whatever the table."""
    parts, entries, width = book.shape
    rows = state.select("parts", "code", "needed").mapInArrow(_sums(entries, width, limbs), "part int, entry int, position int, limb int, value long")
    new, needed = book.copy(), {}
    count, total = {}, {}
    for part, entry, position, limb, value in rows.groupBy("part", "entry", "position", "limb").agg(F.sum("value")).collect():
        if part < 0:
            needed[entry] = value
        elif position < 0:
            count[part, entry] = value
        else:
            total[part, entry, position] = total.get((part, entry, position), 0) + (value << (LIMB * limb))
    for (part, entry, position), value in total.items():
        new[part, entry, position] = value // count[part, entry]
    return new, needed


def movement(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far entries moved, not below the truth."""
    return above(squared(old, new)).astype(float)


def adapted(b: int, needed: dict[int, int], least: int) -> int:
    """Near entries to keep from now on: as many as all but a share BEYOND of the parts needed, `least` at least."""
    total = sum(needed.values())
    while b > least and sum(n for z, n in needed.items() if z >= b) <= BEYOND * total:
        b -= 1
    return b


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits for each of 16 parts), error (squared distance of the whole
    vector from what its code stands for), label_error (error summed over equal labels, nulls together), codebooks_sha256.

    Components x are floor(256 x). Vectors that are null, or hold null or non-finite components (or such as are not finite
    times 256), are left out. The dimension is the most frequent length (of equally frequent ones the smallest); vectors
    of another length, or all if it is zero or no multiple of 16, take no part and have a null code and error. Codebooks
    start as the vectors with the 64 smallest ids, repeated ids in order of their vectors, null ids never. Rows with null
    or repeated ids are coded like others. An error beyond 64 bits is null. Other columns are left out; an empty table
    gives an empty result.

    Each round is one pass over the rows: nothing of them is shuffled but sums of the size of the codebooks, which are also
    all that comes to the driver. A round's state is written to the shared folder and the one before removed.
    """
    if rounds < 1:
        raise ValueError("one round at least")
    scaled = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: F.lit(256.0) * x.cast("double")).alias("x"))
    usual = scaled.where(F.col("x").isNotNull() & F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    floors = F.transform("x", lambda v: F.rint(v) - F.when(F.rint(v) > v, 1.0).otherwise(0.0))  # whole doubles: a floor is cut at 64 bits
    kept = usual.select("vec_id", "label", floors.alias("parts"))
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    by_length = kept.groupBy(F.size("parts").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("parts", F.abs))).alias("most"))
    total, best = by_length.agg(F.sum("rows"), F.max(F.struct("rows", (-F.col("n")).alias("minus"), "most"))).first()
    dims = -best["minus"] if best else 0
    fits = kept.where(F.size("parts") == dims)
    first = fits.where("vec_id is not null").orderBy("vec_id", "parts").select("parts").limit(ENTRIES).collect() if dims and dims % PARTS == 0 else []
    uncoded = kept if not first else kept.where(F.size("parts") != dims)
    uncoded = uncoded.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return _with_label_error(uncoded, None)
    width, most = dims // PARTS, int(best["most"])
    book = integers(np.array([r[0] for r in first], dtype=float)).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    if most >= NARROW:
        book = book.astype(object)
    limbs = -(-(most.bit_length() + 1) // LIMB)
    b, least = min(ENTRIES // 4, len(first) - 1), min(ENTRIES // 8, len(first) - 1)
    schema, coded = STATE.format(id=id_type, label=label_type), f"vec_id {id_type}, label {label_type}, code string, error long"
    state, kept_near = Cut(fits.mapInArrow(_first_pass(book, width, b), schema), "codes"), b
    for done in range(rounds):
        new, needed = refined(state.df, book, limbs)
        moved, book = movement(book, new), new
        if done:
            b = adapted(b, needed, least)
        last = done + 1 == rounds
        after = Cut(state.df.mapInArrow(_next_pass(book, moved, width, kept_near, b, last), coded if last else schema), "codes")
        state.drop()
        state, kept_near = after, b
    return _with_label_error(state.df if total == best["rows"] else state.df.unionByName(uncoded), book_digest(book))


def _with_label_error(coded: DataFrame, digest: str | None) -> DataFrame:
    """Sums are taken by label before they meet the rows; a label of very many rows is one row on the sums' side, and the
    rows' side of that join is one that adaptive execution splits."""
    sums = Cut(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")).withColumnRenamed("label", "of_label"), "label_errors").df
    found = coded.join(sums, coded["label"].eqNullSafe(sums["of_label"]), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


#: The same rows by DuckDB, for vectors of 64 components that are not null.
ORACLE = """
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, p, x[p * 4 + 1:p * 4 + 4] as v from kept, range(16) t(p)),
book0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as entry, v from parts
  where vec_id in (select vec_id from kept order by vec_id limit 64)),
""" + "".join(
    f"""
near{r} as materialized (
  select vec_id, label, p, any_value(v) as v, min(d * 64 + entry) % 64 as entry, min(d * 64 + entry) // 64 as d from (
    select a.vec_id, a.label, a.p, a.v, c.entry, cast((a.v[1] - c.v[1]) * (a.v[1] - c.v[1]) + (a.v[2] - c.v[2]) * (a.v[2] - c.v[2])
      + (a.v[3] - c.v[3]) * (a.v[3] - c.v[3]) + (a.v[4] - c.v[4]) * (a.v[4] - c.v[4]) as bigint) as d
    from parts a join book{r} c on a.p = c.p) group by vec_id, label, p),
""" + (f"""
mean{r} as (
  select p, entry, list((s - ((s % n) + n) % n) // n order by i) as v from (
    select p, entry, i, cast(sum(v[i]) as bigint) as s, count(*) as n from near{r}, range(1, 5) t(i) group by p, entry, i) group by p, entry),
book{r + 1} as materialized (select c.p, c.entry, coalesce(m.v, c.v) as v from book{r} c left join mean{r} m on c.p = m.p and c.entry = m.entry),
""" if r < ROUNDS else "")
    for r in range(ROUNDS + 1)
) + f"""
coded as (
  select vec_id, label, string_agg(printf('%02x', entry), '' order by p) as code, cast(sum(d) as bigint) as error from near{ROUNDS} group by vec_id, label),
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, entry)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, digest
"""  # fmt: skip
