"""SimHash near-duplicates over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import WORD_BYTES, cut, unused
from corvida.llm.components import connected_components

BITS = 64
#: Children of a node; fingerprints of a top node, as long as there are at most MOST_NODES of these; what a task gathers before it passes it on.
FAN, NODE, MOST_NODES, HELD = 8, 1 << 14, 4096, 1 << 18


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A-Z lower-cased, words of any script, word shingles with repeats; fewer words than a shingle: the whole
    sequence; no word or null: 0. A bit is 1 if it is set in over half of the shingles' XXH64 values."""
    words = WORD_BYTES.findall(text.encode().lower()) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(BITS, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8")
    for at in range(0, len(packed), 1 << 16):
        counts += np.unpackbits(packed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(packed), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_udf(shingle: int = 3):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return of


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence, in which neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest place that it reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


class GrayTree:
    """An index over distinct fingerprints in Gray order. FAN neighbours have a node above them that holds the bits in
    which they all agree, FAN of these nodes the next one, and so on. In Gray order neighbours differ in few bits
    wherever a run begins, so a run keeps most of its leading bits in common. A node's own bits are those that the one
    above it doesn't hold yet."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints[np.argsort(gray_rank(prints), kind="stable")]
        low = high = self.prints
        patterns, shared = [low], [np.full(len(low), ~np.uint64(0))]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            patterns.append(low)
            shared.append(low | ~high)
        #: from the top down: pattern and own bits of each node; the lowest level is the fingerprints
        self.levels = [(patterns[i], shared[i] & ~np.repeat(shared[i + 1], FAN)[: len(shared[i])] if i + 1 < len(shared) else shared[i]) for i in range(len(shared) - 1, -1, -1)]

    def near(self, asked: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in asked, place in prints) of all pairs within `distance` bits. From the top down, the bits in which a
        query differs from a node's own pattern add up, and with the sum over `distance` the whole node is pruned."""
        who = np.repeat(np.arange(len(asked)), len(self.levels[0][0]))
        node = np.tile(np.arange(len(self.levels[0][0])), len(asked))
        apart = np.zeros(len(who), dtype=np.uint8)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                who, apart = np.repeat(who, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(pattern)
                who, node, apart = who[real], node[real], apart[real]
            apart = apart + np.bitwise_count((asked[who] ^ pattern[node]) & own[node])
            kept = apart <= distance
            who, node, apart = who[kept], node[kept], apart[kept]
        return who, node


def _place(prints: pd.Series) -> pd.Series:
    """Gray rank of each fingerprint, moved so that it sorts as a signed number."""
    return pd.Series((gray_rank(prints.to_numpy(np.int64).view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))


def _deal(tops: np.ndarray, pattern: np.ndarray, shared: np.ndarray, distance: int):
    """Rows (node, is_query, prints): a task's fingerprints as parts of their own top nodes, and as queries of each other
    top node whose shared bits leave room for a link. Of two top nodes only one asks the other, by turns."""
    schema = pa.schema([("node", pa.int64()), ("is_query", pa.bool_()), ("prints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            own, prints = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            out = [(int(n), False, prints[own == n].tobytes()) for n in np.unique(own)]
            asks: dict[int, list[np.ndarray]] = {}
            for at in range(0, len(prints), 4096):
                x, mine = prints[at : at + 4096], own[at : at + 4096]
                asker = np.where(tops[None, :] > mine[:, None], (tops[None, :] + mine[:, None]) % 2 == 1, (tops[None, :] + mine[:, None]) % 2 == 0) & (tops[None, :] != mine[:, None])
                who, node = np.nonzero(asker & (np.bitwise_count((x[:, None] ^ pattern[None, :]) & shared[None, :]) <= distance))
                order = np.argsort(node, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(part):
                        asks.setdefault(int(tops[node[part[0]]]), []).append(x[who[part]])
            out += [(n, True, np.concatenate(parts).tobytes()) for n, parts in asks.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(x) for x, _ in held) >= HELD:
                yield rows()
        if held:
            yield rows()

    return run


def _search(distance: int):
    """Rows of one top node come together, its parts first; then each row of queries is searched for in its tree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(tree: GrayTree, asked: np.ndarray, inside: bool) -> pa.RecordBatch | None:
        pairs = []
        for at in range(0, len(asked), 1024):
            part = asked[at : at + 1024]
            who, place = tree.near(part, distance)
            other = (who + at < place) if inside else np.ones(len(who), dtype=bool)
            pairs.append(np.stack([part[who[other]], tree.prints[place[other]]]).view(np.int64))
            if sum(p.shape[1] for p in pairs) > HELD:
                pairs = [_star(np.concatenate(pairs, axis=1))]
        found = _star(np.concatenate(pairs, axis=1)) if pairs else np.empty((2, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=schema) if found.shape[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, parts, tree = None, [], None

        def grow() -> Iterator[pa.RecordBatch]:
            nonlocal tree
            if node is not None and tree is None:
                tree = GrayTree(np.concatenate(parts))
                found = stars(tree, tree.prints, True)
                if found is not None:
                    yield found

        for batch in batches:
            for at, is_query, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                prints = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if at != node:
                    yield from grow()
                    node, parts, tree = at, [], None
                if not is_query:
                    parts.append(prints)
                    continue
                yield from grow()
                found = stars(tree, prints, False)
                if found is not None:
                    yield found
        yield from grow()

    return run


def _star(pairs: np.ndarray) -> np.ndarray:
    """(2, n) links, reduced to one from each value to the smallest that it reaches."""
    values, place = np.unique(pairs, return_inverse=True)
    root = _roots(len(values), *place.reshape(pairs.shape)) if len(values) else np.empty(0, dtype=np.int64)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([values[moved], values[root[moved]]])


def fingerprint_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """prints: (fp long), distinct and not null. Returns links (a, b) between fingerprints that join exactly those within
    `distance` bits; what a task finds is reduced to stars.

    The fingerprints are range-sorted by Gray rank into top nodes of about NODE each (MOST_NODES at most, so that their
    patterns, all that reaches the driver and every task, have a fixed bound). A fingerprint goes to its own top node
    and, as a query, to those others whose shared bits differ from its own in `distance` bits at most. There it descends
    a GrayTree. A fingerprint occurs once, and at most 2,081 others lie within two bits, so there is no hot group.
    """
    n = prints.count()
    if not n:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    nodes = min(MOST_NODES, -(-n // NODE))
    sorted_ = prints.select("fp", F.pandas_udf(_place, "long")("fp").alias("place")).repartitionByRange(nodes, "place").sortWithinPartitions("place")
    placed = cut(sorted_.select(F.spark_partition_id().cast("long").alias("node"), "fp"), "placed")
    tops = placed.groupBy("node").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")).orderBy("node").collect()
    number, low, high = (np.array([r[i] for r in tops], dtype=np.int64) for i in range(3))
    low, high = low.view(np.uint64), high.view(np.uint64)
    dealt = placed.mapInArrow(_deal(number, low, low | ~high, distance), "node long, is_query boolean, prints binary")
    return dealt.repartition(nodes, "node").sortWithinPartitions("node", "is_query").mapInArrow(_search(distance), "a long, b long")


def _components(prints: DataFrame, distance: int) -> DataFrame:
    """prints: (doc_id, fp). (fp, root, component_id) of every fingerprint that a row with an id has: root, the smallest
    fingerprint that it reaches, names the component; component_id is the smallest id there. The links join fingerprints,
    not ids: one id may stand on rows of several components."""
    classes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), distance))
    placed = cut(classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "placed")
    return cut(placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"), "known")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at
    most `distance` bits).

    Ids are integers. A null or empty text has fingerprint zero and links like any other. Rows with the same id each
    keep their row and are linked by their fingerprints alone. A row with a null id takes its fingerprint's component,
    null if no row with an id reaches it. Other columns of the input are left out. Empty input gives an empty result.
    """
    prints = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")), "prints")
    return prints.join(_components(prints, distance), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """docs without those that are not the first of their component: the first row by id, fingerprint and hash of the
    text stays, and of several rows that agree in all three the first by a hash of the whole row. An id may stay more
    than once, with texts of different components. Rows with a null id can't be told apart and all stay. All columns stay.

    The texts move once, hashed against the kept ids and text hashes of their partition. Only rows that occur more than
    once, if there are any, are then reduced to one each.
    """
    text_hash = F.xxhash64(F.col(text_col))
    kept_id, kept_hash, place = unused("kept_id", docs), unused("kept_hash", docs), unused("place", docs)
    prints = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_udf()(F.col(text_col)).alias("fp"), text_hash.alias("text_hash")), "prints")
    rows = prints.where("doc_id is not null").groupBy("doc_id", "fp", "text_hash").agg(F.count("*").alias("n"))
    first = rows.join(_components(prints, distance), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_hash", "n")).alias("first"))
    kept = cut(first.select("first.*"), "kept")
    ids = lambda which: which.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).hint("shuffle_hash")
    by_row = (F.col(id_col).cast("long") == F.col(kept_id)) & (text_hash == F.col(kept_hash))
    out = docs.join(ids(kept.where("n = 1")), by_row, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if not kept.where("n > 1").isEmpty():
        same = docs.join(ids(kept.where("n > 1")), by_row, "left_semi")
        order = Window.partitionBy(F.col(id_col).cast("long"), text_hash).orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in docs.columns]))))
        out = out.unionByName(same.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place))
    return out
