"""Byte-level BPE: texts to ids and back, pre-tokens found by array scans instead of a regular expression."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a character is to the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: A text's end, beyond all code points.
STOP = 0x110000
#: What may follow an apostrophe in a contraction. Fixed values of the pattern.
AFTER_ONE = "stmd"
AFTER_TWO = ("re", "ve", "ll")

#: Symbols of the scan: a character's class together with what its next two characters decide.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LAST, S_SPACE, S_END = range(9)
#: States: what the pre-token is in which the character just read lies. FRESH: the next character begins a new one.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINED, TWO_LEFT, ONE_LEFT = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the next state, and whether a pre-token begins at the character."""
    to, begins = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=bool)
    for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        to[symbol], begins[symbol, [run, JOINED]] = run, False
    to[S_LETTER, TWO_LEFT], to[S_LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    begins[S_LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol, left in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):  # inside a run of others an apostrophe is one of them
        to[symbol] = left
        to[symbol, [IN_OTHERS, JOINED]], begins[symbol, [IN_OTHERS, JOINED]] = IN_OTHERS, False
    to[S_JOIN], to[S_LAST], to[S_SPACE], to[S_END] = JOINED, FRESH, IN_SPACES, FRESH
    begins[S_SPACE, IN_SPACES] = False
    return to, begins


TO, BEGINS = _machine()


@cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library's own edition of Unicode has it (newer than Python's)."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, STOP)]))
    table = np.full(STOP + 1, OTHER, dtype=np.uint8)
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(own.decode(own.encode_ordinary(every)).encode("utf-32-le"), dtype="<u4")] = cls
    table[STOP] = END
    return table


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of all characters but the last two, which are only looked at."""
    cls = classes()[codes]
    now, after = cls[:-2], cls[1:-1]
    out = now.copy()  # letters, numbers and others are their own symbols
    stands = (after != SPACE) & (after != END)
    out[now == SPACE] = S_SPACE
    out[(now == SPACE) & stands] = S_LAST
    out[(codes[:-2] == 0x20) & stands] = S_JOIN
    out[now == END] = S_END
    at = np.flatnonzero(codes[:-2] == 0x27)
    if len(at):
        one, two = codes[at + 1], codes[at + 2]
        out[at[np.isin(one, [ord(c) for c in AFTER_ONE])]] = S_SHORT
        pairs = (one.astype(np.int64) << 32) | two
        out[at[np.isin(pairs, [(ord(a) << 32) | ord(b) for a, b in AFTER_TWO])]] = S_LONG
    return out


def scan(symbol: np.ndarray, state: int, width: int = 256) -> tuple[np.ndarray, int]:
    """(whether a pre-token begins at each character, the state after the last one).

    Reading characters composes transition functions, which is associative: blocks of `width` characters are each reduced
    to one function of the state, all blocks side by side; the blocks' functions are scanned by doubling; then each block,
    its first state known, is read once more.
    """
    n = len(symbol)
    blocks = -(-n // width)
    grid = np.full(blocks * width, S_END, dtype=np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    reach = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    flat = TO.ravel()
    for row in grid:
        reach = flat[(row.astype(np.uint16) * 8)[:, None] + reach]
    step = 1
    while step < blocks:
        reach = np.concatenate([reach[:step], np.take_along_axis(reach[step:], reach[:-step].astype(np.intp), axis=1)])
        step *= 2
    now = np.concatenate([[state], reach[:-1, state]]).astype(np.uint8)
    states = np.empty_like(grid)
    for i, row in enumerate(grid):
        states[i] = now
        now = flat[row.astype(np.uint16) * 8 + now]
    before = states.T.ravel()[:n]
    last = int(TO[symbol[-1], before[-1]]) if n else state
    return BEGINS.ravel()[symbol.astype(np.uint16) * 8 + before], last


def starts(codes: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Where pre-tokens begin in texts that each end with STOP, the ends included. Scanned piece by piece, the state carried."""
    found, state = [], FRESH
    padded = np.concatenate([codes, np.full(2, STOP, dtype=codes.dtype)])
    for at in range(0, len(codes), at_once):
        begins, state = scan(symbols(padded[at : at + at_once + 2][: min(at_once, len(codes) - at) + 2]), state)
        found.append(np.flatnonzero(begins) + at)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of all neighbouring parts the pair of lowest rank is joined, the leftmost of equal ones, until
    none can be."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return _merge_long(piece, ranks) if len(piece) > 64 else _merge_short(piece, ranks)


NONE = 1 << 40


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != NONE:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pairs wait in a heap and parts are chained, so that a piece of a million bytes ends, too."""
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is named by its first byte
    alive, wait = [True] * n, []

    def offer(a: int) -> None:
        b = ends[a]
        if b < n and (rank := ranks.get(piece[a : ends[b]])) is not None:
            heapq.heappush(wait, (rank, a, ends[b]))

    for a in range(n - 1):
        offer(a)
    while wait:
        _, a, end = heapq.heappop(wait)
        b = ends[a]
        if not alive[a] or b >= n or ends[b] != end:
            continue  # one of the two was joined to another part since
        alive[b], ends[a] = False, end
        if end < n:
            before[end] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[piece[a : ends[a]]] for a in range(n) if alive[a]]


class Vocabulary:
    """Ranks of a file, and the ids of the pre-tokens met so far. What is remembered is bounded by `most` pieces and
    `most_bytes` bytes (and one round's pieces); it is speed alone, a forgotten piece is merged again."""

    def __init__(self, path: str, most: int = 1 << 19, most_bytes: int = 1 << 24):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.most, self.most_bytes = most, most_bytes
        by_id = {i: token for token, i in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.bounds, self.held = array("I"), array("q", [0]), 0  # ids of the remembered pieces, one after another

    def _remember(self, piece: bytes) -> int:
        found = self.place[piece] = len(self.bounds) - 1
        self.ids.extend(merge(piece, self.ranks))
        self.bounds.append(len(self.ids))
        self.held += len(piece)
        return found

    def encode_pieces(self, pieces: list[bytes], at_once: int = 1 << 18) -> np.ndarray:
        """The ids of pre-tokens, in order."""
        out = [np.zeros(0, dtype=np.uint32)]
        for at in range(0, len(pieces), at_once):
            get, part = self.place.get, pieces[at : at + at_once]
            places = np.array([get(p, -1) for p in part], dtype=np.int64)
            for i in np.flatnonzero(places < 0).tolist():
                found = get(part[i])
                places[i] = self._remember(part[i]) if found is None else found
            edges, ids = np.array(self.bounds, dtype=np.int64), np.array(self.ids, dtype=np.uint32)
            first, n = edges[places], edges[places + 1] - edges[places]
            out.append(ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            if len(self.place) > self.most or self.held > self.most_bytes:
                self.forget()
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and where each one's bytes end in the text's UTF-8."""
        codes = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), dtype="<u4"), np.array([STOP], dtype="<u4"))])
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        width[codes == STOP] = 0
        byte = np.cumsum(width, dtype=np.int64) - width
        begin = starts(codes)
        at = byte[begin[codes[begin] != STOP]].tolist()
        raw = "".join(texts).encode()
        ids = self.encode_pieces([raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])])
        ends = np.cumsum(self.sizes[ids])
        edges = byte[codes == STOP]
        cuts = np.concatenate([[0], np.searchsorted(ends, edges, side="right")])
        return [(ids[a:b], ends[a:b] - first) for a, b, first in zip(cuts, cuts[1:], np.concatenate([[0], edges]))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: every output byte is read at its token's place in the vocabulary plus its own within the token."""
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("ids that the vocabulary doesn't have")
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            n = self.sizes[part]
            out.append(self.bytes[np.repeat(self.firsts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values).astype(np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, at_once: int = 1 << 20) -> DataFrame:
    """One row per row of docs: the id, ids array<int> and ends array<int>, the byte at which each id's share of the
    text's UTF-8 ends (so that ids lead back to places in the text). Encodes whole texts by the ranks of a file, each match
    of the pattern separately, no special tokens.

    A null text counts as empty: empty arrays. Ids that are null or repeat are rows like any other; other columns are left
    out; an empty table gives an empty result. Nothing is shuffled. About `at_once` characters are worked on at once, or
    one text where that is longer.
    """
    path = ranks or default_ranks()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= at_once or i + 1 == batch.num_rows:
                    ids, ends = zip(*vocab.encode(texts))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), _lists(ids), _lists(ends)], names=["doc_id", "ids", "ends"])
                    first, texts, size = i + 1, [], 0

    return chosen.mapInArrow(run, f"doc_id {id_type}, ids array<int>, ends array<int>")


def decode(tokens: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """tokens with a further column: the bytes of each row's ids, binary, as ids of other sources need not be whole UTF-8.
    Null ids give null; ids that the vocabulary lacks, and null ones among them, raise."""
    path = ranks or default_ranks()

    @F.pandas_udf("binary")
    def of(ids: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return ids.map(lambda x: None if x is None else vocab.decode(np.asarray(x, dtype=np.int64)))

    return tokens.withColumn(bytes_col, of(F.col(ids_col)))


def sha256_of_ids(ids: Column) -> Column:
    """Lowercase hex of the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x).astype("<u4").tobytes()).hexdigest())

    return of(ids)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of each whole text's ids and of the bytes that they decode to."""
    coded = decode(encode(docs))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_of_ids(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
