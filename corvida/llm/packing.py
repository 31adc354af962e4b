"""Packing: documents along a Hilbert curve, cut into sequences without padding inside."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import cut

DIMS, ORDER_BITS, BUCKETS = 4, 12, 256
_ENCODINGS: dict[str, object] = {}
#: How byte-level BPE files write bytes: printable ones as themselves, the others as characters from 256 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoding(path: str):
    """The byte-level BPE vocabulary of a tokenizers file, applied by tiktoken: the same ids (held against each other in
    the tests) at about a quarter of the CPU time. The place of a token in the file's merges is its id's order. The
    file's added tokens are tiktoken's special ones, see encode()."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        if odd := [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
            raise ValueError(f"added tokens that take in or look at what is beside them: {odd}")
        rest = [b for b in range(256) if b not in set(PRINTABLE)]
        as_byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}
        specials = {t["content"]: t["id"] for t in added}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in specials and all(c in as_byte for c in token)}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    return _ENCODINGS[path]


def encode(enc, text: str) -> list[int]:
    """The ids of a text. An added token in it is one id, as the tokenizers library has it."""
    if any(t in text for t in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all", disallowed_special=())
    return enc.encode_ordinary(text)


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, dims) with integer coordinates under 2 ** bits: the coordinates' bits are
    turned, from the highest plane down, into those of the curve's own frame, then Gray-decoded and interleaved."""
    x = x.astype(np.int64).copy()
    n, dims = x.shape
    plane = 1 << (bits - 1)
    while plane > 1:
        below = plane - 1
        for d in range(dims):
            is_set = (x[:, d] & plane) != 0
            swap = np.where(is_set, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(is_set, below, swap)
            x[:, d] ^= swap
        plane >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, dtype=np.int64)
    plane = 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where((x[:, -1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def _projection(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, BUCKETS, 1 << 17), rng.choice([-1.0, 1.0], 1 << 17), rng.normal(0, 1, (BUCKETS, DIMS))


def curve_place(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert key of hashed document vectors: to unit length, onto a few fixed random directions, each projection to
    its share under the normal curve (logistic form), so that cells fill evenly whatever the corpus."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    z = vectors @ directions / np.maximum(norm, 1e-12)
    share = 1 / (1 + np.exp(-1.702 * z))
    return hilbert_key(np.minimum((share * (1 << ORDER_BITS)).astype(np.int64), (1 << ORDER_BITS) - 1), ORDER_BITS)


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        bucket, sign, directions = _projection()
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids_of, n_of, vectors, out, size = [], [], [], [], 0
            names = batch.column(0).to_pylist()

            def flush() -> pa.RecordBatch:
                keys = curve_place(np.stack(vectors), directions)
                made = pa.RecordBatch.from_arrays([pa.array(out, type=pa.int64()), pa.array(keys), pa.array(n_of, type=pa.int64()), pa.array(ids_of, type=pa.binary())], names=["doc_id", "key", "n", "ids"])
                for x in (ids_of, n_of, vectors, out):
                    x.clear()
                return made

            for name, value in zip(names, batch.column(1), strict=True):
                text = value.as_py() or ""
                ids = np.append(np.array(encode(enc, text), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                vectors.append(np.bincount(bucket[ids], weights=sign[ids], minlength=BUCKETS))
                ids_of.append(squeeze.compress((ids.astype("<u2") if enc.n_vocab <= 1 << 16 and end_id < 1 << 16 else ids).tobytes()))
                n_of.append(len(ids))
                out.append(name)
                size += len(ids)
                if size > 1 << 20:
                    yield flush()
                    size = 0
            if out:
                yield flush()

    return run


def _pieces(length: int):
    """The rows of a partition, in order, cut at multiples of `length`. What is left at the end goes into sequences whose
    sizes are the powers of two that add up to it, so that it takes no padding either."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "curve_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36  # no partition holds as many sequences
        expand = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # what of the current sequence has come so far: doc, start, ids, doc tokens, key
        filled, sequence = 0, 0

        def close(parts: list[tuple], size: int) -> list[tuple]:
            nonlocal sequence
            rows, at = [], 0
            for doc, start, ids, total, key in parts:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + sequence, at, size, key))
                at += len(ids)
            sequence += 1
            return rows

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            docs, keys, counts, packed = (batch.column(i).to_pylist() for i in range(4))
            for doc, key, n, data in zip(docs, keys, counts, packed, strict=True):
                raw = expand.decompress(data)
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")
                start = 0
                while start < n:
                    take = min(n - start, length - filled)
                    held.append((doc, start, ids[start : start + take], n, key))
                    start, filled = start + take, filled + take
                    if filled == length:
                        rows += close(held, length)
                        held, filled = [], 0
            if len(rows) > 20_000:
                yield table(rows)
                rows = []
        while filled:
            size, got, part = 1 << (filled.bit_length() - 1), 0, []
            while got < size:
                doc, start, ids, n, key = held.pop(0)
                take = min(len(ids), size - got)
                part.append((doc, start, ids[:take], n, key))
                if take < len(ids):
                    held.insert(0, (doc, start + take, ids[take:], n, key))
                got += take
            rows += close(part, size)
            filled -= size
        if rows:
            yield table(rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, tokenizer: str | None = None, end_id: int = 1, at_once: int = 32 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, curve_key.

    Each whole text is tokenized once; its hashed token vector, projected to four dimensions, has a place on a Hilbert
    curve. Documents are range-partitioned and sorted by that place (ties by id, so that thousands of copies spread),
    and each partition, of about `at_once` bytes of ids, packs its own run of the curve into full sequences. Sequence ids
    are unique, in curve order, with gaps between partitions. A null or empty text is one end id. Rows with null or repeated ids are packed like
    any other; other columns are left out; an empty table gives an empty result. `length` is a power of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length is a power of two")
    path = tokenizer or default_tokenizer()
    ids = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_tokenize(path, end_id), "doc_id long, key long, n long, ids binary"), "ids")
    size = ids.agg(F.sum(F.octet_length("ids") + 24)).first()[0] or 0
    along = ids.repartitionByRange(max(1, -(-size // at_once)), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, curve_key long"
    return along.mapInArrow(_pieces(length), names)
