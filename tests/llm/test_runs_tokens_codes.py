"""Periodic runs, byte-level BPE and vector codes against plain versions of the same."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("corvida.llm")
from corvida.llm import byte_bpe, periodic_runs, queries, vector_codes

SF = "/root/testdata/sf0.001"


def numbered(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def plain_runs(words):
    """(start, length, period) of all runs, by comparing words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made_of_repeats(rng):
    words = []
    while len(words) < rng.randrange(0, 500):
        letters = rng.choice([1, 2, 2, 3, 50])
        kind = rng.randrange(5)
        if kind == 0:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        elif kind == 1:
            p = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
            words += (p * 9)[: rng.randrange(1, 9 * len(p))]
        elif kind == 2:  # runs inside runs
            p = [rng.randrange(letters) for _ in range(rng.randrange(1, 5))]
            q = (p * 20)[: rng.randrange(20, 50)] + [99]
            words += (q * 5)[: rng.randrange(1, 5 * len(q))]
        elif kind == 3 and words:
            words += words[-rng.randrange(1, len(words) + 1) :] * rng.randrange(1, 4)
        else:
            words.append(rng.randrange(1000))
    return words[:900]


def test_runs_of_repetitive_words():
    rng = random.Random(5)
    texts = [made_of_repeats(rng) for _ in range(150)] + [[], [1], [7] * 23, [7] * 24, [1, 2] * 12, [1, 2, 3] * 8, list(range(9)) * 3, list(range(8)) * 3, list(range(8)) * 2 + list(range(7))]
    got = periodic_runs.find_runs([numbered(t) for t in texts])
    assert got == [plain_runs(t) for t in texts]
    assert sum(map(len, got)) > 200


def test_squared_differences_need_all_primes():
    """Sums of squares beyond one prime and beyond two; some windows differ by such multiples that one prime sees no difference."""
    rng = np.random.default_rng(2)
    first = periodic_runs.PRIMES[0][0]
    for top in (3, 10**6, 10**9):
        block = rng.integers(0, top, (40, 16))
        window = rng.integers(-1, top, (40, 32))
        for r in range(0, 40, 2):
            window[r, r % 16 : r % 16 + 16] = block[r]
            if r % 4 and top > first:
                window[r, r % 16] = block[r, 0] = 0
                window[r, r % 16] += first
        want = [(r, k) for r in range(40) for k in range(16) if (block[r] == window[r, k : k + 16]).all()]
        assert list(zip(*(x.tolist() for x in periodic_runs.zero_mismatch(block, window)))) == want and want


def contract_of_runs(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


def test_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[c for c in ("doc_id", "text")])
    odd = ["", None, " \n", "x " * 30, "é x y z\x0bw " * 9, "a b c d e f g h i " * 3, "one two"]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd * 20)] + [(None, "a " * 40)], "doc_id long, text string")
    both = docs.unionByName(more)
    want = sorted((str(d), *contract_of_runs(d, t)) for d, t in both.collect())
    got = periodic_runs.digests(both)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted((str(r[0]), *r[1:]) for r in got.collect())
    assert [repr(r) for r in rows] == [repr(r) for r in sorted(want)]
    assert sum(r[1] > 0 for r in rows) > 20


def test_runs_with_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "x", 1)], "doc_id long, text string, words string, n int")
    row = periodic_runs.detect(periodic_runs.with_planted_runs(docs)).first()
    assert row.runs == [(0, 40, 2)] and row.best == (0, 40, 2) and row.collapsed == "a b" and row.n_words == 40
    assert periodic_runs.digests(docs.limit(0)).collect() == []


def own_tiktoken():
    import public_tokenizers
    import tiktoken

    vocab = byte_bpe.vocabulary(byte_bpe.default_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_ids_of_all_kinds_of_characters():
    rng, enc, vocab = random.Random(1), own_tiktoken(), byte_bpe.vocabulary(byte_bpe.default_ranks())
    letters = "ab'st revlmd'  \n\t  1२.,!é漢😀　Ᲊ́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["", "'", "a'", "  ", "a  ", "x'll''s'd's", "a" * 5000, "ab" * 3000 + "  \n " * 500, "'re've 'll' 's", "<|endoftext|>", "\x00a\x00"]
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(chr(rng.choice(every)) for _ in range(50)) for _ in range(300)]
    got = vocab.encode(texts)
    for text, (ids, ends) in zip(texts, got, strict=True):
        raw = text.encode()
        assert ids.tolist() == enc.encode_ordinary(text)
        assert vocab.decode(ids.astype(np.int64)) == raw
        assert b"".join(raw[a:b] for a, b in zip([0, *ends[:-1]], ends)) == raw


def test_pieces_of_a_scan_meet(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("a'sll re've  \n1") for _ in range(5000))
    codes = np.array([*map(ord, text), byte_bpe.STOP], dtype="<u4")
    whole = byte_bpe.starts(codes).tolist()
    for at_once in (3, 256, 1000):
        assert byte_bpe.starts(codes, at_once).tolist() == whole


def test_long_merges_equal_short_ones():
    rng, ranks = random.Random(4), byte_bpe.vocabulary(byte_bpe.default_ranks()).ranks
    for _ in range(300):
        piece = bytes(rng.choice(b"abcesthrn") for _ in range(rng.randrange(1, 90)))
        assert byte_bpe._merge_long(piece, ranks) == byte_bpe._merge_short(piece, ranks)


def test_a_small_memory_changes_no_id():
    texts = ["some words and more words, " * 5, "other ones 123 " * 7, "x" * 300]
    small = byte_bpe.Vocabulary(byte_bpe.default_ranks(), most=2, most_bytes=8)
    enc = own_tiktoken()
    for _ in range(2):
        assert [i.tolist() for i, _ in small.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_tokens_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "x"), (None, "", "x"), (3, "twice", None)], "doc_id long, text string, lang string")).withColumnRenamed("lang", "ids")
    enc = own_tiktoken()

    def plain(text):
        ids = enc.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.digests(docs).collect()) == sorted((str(d), *plain(t)) for d, t in docs.select("doc_id", "text").collect())
    assert byte_bpe.digests(docs.limit(0)).collect() == []


def plain_codes(rows, rounds=2):
    """{vec_id: (code, error)}, digest of the codebooks: every distance in Python's integers."""
    from fractions import Fraction

    kept = [(i, [int(Fraction(x) * 256 // 1) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // 16
    parts = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(16)]
    cut = [(i, parts(v)) for i, v in kept]
    books = [[parts(v)[p] for _, v in sorted(kept)[:64]] for p in range(16)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            members = {}
            for _, x in cut:
                members.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for k, m in members.items():
                books[p][k] = tuple(sum(c) // len(m) for c in zip(*m))
    out = {i: [nearest(x[p], books[p]) for p in range(16)] for i, x in cut}
    return {i: ("".join("%02x" % k for _, k in v), sum(d for d, _ in v)) for i, v in out.items()}, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("scale,rows", [(1.0, 150), (0.004, 150), (1.0, 5), (3e6, 80)])
def test_codes_of_any_scale(spark, scale, rows):
    """Ordinary values; ones that floor to few integers, so that distances tie; fewer vectors than entries; large values."""
    rng = np.random.default_rng(rows)
    data = [(i, [float(x) for x in (rng.normal(size=32) * scale).astype(np.float32)], i % 3 or None) for i in range(rows)]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    want, digest = plain_codes([(i, v) for i, v, _ in data])
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    for label in (None, 1, 2):
        total = sum(want[i][1] for i, _, x in data if x == label)
        assert all(got[i].label_error == total for i, _, x in data if x == label)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=16)], "a") for i in range(70)]
    odd = [(100, None, "a"), (101, [None] * 16, "a"), (102, [float("nan")] * 16, "a"), (103, [float("inf")] * 16, None), (104, [1.0] * 8, None), (None, good[0][1], None), (5, good[6][1], "b"), (105, [], "b")]
    table = spark.createDataFrame(good + odd, "vec_id int, embedding array<double>, label string").selectExpr("*", "1 as code", "2 as of_label")
    rows = vector_codes.compress(table).collect()
    assert len(rows) == 73 + 1 and {r.vec_id for r in rows} == {*range(70), 104, 105, None}
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    assert by[104][0].code is None and by[105][0].error is None and by[None][0].code == by[0][0].code and len(by[5]) == 2
    assert vector_codes.compress(table.limit(0)).collect() == []
    assert [r.code for r in vector_codes.compress(table.where("vec_id = 104")).collect()] == [None]


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(9)
    centres = rng.integers(-300, 300, (64, 16, 4))
    parts = centres[rng.integers(0, 64, 4000)] + rng.integers(-20, 20, (4000, 16, 4))
    book = parts[:64].transpose(1, 0, 2).copy()
    bounds = vector_codes.first_bounds(parts, book, 16)
    b = 16
    for turn in range(4):
        square = vector_codes.squared(parts[:, :, None, :], book[None])
        root = np.sqrt(square.astype(float))
        cells = np.arange(4000)[:, None], np.arange(16)[None, :]
        assert (bounds.code == square.argmin(axis=2)).all()
        assert (bounds.upper >= root[(*cells, bounds.code)]).all()
        assert (bounds.lower[:, :, :-1] <= np.take_along_axis(root, bounds.near.astype(int), axis=2)).all()
        others = root.copy()
        np.put_along_axis(others, bounds.near.astype(int), np.inf, axis=2)
        np.put_along_axis(others, bounds.code[:, :, None].astype(int), np.inf, axis=2)
        assert (bounds.lower[:, :, -1] <= others.min(axis=2)).all()
        if turn:
            compared = np.where(bounds.needed > b, 64, bounds.needed + (bounds.needed > 0))
            assert (bounds.needed == 0).mean() > 0.5 and compared.mean() < 64 * 0.35
            b = vector_codes.adapted(b, {int(z): int(n) for z, n in zip(*np.unique(bounds.needed, return_counts=True))}, 8)
        new = book.copy()
        for p in range(16):
            for k in range(64):
                if (bounds.code[:, p] == k).any():
                    new[p, k] = parts[bounds.code[:, p] == k, p].sum(axis=0) // (bounds.code[:, p] == k).sum()
        bounds, book = vector_codes.next_bounds(bounds, parts, new, vector_codes.movement(book, new), b), new


def test_registered():
    assert {"op11_block_convolution_runs", "op12_scanned_byte_bpe", "op13_bounded_vector_codes"} <= set(queries.QUERIES)
