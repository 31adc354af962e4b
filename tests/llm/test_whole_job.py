"""Cases in which an operator once did less than its whole job."""

import zlib

import numpy as np
import pytest

pytest.importorskip("corvida.llm")
from corvida.llm import chat_format, hnsw_dedup, mixing, packing, quality_classifier, simhash


def test_lone_pairs_beside_groups_of_near_copies_are_found(monkeypatch):
    rng = np.random.default_rng(8)
    groups = np.repeat(rng.normal(size=(15, 64)), 28, axis=0)
    lone = np.repeat(rng.normal(size=(46, 64)), 2, axis=0)
    x = np.concatenate([groups, lone])
    x = (x + 0.02 * rng.normal(size=x.shape))[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.98
    assert (true.sum(axis=1) == 2).sum() == 92 and (true.sum(axis=1) == 28).sum() == 420
    graph, search = hnsw_dedup.build(x), hnsw_dedup.beam_search

    def blind(unit, links, q, entry, width):
        """A beam that misses lone pairs."""
        ids, sims = search(unit, links, q, entry, width)
        lost = ((q @ unit.T >= 0.98).sum(axis=1) == 2)[:, None] & (width >= hnsw_dedup.BEAM)
        return np.where(lost, -1, ids), np.where(lost, -np.inf, sims)

    monkeypatch.setattr(hnsw_dedup, "beam_search", blind)
    q, c = (np.concatenate(v) for v in zip(*hnsw_dedup.linked(graph, x, x, 0.98)))
    found = np.zeros(true.shape, dtype=bool)
    found[q, c] = True
    assert (found == true).all() and len(q) == true.sum()


def test_beams_alone_find_links():
    """Without the audit's scan: lone pairs and groups of near copies among single vectors."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(300, 64)), 2, axis=0), np.repeat(rng.normal(size=(30, 64)), 20, axis=0), rng.normal(size=(1500, 64))])
    x = (x + 0.05 * rng.normal(size=x.shape))[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.98
    graph, q = hnsw_dedup.build(x), x.astype(np.float32)
    found = hnsw_dedup._wider(graph, q, hnsw_dedup.descend(hnsw_dedup.Graph(graph.unit, graph.levels[:-1]), q), hnsw_dedup.BEAM, 0.98)
    others = true & ~np.eye(len(x), dtype=bool)
    assert others.sum() > 10_000 and (found & others).sum() >= 0.99 * others.sum()
    lone = others.sum(axis=1) == 1
    assert lone.sum() > 500 and (found & others)[lone].sum() >= 0.99 * lone.sum()


def test_ids_that_are_null_or_repeat_and_vectors_of_any_length(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    rows = [(1, a, 0), (1, b, 0), (None, a, 0), (4, [v * 1e-170 for v in b], 0), (5, [v * 1e170 for v in a], 0), (6, a, None), (7, a, 1), (8, [0.0] * 3, 0), (9, None, 0), (9, [-v for v in a], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in hnsw_dedup.near_vectors(table).collect())
    assert got == sorted([("1", 3, 1), ("1", 3, 1), ("None", 0, None), ("4", 3, 1), ("5", 3, 1), ("6", 0, 6), ("7", 0, 7), ("8", 0, 8), ("9", 0, 9), ("9", 0, 9)])


def test_repeated_ids_keep_one_row_of_each_component(spark):
    a, b, c = "one two three four five six", "alpha beta gamma delta epsilon zeta", "red green blue black white grey"
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, other string")
    kept = lambda rows: sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(table(rows)).collect())
    assert kept([(5, a, "x"), (5, b, "x"), (3, a, "x")]) == [(3, a), (5, b)]
    assert kept([(5, a, "x"), (5, b, "x")]) == sorted([(5, a), (5, b)])
    assert kept([(5, a, "x"), (5, a, "y"), (5, b, "x"), (7, b, "x"), (8, c, "x")]) == sorted([(5, a), (5, b), (8, c)])
    rows = [(5, a, "x"), (5, a, "y"), (5, a, "z")]
    assert len({simhash.drop_near_copies(table(r)).collect()[0].other for r in (rows, rows[::-1], rows[1:] + rows[:1])}) == 1
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(table([(5, a, "x"), (5, b, "x"), (3, a, "x")])).collect()} == {(5, 3), (5, 5), (3, 3)}


def test_a_clean_corpus_loses_no_good_document_to_the_mixture(spark):
    words = {"good": "river garden teacher winter bridge", "poor": "zzz qqq xxx vvv kkk", "toxic": "hate venom spite scorn malice"}
    domains = ["good"] * 294 + ["poor"] * 3 + ["toxic"] * 3
    docs = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).choice(words[d].split(), 40))) for i, d in enumerate(domains)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(d != "poor"), int(d == "toxic")) for i, d in enumerate(domains)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("toxic = 0"), labels.where("quality = 1 and toxic = 0"), labels.limit(0)):
        rate = {r.doc_id: r.rate for r in mixing.rates(docs, known).collect()}
        assert min(rate[i] for i in range(294)) >= 0.9
    assert {r.doc_id for r in mixing.sample_mixture(docs, labels).collect()} >= set(range(294))
    share = {r.domain: r.share for r in mixing.sample_shares(docs, labels).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and share["good"] > 0.95
    have = np.array([80.0, 5.0, 15.0])
    assert np.allclose(mixing.targets(list(mixing.DOMAINS), have, mixing.WEIGHTS, frozenset(mixing.DOMAINS)), [80, 80 * 3 / 92, 80 * 5 / 92])


def test_added_tokens_have_the_ids_of_the_tokenizers_file(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext| >", "é<|endoftext|>日本  "]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=1 << 12).toPandas().sort_values(["doc_id", "start"])
    for doc, part in rows.groupby("doc_id"):
        ids = [*tok.encode(texts[doc], add_special_tokens=False).ids, 1]
        assert part.doc_tokens.iloc[0] == len(ids)
        assert [zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in part.itertuples()] == part.ids_crc32.tolist()
    assert packing.encode(packing.encoding(packing.default_tokenizer()), texts[0]) == [64, 220, 50256, 275]


def test_dense_parts_are_cut_between_consecutive_messages(spark):
    rows = [(conv, i // 6 if conv != 2 else None, f"r{i % 3}", f"t{i:03d}") for conv in (1, 2, None) for i in range(300)] + [(3, 0, "r0", "few")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    got = chat_format.rotate(table, dense=40).where("speaker = 'r0'").collect()
    for conv in (1, 2, None, 3):
        parts = sorted((p for p in got if p.conv_id == conv), key=lambda p: (p.part, p.sub))
        want = [t for _, _, t in sorted((-1 if r[1] is None else r[1], r[2], r[3]) for r in rows if r[0] == conv)]
        lines = "".join(p.rendered for p in parts).split("\n")
        assert [x.removesuffix("<|im_end|>") for x in lines if not x.startswith("<|im_start|>") and x] == want
        assert [p.sub for p in parts] == list(range(len(parts))) and all(p.n_messages == 40 for p in parts[:-1])


def test_a_text_of_more_pieces_than_the_cache_holds_ends():
    text = " ".join(f"w{i}" for i in range((1 << 20) + 5))
    known = {"kept": 1}
    rows = quality_classifier._rows_of(text, known)
    assert len(rows) == (1 << 20) + 5 and rows[-1] == zlib.crc32(f"w{(1 << 20) + 4}".encode()) & (quality_classifier.VOCAB - 1)
    assert quality_classifier._rows_of("a b a", known).tolist() == [zlib.crc32(w.encode()) & (quality_classifier.VOCAB - 1) for w in "aba"]
