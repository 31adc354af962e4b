"""Operators against plain versions that do the same work the long way."""

import collections
import gzip
import html.parser
import math
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corvida.llm")
from corvida.llm import chat_format, language_id, mixing, quality_classifier, quality_rules, secrets, simhash, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rule_counts_of_every_document(spark, real):
    odd = ["", None, "\u00a0x\u2028y z\x0bw", "a b c d e f g h " * 3, "x\n\nx\n \nx", "é ü\n" * 40, "# | <>\r\n# | <>\r\n"]
    docs = real[0].select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in quality_rules.isolate(docs, real[1]).collect()}
    texts = dict(docs.collect())
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        want, r = plain_counts(text), rows[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed and r.anomaly < r.threshold)


def test_path_lengths_of_recursive_trees():
    x = np.random.default_rng(3).normal(size=(600, 4)).round(1)
    forest = quality_rules.grow(x, trees=20, size=64)

    def path(tree, node, row):
        feature, at, left, depth = tree
        return depth[node] if feature[node] < 0 else path(tree, left[node] + (row[feature[node]] >= at[node]), row)

    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    assert np.allclose(forest.score(x), [2 ** (-np.mean([path(t, 0, r) for t in forest.trees]) / c(64)) for r in x])
    for tree in forest.trees:  # what the leaves hold of the sample comes back to its size
        assert (tree[0] >= 0).sum() * 2 + 1 == len(tree[0])


def test_letters_are_those_of_unicode(spark):
    for c in map(chr, [*range(0x250), 0x661, 0x663, 0x2160, 0x2167, 0x2460, 0x3007, 0x4E00, 0xAA, 0x1F600, 0x1D400]):
        assert language_id.has_letter(f"12 {c} _") == unicodedata.category(c).startswith("L")
    docs = spark.createDataFrame([(1, "½ ²"), (2, "①"), (3, "٣"), (4, "ª"), (5, "Ⅷ 12"), (6, "plain words here"), (7, None), (8, "Ω" * 300_000)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [got[i] for i in range(1, 9)] == ["und", "und", "und", "en", "und", "en", "und", "en"]


def test_prediction_is_that_of_all_windows(spark, real):
    model = language_id.train(real[0])
    docs = real[0].limit(60)
    got = {r.doc_id: r for r in docs.select("doc_id", language_id.predict(F.col("text"), model).alias("p")).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        if not language_id.has_letter(text):
            continue
        raw = text.encode()
        probs = []
        for at in range(0, len(raw), language_id.WINDOW):
            x = np.frombuffer(raw[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"), dtype=np.uint8)
            pooled = []
            for w, f in model.filters.items():
                e = model.emb[x]
                pooled.append(np.max([e[i : i + w].ravel() @ f for i in range(len(x) - w + 1)], axis=0))
            z = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
            probs.append(z - np.log(np.exp(z).sum()))
        mean = np.mean(probs, axis=0)
        best = int(mean.argmax())
        assert got[doc].p.lang == model.languages[best] and abs(got[doc].p.score - np.exp(np.array(probs)[:, best]).mean()) < 1e-4


SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu".split()


def structured(rng):
    """A token that isn't random: words with a number, a counter, a repeated piece, a date and a name."""
    word = lambda n: "".join(SYLLABLES[i] for i in rng.integers(0, len(SYLLABLES), n))
    kind = rng.integers(0, 4)
    return [
        lambda: word(10).capitalize() + word(3).capitalize() + str(rng.integers(10, 9999)),
        lambda: "Item" + "0" * 20 + str(rng.integers(10**6, 10**7)) + word(2),
        lambda: (word(2) + str(rng.integers(0, 99)) + "X") * 6,
        lambda: "2024010" + str(rng.integers(1, 9)) + "T" + word(7) + "V" + str(rng.integers(1, 99)),
    ][kind]()


def test_false_discoveries_are_held(spark):
    """Tokens of known truth, in classes of 10 to 5,000 and random shares of 0 to 1: the false share of what is flagged
    stays within q and its sampling error, and large classes with random tokens are not passed over."""
    rng = np.random.default_rng(12)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    cases = [(n, share, turn) for n, turns in ((10, 4), (100, 2), (5_000, 1)) for share in (0.0, 0.1, 0.5, 1.0) for turn in range(turns)]
    rows = []
    for case, (n, share, _) in enumerate(cases):
        for i in range(n):
            random = i < round(n * share)
            token = "".join(rng.choice(letters, int(rng.integers(32, 48)))) if random else structured(rng)[:63].ljust(32, "a")
            rows.append((case, random, token))
    some = spark.createDataFrame(rows, "case int, random boolean, token string").repartition(8)
    tested = some.select("case", "random", secrets.battery(F.col("token")).alias("b"), (F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")).alias("mixed"))
    tested = tested.select("case", "random", "b.*", "mixed").where(secrets._testable(F.struct("encoding", "n", "mixed"))).cache()
    wrong, right = {}, {}
    for case, (n, share, _) in enumerate(cases):
        own = tested.where(F.col("case") == case)
        limit = dict(secrets.thresholds(own.select("encoding", "n", "p")))
        flagged = [r.random for r in own.collect() if r.p >= limit[int(math.log2(r.n))]]
        wrong[n, share] = wrong.get((n, share), 0) + flagged.count(False)
        right[n, share] = right.get((n, share), 0) + flagged.count(True)
    for (n, share), bad in wrong.items():
        total = bad + right[n, share]
        assert bad <= 0.1 * total + 3 * (0.1 * 0.9 * total) ** 0.5 + (share == 0) * 0.01 * n, (n, share, bad, total)
    assert right[5_000, 0.5] > 1250 and right[5_000, 1.0] > 4000 and right[100, 1.0] > 100


def test_p_values_of_random_tokens(spark):
    """What the cuts are taken from: the measured share over a cut is that of other random tokens."""
    rng = np.random.default_rng(3)
    letters = list("0123456789abcdef")
    own = spark.createDataFrame([("".join(rng.choice(letters, 40)),) for _ in range(3000)], "t string").select(secrets.battery(F.col("t")).alias("b"))
    p = np.array([r.b.p for r in own.where("b.encoding = 'hex'").collect()])
    share = secrets.random_shares(spark, [("hex", 40)])["hex", 40]
    assert len(p) > 2900 and all(abs((p >= s / 100).mean() - share[s]) < 0.05 for s in (1, 10, 25, 50, 75))
    assert secrets.thresholds(spark.createDataFrame([], "encoding string, n int, p double")) == []


def test_mixing_rates_are_the_least_squares(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.3, 0.2, 0.2], 300).round(6)
    tokens = rng.integers(0, 500, 300)
    table = spark.createDataFrame([((int(t), [float(v) for v in q]),) for t, q in zip(tokens, p)], "mix struct<tokens: long, p: array<double>>")
    have = (tokens[:, None] * p).sum(axis=0)
    stay = 1e-4

    def long_way(rows, wanted, most, at_most):
        """Plain projected gradient on the rates themselves, short steps until nothing moves."""
        a, total, r = p @ rows.T, tokens.sum(), np.ones(len(p))
        pull = 1 / (1 / stay * np.linalg.norm(a.T @ (a * tokens[:, None]) / total, 2) + 1)
        for _ in range(400_000):
            residual = ((tokens * r) @ a - wanted) / total
            residual = np.maximum(residual, 0) if at_most else residual
            new = np.clip(r - pull * (a @ residual / stay + r - 1), 0, most)
            if np.abs(new - r).max() < 1e-11:
                break
            r = new
        return r

    rate = lambda push, most: np.array([x for (x,) in table.select(mixing._rate(F.col("mix.p"), push, most)).collect()])
    for wanted in (have * [1.0, 0.2, 0.4], have * [0.5, 1.5, 1.0], have * [2.0, 0.0, 0.0]):
        got = rate(mixing.solve(table, "mix", np.eye(3), wanted, float(have.sum()), stay=stay, tolerance=1e-9), None)
        used = tokens > 0
        assert np.abs(got - long_way(np.eye(3), wanted, np.inf, False))[used].max() < 1e-3
    rows = np.array([[-0.1, 1.0, 0.0], [-0.2, 0.0, 1.0]])
    got = rate(mixing.solve(table, "mix", rows, np.zeros(2), float(have.sum()), most=1.0, at_most=True, stay=stay, tolerance=1e-9), 1.0)
    assert np.abs(got - long_way(rows, np.zeros(2), 1.0, True))[tokens > 0].max() < 1e-3
    assert got.min() >= 0 and got.max() == 1
    with pytest.raises(RuntimeError):
        mixing.solve(table, "mix", np.eye(3), have / 2, float(have.sum()), rounds=1)


def test_drawn_mixture_has_the_solved_shares(real):
    shares = {r.domain: r for r in mixing.sample_shares(*real).collect()}
    for d, weight in mixing.WEIGHTS.items():
        assert abs(shares[d].share - weight) < 0.001


def test_posteriors_of_every_document(real):
    model = mixing.train(*real, "doc_id", "text")
    rows = {r.doc_id: r for r in mixing.rates(*real).collect()}
    for doc, text in real[0].select("doc_id", "text").collect():
        x = np.zeros(mixing.PAIRS + mixing.WORDS)
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if words:
            raw = text.encode()
            for a, b in zip(raw, raw[1:]):
                x[((a * 256 + b) * 40503 % (1 << 32) >> 6) & (mixing.PAIRS - 1)] += 1 / len(raw)
            x[: mixing.PAIRS] = np.sqrt(x[: mixing.PAIRS])
            for w in words:
                x[mixing.PAIRS + mixing.zlib.crc32(w.strip(".,;:!?\"'()").lower().encode()) % mixing.WORDS] = 0.3
        z = x @ model.weight + model.bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert rows[doc].n_tokens == len(words) and np.allclose([rows[doc][f"p_{d}"] for d in mixing.DOMAINS], want, atol=1e-3)


def test_word_vectors_and_pools_the_long_way(spark):
    texts = ["the cat sat, the cat ran", "a b", "", None, "dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spots, signs = quality_classifier.index_vectors()
    total, seen = np.zeros((quality_classifier.VOCAB, quality_classifier.DIMS)), set()
    rows_of = lambda t: [quality_classifier._row(w) for w in re.findall(r"\w+|[^\w\s]+", t or "")]
    for rows in map(rows_of, texts):
        seen |= set(rows)
        for i, w in enumerate(rows):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if i != j:
                    total[w, spots[rows[j]]] += signs[rows[j]]
    vectors = quality_classifier.word_vectors(docs)
    for w in seen:
        own = np.zeros(quality_classifier.DIMS)
        own[spots[w]] = signs[w]
        v = np.sign(total[w]) * np.log1p(np.abs(total[w]))
        v = (v if v.any() else own) + 0.25 * own
        assert np.allclose(vectors[w], v / np.linalg.norm(v), atol=1e-5)
    pooled = dict(docs.mapInArrow(quality_classifier._pool(vectors), "doc_id long, pooled binary").collect())
    for doc, text in enumerate(texts):
        x = vectors[rows_of(text)] if rows_of(text) else np.zeros((0, quality_classifier.DIMS))
        want = np.r_[x.mean(axis=0), x.std(axis=0), math.log1p(len(x)) / 10] if len(x) else np.zeros(2 * quality_classifier.DIMS + 1)
        assert np.allclose(np.frombuffer(pooled[doc], dtype="<f4"), want, atol=1e-4)


class Visible(html.parser.HTMLParser):
    BREAKS = set("p div br hr li ul ol dl dt dd tr table h1 h2 h3 h4 h5 h6 article section nav header footer main aside blockquote pre figure form title head body html".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "noscript", "template")
        self.out += ["\n"] * (tag in self.BREAKS)

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "noscript", "template")
        self.out += ["\n"] * (tag in self.BREAKS)

    def handle_data(self, data):
        self.out += [data] * (not self.off)


def test_conversions_of_all_pages_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.source_id: r.block for r in warc.derive(pages).where("record_type = 'conversion'").collect()}
    pages = pages.collect()
    assert len(got) == len(pages)
    for p in pages:
        parser = Visible()
        parser.feed(p.html or "")
        parser.close()
        lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
        assert got[p.page_id] == "\n".join(x for x in lines if x)


def test_every_record_is_a_gzip_member(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i} é</p>" * (1 + i * 40)) for i in range(40)], "page_id long, url string, html string").repartition(3)
    records = warc.derive(pages)
    assert warc.write_records(records, str(tmp_path / "w x")) == 80
    files = sorted((tmp_path / "w x").iterdir())
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    want = sorted((r.header, r.block) for r in records.collect())
    members = 0
    for f in files:
        data = f.read_bytes()
        while data:
            d = warc.zlib.decompressobj(31)
            record = d.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Record-ID") == 1
            data, members = d.unused_data, members + 1
    assert members == 80
    assert sorted(map(tuple, warc.read_records(spark, str(tmp_path / "w x")).collect())) == want
    plain = tmp_path / "plain"
    plain.mkdir()
    for i, f in enumerate(files):
        (plain / f"{i}.warc").write_bytes(gzip.decompress(f.read_bytes()))
    assert sorted(map(tuple, warc.read_records(spark, str(plain)).collect())) == want
    (plain / "0.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, str(plain)).collect()


def test_a_crowded_turn_is_as_its_sql(spark, monkeypatch):
    rows = [(1, 5, f"r{i % 3}", f"t{i:05d}") for i in range(10_000)] + [(2, 0, "ann", "hi"), (2, 1, "bob", "yes"), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    conversations = table.toPandas()  # noqa: F841
    conversations["conv_id"], conversations["turn"] = conversations["conv_id"].astype("Int64"), conversations["turn"].astype("Int64")
    want = duckdb.sql(chat_format.ORACLE).df()
    got = chat_format.rotate(table).toPandas()
    key = ["conv_id", "speaker", "part", "sub"]
    order = lambda d: sorted(map(tuple, d[[*key, "n_messages", "n_trained", "rendered", "mask"]].astype(str).replace({"<NA>": "None", "nan": "None"}).values.tolist()))
    assert [x[1:] for x in order(got)] == [x[1:] for x in order(want)] and len(got) == 3 * 3 + 2 + 1


def test_columns_that_clash(spark):
    names = "spans _spans base tested kept_id _kept_id kept_hash place language _language mix _mix label_id domain id fp slice".split()
    text = "password = abcdefghijklmnop and a few more words to read here"
    rows = [(1, text, "en", *names), (2, "other words without anything in them at all", "en", *names), (2, "other words without anything in them at all", "en", *names)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *(f"`{n}` string" for n in names)]))
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    red = secrets.redact(docs)
    assert red.columns == docs.columns and all(r._spans == "_spans" and r.base == "base" for r in red.collect()) and {r.text for r in red.collect() if r.doc_id == 1} == {"[SECRET] and a few more words to read here"}
    for kept in (simhash.drop_near_copies(docs), language_id.keep_known(docs), mixing.sample_mixture(docs, labels)):
        assert kept.columns == docs.columns and all(r._kept_id == "_kept_id" and r.mix == "mix" for r in kept.collect())
    assert simhash.drop_near_copies(docs).count() == 2 and mixing.rates(docs, labels).count() == 3
    assert quality_rules.isolate(docs, labels).count() == 3 and quality_classifier.score_quality(docs, labels).count() == 3
    assert secrets.scan_secrets(docs).count() == 3
