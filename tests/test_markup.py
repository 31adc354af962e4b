"""Blocks of tagged pages against a parser of the standard library, and the goldens of prompts, scores and marks."""

import html.parser

import pytest
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import chat, context, evaluate, ingest, retrieve, store

SF = "/root/testdata/sf0.01"


class Blocks(html.parser.HTMLParser):
    """(kind, text) of headings, paragraphs, list items and tables, in order; nested items each for themselves."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.open, self.rows = [], None, None

    def close_block(self):
        if self.open:
            kind, parts = self.open
            text = " ".join("".join(parts).split())
            if text:
                self.out.append((kind, "- " + text if kind == "li" else text))
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.close_block()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.rows[-1].append("")
        elif tag in ("h1", "h2", "h3", "h4", "p", "li"):
            self.close_block()
            self.open = (tag, [])
        elif tag in ("ul", "ol", "div"):
            self.close_block()

    def handle_endtag(self, tag):
        if tag == "table":
            head, *rest = [[" ".join(c.split()) for c in r] for r in self.rows]
            self.out.append(("table", "\n".join("| " + " | ".join(c or "-" for c in r) + " |" for r in [head, ["---"] * len(head), *rest])))
            self.rows = None
        elif self.open and tag in (self.open[0], "ul", "ol"):
            self.close_block()

    def handle_data(self, data):
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
        elif self.open:
            self.open[1].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def by_parser(page):
    p = Blocks()
    p.feed(page)
    p.close_block()
    blocks, stack = [], {}
    for kind, text in p.out:
        level = int(kind[1]) if kind[0] == "h" else 0
        above = [stack[n] for n in sorted(stack) if not level or n < level]
        if kind == "li" and blocks and blocks[-1][0] == "list" and blocks[-1][4]:
            blocks[-1] = ("list", 0, blocks[-1][2], blocks[-1][3] + "\n" + text, True)
            continue
        blocks.append(("list" if kind == "li" else kind, level, above, text, kind == "li"))
        if level:
            stack = {n: t for n, t in stack.items() if n < level} | {level: text}
    return [b[:4] for b in blocks]


def test_blocks_of_pages(spark):
    own = [
        "<h1>A</h1><p>one<ul><li>x<ul><li>y</li></ul></li><li>z <b>bold</b></li></ul><h2>B</h2><h4>D</h4><table><tr><th>n</th><th>v</th></tr><tr><td>a <i>b</i></td><td></td></tr></table><h3>C</h3><p>last</p><h1>E</h1><p>end",
        "<h2>only</h2><li>a</li><p></p><p>b</p>", "", "no tags",
    ]
    pages = spark.createDataFrame(list(enumerate(own)), "page_id long, html string").unionByName(spark.read.parquet(f"{SF}/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "html"))
    got: dict[int, list] = {}
    for r in ingest.markup_blocks(pages).orderBy("page_id", "block_no").collect():
        assert r.block_no == len(got.setdefault(r.page_id, []))
        got[r.page_id].append((r.kind, r.level, list(r.path), r.text))
    for page, text in pages.collect():
        assert got.get(page, []) == by_parser(text), page


def test_furniture_of_a_margin_is_strict(spark):
    rows = [(1, p, y, 100.0, t) for p in range(3) for y, t in ((11.9, f"Head {p}"), (12.0, "on the top limit"), (86.0, "on the bottom limit"), (86.1, "foot"), (50.0, "Telephone 12"), (51.0, "Page 3 of 9"), (52.0, "12th May, 2024"), (53.0, "|"), (54.0, "cinema"), (55.0, "cin 5"))]
    got = ingest.drop_page_furniture(spark.createDataFrame(rows, "doc_id int, page int, y double, page_height double, text string"))
    assert sorted({r.text for r in got.collect()}) == ["cinema", "on the bottom limit", "on the top limit"] and got.count() == 9


def test_strict_headings(spark):
    df = spark.createDataFrame([("Results 2024",), ("1,234 (567) rest of it",), ("Q1 Q2 Q3",), ("12",), ("Plain heading",)], "text string")
    got = [r[0] for r in df.select(ingest.strict_heading_level(F.lit(20), F.lit(False), F.col("text"), F.lit(12))).collect()]
    assert got == [1, 0, 0, 1, 1]


def test_duplicate_evidence_counts_once(spark):
    ranked = spark.createDataFrame([("q1", n, f"c{n}", "same", 1, None) for n in (1, 2, 3)], "query_id string, rank int, chunk_id string, content_hash string, doc_id int, group_id string")
    expected = spark.createDataFrame([("q1", "hash", "same"), ("q3", "id", "c9")], "query_id string, kind string, value string")
    samples = spark.createDataFrame([("q1", 0), ("q2", 0), ("q3", 2)], "query_id string, sub_queries int")
    got = {r.query_id: r for r in evaluate.retrieval_scores(ranked, expected, samples, ranked).collect()}
    assert got["q1"].recall_5 == 1.0 and got["q1"].precision_5 == pytest.approx(1 / 3) and got["q1"].mrr == 1 and got["q1"].ndcg_5 == 1 and got["q1"].hit == 1 and not got["q1"].group_expansion_hit
    assert (got["q2"].recall_3, got["q2"].precision_5, got["q2"].mrr, got["q2"].hit, got["q2"].per_doc_recall, got["q2"].sub_query_coverage) == (1, 1, 1, 0, 1, 1)
    assert (got["q3"].recall_3, got["q3"].precision_5, got["q3"].mrr, got["q3"].ndcg_5, got["q3"].sub_query_coverage) == (0, 0, 0, 0, 0)


def test_stages_of_a_trace(spark):
    """Sub-queries are covered by what was retrieved; a question without final chunks is scored by its deduped ids alone."""
    rows = [("a", 1, "c1", "h1", 1, "g"), ("a", 2, "c2", "h1", 2, "g"), ("a", 3, "c3", "h3", 3, "g"), ("b", 1, "c1", "h1", 1, "g"), ("b", 2, "c4", "h4", 4, "g")]
    hits = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, content_hash string, doc_id int, group_id string")
    retrieved, deduped, final = evaluate.stages(hits, 1)
    final = final.where("query_id = 'a'")
    ids = {r.query_id: (r.retrieved_ids, r.deduped_ids, r.final_ids) for r in evaluate.trace_ids(retrieved, deduped, final).collect()}
    assert ids == {"a": (["c1", "c2", "c3"], ["c1", "c3"], ["c1"]), "b": (["c1", "c4"], ["c1", "c4"], [])}
    expected = spark.createDataFrame([("a", "id", "c2"), ("a", "doc", "1"), ("b", "id", "c4"), ("b", "doc", "4"), ("b", "hash", "h4")], "query_id string, kind string, value string")
    samples = spark.createDataFrame([("a", 2), ("b", 1)], "query_id string, sub_queries int")
    got = {r.query_id: r for r in evaluate.retrieval_scores(evaluate.evidence(deduped, final), expected, samples, retrieved).collect()}
    assert (got["a"].recall_5, got["a"].hit, got["a"].per_doc_recall, got["a"].sub_query_coverage) == (0, 0, 1, 1)
    assert (got["b"].recall_5, got["b"].mrr, got["b"].per_doc_recall, got["b"].sub_query_coverage, got["b"].group_expansion_hit) == (1, 0.5, 0, 1, False)


def test_an_empty_run_has_zeros(spark):
    empty = spark.createDataFrame([], "query_id int, question string, recall_5 double, per_doc_recall double, mrr double, faithfulness double, correctness double, latency_ms long")
    summary = evaluate.summarize(empty)
    assert tuple(summary.first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert evaluate.report(summary, empty).count() == 8
    base = spark.createDataFrame([("recall", 0.5), ("p95_latency", 100.0)], "metric string, value double")
    assert {r.metric for r in evaluate.gate(evaluate.metrics(summary), base).collect()} == {"recall"}


def test_marks_around_reasoning(spark):
    texts = ["Before <think>hidden</think> after", "a<think>x</think> <think>y</think> b", "a <think>x</think><think>y</think> b", "<think>all", "plain ", "a<|channel>thought t<channel|>b", "x <think>1</think>\n\n<|channel>thought2<channel|> y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.visible_text(F.col("t")).alias("v"), chat.reasoning_text(F.col("t")).alias("r"))
    rows = df.collect()
    assert [r.v for r in rows] == ["Before after", "a b", "a b", "", "plain", "ab", "x y"]
    assert [r.r for r in rows] == [["hidden"], ["x", "y"], ["x", "y"], ["all"], [], [" t"], ["1", "2"]]


def test_sessions(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(13)], "session_id int, turn int, role string, content string")
    assert chat.history_window(m).first().history.split("\n") == [f"{'user' if i % 2 == 0 else 'assistant'}: m{i}" for i in range(3, 12)]
    first = spark.createDataFrame([(n, 0, "user", "x" * n) for n in (44, 45, 46)], "session_id int, turn int, role string, content string")
    sessions = spark.createDataFrame([(44, "New Chat", 0), (45, "New Chat", 0), (46, "New Chat", 0), (1, "Mine", 0), (2, "New Chat", 0)], "id int, title string, message_count int")
    assert dict(chat.session_titles(first, sessions).collect()) == {44: "x" * 44, 45: "x" * 45 + "…", 46: "x" * 45 + "…", 1: "Mine", 2: "New Chat"}
    roles = spark.createDataFrame([(1, 0, "user", ""), (1, 1, "assistant", ""), (1, 2, "assistant", "")], "session_id int, turn int, role string, content string")
    asked = lambda turn: chat.regenerate_cuts(roles, spark.createDataFrame([(1, turn)], "session_id int, turn int")).collect()
    assert [tuple(r) for r in asked(1)] == [(1, 0)] and asked(2) == [] and asked(0) == []
    days = spark.createDataFrame([(1, False, "2024-03-03"), (2, False, "2024-03-04"), (3, False, "2024-03-02"), (4, True, "2024-03-03")], "id int, is_pinned boolean, d string").withColumn("updated_at", F.col("d").cast("timestamp"))
    assert dict(chat.session_recency(days, F.lit("2024-03-03 09:00:00").cast("timestamp")).collect()) == {1: "Today", 2: "Earlier", 3: "Yesterday"}


def test_the_prompt_stays_within_its_window(spark):
    rows = "\n".join(f"| {'O2C' if i == 127 else f'Other {i}'} | {i * 100} | {i * 10} | {i}% | repeated financial detail |" for i in range(1, 251))
    table = "| Segment | Revenue | EBITDA | Margin | Notes |\n|---|---|---|---|---|\n" + rows
    history = "\n".join(f"{'assistant: older answer' if i % 2 == 0 else 'user: older question'} {i} " * 40 for i in range(1, 13))
    questions = spark.createDataFrame([(1, "What is the O2C EBITDA margin?", history, None), (2, "Anything?", "line one\n\nline two", "note")], "query_id int, query string, history string, note string")
    prose = "Some first words. " * 3
    hits = spark.createDataFrame([(1, 0, "a", "f.txt", 0.9, prose), (1, 1, "t", "f.txt", 0.8, table), (1, 2, "z", "f.txt", 0.7, prose)], "query_id int, rank int, chunk_id string, file_name string, score double, content string")
    told = "Use the context."
    got = context.budgeted_chunks(questions, hits, told, 1600, 500)
    kept = {r.chunk_id: r for r in got.collect()}
    limit = context.input_limit(1600, 500)
    assert limit == 972 and context.input_limit(4000, 10_000) == 1872 and context.input_limit(600, 100) == 512
    assert set(kept) == {"a", "t"} and kept["a"].budget is None and kept["t"].budget > 80 and "| O2C | 12700 | 1270 | 127% |" in kept["t"].content
    history_of = {r.query_id: r for r in context.budgeted_history(questions, got, told, 1600, 500).collect()}
    parts = "\n\n---\n\n".join(f"[Source: f.txt, relevance: {kept[c].score:.2f}]\n{kept[c].content}" for c in "at")
    words = lambda *texts: int(sum(len(t.split()) for t in texts) * T.TOKENS_PER_WORD)
    assert history_of[1].tokens == words(told, parts, "What is the O2C EBITDA margin?", history_of[1].history) <= limit
    lines = [x.rstrip() for x in history.split("\n")]
    n = len(history_of[1].history.split("\n")) if history_of[1].history else 0
    assert history_of[1].history == "\n".join(lines[len(lines) - n :]) and words(told, parts, "What is the O2C EBITDA margin?", *lines[len(lines) - n - 1 :]) > limit
    assert history_of[2].history == "line one\nline two"


def test_fusion_keeps_the_sides_names(spark):
    q = spark.createDataFrame([(1, "which passage"), (2, "x"), (3, "y")], "query_id int, query string")
    v = spark.createDataFrame([(1, "a", 0.9, 1, "vector"), (1, "b", 0.8, 2, "vector"), (2, "a", 0.35, 1, "vector_fallback")], "query_id int, chunk_id string, vector_score double, rank int, retrieval_source string")
    x = spark.createDataFrame([(1, "b", 5.0, 1, 1 / 61), (1, "c", 4.0, 2, 1 / 62), (3, "c", 4.0, 1, 1 / 61)], "query_id int, chunk_id string, lexical_score double, lexical_rank int, score double")
    got = [(r.query_id, r.chunk_id, r.retrieval_source) for r in retrieve.hybrid(q, v, x).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b", "hybrid"), (1, "a", "vector"), (1, "c", "lexical"), (2, "a", "vector_fallback"), (3, "c", "lexical")]


def test_block_search_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(300, 8)).round(1)
    x[50:60] = x[0]
    vectors = spark.createDataFrame([(i, 300 - i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, 0, None), (901, 0, [1.0]), (902, 0, [None] * 8)], "chunk_id int, doc_id int, embedding array<double>").repartition(5)
    questions = vectors.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    for at_once in (4096, 23):
        got: dict[int, list] = {}
        for r in retrieve.vector_topk(questions, vectors, 6, at_once, ("doc_id",)).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {i: sorted(range(300), key=lambda j: (-sims[i, j], 300 - j))[:6] for i in range(0, 300, 7)} | {r: v for r, v in got.items() if r >= 300}
        assert got.get(901) in (None, [901]) and 900 not in got and 902 not in got


def test_block_search_holds_a_tile_at_once(monkeypatch):
    """What a task holds doesn't grow with its blocks, and copies, ties and NaN are ranked as by a full sort."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8)).round(1)
    x[100:700] = x[3]
    names = ["doc_id", "chunk_id"]
    block = lambda rows, cols: pa.array([[dict(zip(cols, (i, i, r.tolist())[-len(cols) :], strict=True)) for i, r in enumerate(rows)]])
    batch = pa.RecordBatch.from_arrays([block(x, ["query_id", "e"]), block(x, [*names, "e"])], names=["asked", "held"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit @ unit.T, 9), axis=1, kind="stable")[:, :6].ravel().tolist()
    tracemalloc.start()
    got = list(retrieve.nearest(6, None, names)([batch]))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for b in got for i in b.column(2).to_pylist()] == want
    assert [i for b in got for i in b.column(0).to_pylist()] == np.repeat(np.arange(2000), 6).tolist()
    full = 8 * len(x) ** 2
    monkeypatch.setattr(retrieve, "TILE", 1 << 14)
    tracemalloc.start()
    assert [i for b in retrieve.nearest(6, None, names)([batch]) for i in b.column(2).to_pylist()] == want
    assert tracemalloc.get_traced_memory()[1] < min(held, full / 4)
    tracemalloc.stop()
    sims = np.array([[np.nan, 0.5, 0.5 + 1e-12, 0.7], [np.nan, np.nan, np.nan, 0.1]])
    assert [a.tolist() for a in retrieve.best_of(sims, 2)[:2]] == [[0, 0, 1, 1], [3, 1, 3, 0]]


def test_floats_reach_python_as_floats(spark, monkeypatch):
    """Blocks of floats take half the room of blocks of doubles, and are scored as the doubles that they stand for."""
    floats = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * 64 + i).cast("float")).alias("embedding"))
    search = lambda kind: retrieve.vector_topk(*[floats.select(F.col("id").alias(c), F.col("embedding").cast(kind)) for c in ("query_id", "chunk_id")], 3)
    found = [sorted(map(tuple, search(kind).collect())) for kind in ("array<float>", "array<double>")]
    assert len(found[0]) == 1200 and found[0] == found[1]

    def sizes(k, least, names):
        def run(batches):
            import pyarrow as pa

            for i, batch in enumerate(batches):
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([i]), pa.array([float(batch.nbytes)])], names=["query_id", *names, "vector_score"])

        return run

    monkeypatch.setattr(retrieve, "nearest", sizes)
    small, large = (search(kind).agg(F.sum("vector_score")).first()[0] for kind in ("array<float>", "array<double>"))
    assert 2 * 400 * 64 * 4 <= small < 0.6 * large


def test_a_documents_vector_is_searched_once(spark, monkeypatch):
    """Chunks that share a vector are found as if each had its own, but Python gets the vector once."""
    from corvida.plans.retrieve_plans import vector_side

    # groups of equal vectors, a document of 40 chunks, one without, one with a null vector, a vector that comes twice
    vector = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("doc_id") % 11 * 8 + i).cast("float"))
    vectors = spark.range(40).select(F.col("id").alias("doc_id")).withColumn("embedding", F.when(F.col("doc_id") != 8, vector))
    vectors = vectors.unionByName(spark.range(1).select(F.lit(5).cast("long").alias("doc_id")).withColumn("embedding", F.expr("transform(sequence(1, 8), i -> cast(i as float))")))
    number = F.when(F.col("doc_id") == 9, 40).when(F.col("doc_id") == 7, 0).otherwise(F.col("doc_id") % 3 + 1)
    members = vectors.select("doc_id").distinct().select("doc_id", F.explode(F.slice(F.expr("sequence(0L, 39L)"), F.lit(1), number)).alias("chunk_index"))
    members = members.select(F.concat_ws("_", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index")
    questions = vectors.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "vector_score").collect())
    want = rows(retrieve.vector_topk(questions, members.join(vectors, "doc_id"), 20, ties=("doc_id", "chunk_index")))
    assert len(want) == 9 * 20 and any(c.startswith("9_") for _, _, c, _ in want)
    for at_once in (4096, 7):
        assert rows(retrieve.shared_vector_topk(questions, vectors, members, 20, at_once=at_once)) == want

    def held(k, least, names):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for asked, block in zip(batch.column(0), batch.column(1), strict=True):
                    q, v = asked.values.field("query_id"), block.values
                    yield pa.RecordBatch.from_arrays([q.take(pa.array([0] * len(v))), *[v.field(n) for n in names], pa.array([float(len(v))] * len(v))], names=["query_id", *names, "vector_score"])

        return run

    d = "/root/testdata/sf0.001"
    texts, e = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "embeddings"))
    want = texts.where("text is not null").join(e, F.col("doc_id") == F.col("vec_id")).count()
    monkeypatch.setattr(retrieve, "nearest", held)
    assert vector_side(spark, d)[1].agg(F.max("vector_score")).first()[0] == want


def test_a_baseline_needs_no_python(spark):
    """The fixed values that a run is held against are literals; rows of createDataFrame came from Python on every executor."""
    from corvida.plans.shape_plans import BASELINE, QUERIES

    plan = QUERIES["baseline_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ExternalRDD" not in plan and "LogicalRDD" not in plan
    assert all(f"{v}" in plan for v in BASELINE.values())


def test_long_texts_are_hashed_alone(spark, monkeypatch):
    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.strip().lower().encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return format(h - (1 << 64) if h >= 1 << 63 else h, "x")

    texts = ["", " Ab ", "é" * 700, "x" * 5000, "short", "word " * 300]
    for grid in (1 << 24, 1000):
        monkeypatch.setattr(store, "GRID", grid)
        rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1).select("t", store.content_hash(F.col("t")).alias("h")).collect()
        assert {r.t: r.h for r in rows} == {t: plain(t) for t in texts} | {None: None}
