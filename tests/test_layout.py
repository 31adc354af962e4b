"""Layout and chunking against plain Python, and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvida.operators import chunking as C
from corvida.operators import layout as L
from corvida.operators import store
from corvida.plans import layout_plans as P
from corvida.streaming import streams

SF = "/root/testdata/sf0.001"
TOKENS = lambda t: max(1, int(len(re.split(r"\s+", t)) * 1.3))


def test_rows_by_first_line(spark):
    cells = P.cells(spark, SF).withColumn("y", F.col("y") + F.length("text") % 3).drop("row_no")
    got = {}
    for r in L.cluster_rows(cells, 1.0).collect():
        got.setdefault((r.doc_id, r.page), set()).add((r.y, r.row_no))
    for pairs in got.values():
        row, start = -1, None
        for y, n in sorted(pairs):
            if start is None or y - start > 1.0:
                row, start = row + 1, y
            assert n == row


@pytest.mark.parametrize("xs,fixed,means", [([], [], []), ([5.0], [5.0], [5.0]), ([0.0, 20.0, 40.0, 41.0, 100.0], [0.0, 40.0, 100.0], [10.0, 40.5, 100.0])])
def test_anchors(spark, xs, fixed, means):
    df = spark.createDataFrame([(xs,)], "x array<double>")
    r = df.select(L.anchors(F.col("x"), 20.0).alias("a"), L.mean_anchors(F.col("x"), 20.0).alias("m")).head()
    assert (r.a, r.m) == (fixed, means)


def test_flat_chunks_keep_all_words(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in C.chunk_flat(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, text in texts.items():
        chunks = got.get(i, [])
        assert bool(chunks) == bool((text or "").strip())
        words = (text or "").split()
        # without what they repeat, the chunks are the text's words in order
        at = 0
        for c in chunks:
            w = c.split()
            k = next(k for k in range(len(w) + 1) if words[at : at + len(w) - k] == w[k:] or (k and words[at : at + len(w) - k] == w[k:]))
            at += len(w) - k
        assert at == len(words)


def test_flat_chunks_by_hand():
    assert C.flat_chunks("") == [] and C.flat_chunks(" a ") == ["a"]
    assert C.flat_chunks("aaaa bbbb cccc", 10, 4) == ["aaaa bbbb", "bbb  cccc"]  # a repeated end keeps its blank
    assert C.flat_chunks("One two. Three four. Five.", 12, 0) == ["One two.", "Three four.", "Five."]
    assert C.flat_chunks("aaaa\n\nbbbb\n\ncccc", 12, 3)[0] == "aaaa\n\nbbbb"


def test_large_tables(spark):
    rows = [[f"item {i}", str(i)] for i in range(40)]
    df = spark.createDataFrame([("big", ["a", "b"], rows), ("small", ["a", ""], [["x\ny", "-"]]), ("none", ["a"], [])], "table_id string, headers array<string>, rows array<array<string>>")
    got = {}
    for r in C.split_large_tables(df, 60).orderBy("table_id", "part").collect():
        got.setdefault(r.table_id, []).append(r)
    assert [r.content for r in got["small"]] == ["| a | Col 2 |\n| --- | --- |\n| x y | - |"] and len(got["none"]) == 1
    head, *parts = got["big"]
    assert head.is_group_head and head.content == "| a | b |\n| --- | --- |" and not any(p.is_group_head for p in parts)
    assert [n for p in parts for n in range(p.row_start, p.row_end + 1)] == list(range(1, 41))
    for p in parts:
        lines = p.content.split("\n")[2:]
        assert sum(map(TOKENS, lines)) <= 60 and len(lines) == p.row_end - p.row_start + 1


def test_adjacent_chunks(spark):
    data = [(1, 0, "p", None, "a b"), (1, 1, "p", None, "c d"), (1, 2, "q", None, "e"), (1, 3, "q", "g", "f"), (1, 4, "q", None, "| t |"), (1, 5, "q", None, "h"), (2, 0, None, None, "x " * 9), (2, 1, None, None, "y " * 9)]
    df = spark.createDataFrame(data, "doc_id int, chunk_index int, hierarchy_path string, group_id string, content string")
    got = [(r.doc_id, r.content) for r in C.merge_adjacent(df, 20).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, "a b\n\nc d"), (1, "e"), (1, "f"), (1, "| t |"), (1, "h"), (2, ("x " * 9).strip()), (2, ("y " * 9).strip())]


def test_csv_round_trip(spark, tmp_path):
    data = [("1_0", 3, "g", True, ["a", "b"], 'say "x",\nthen y'), ("1_1", 1, None, False, [], "plain")]
    df = spark.createDataFrame(data, "chunk_id string, token_count int, group_id string, is_group_head boolean, hierarchy_path array<string>, content string")
    store.write_csv(df, str(tmp_path / "c"))
    back = store.read_csv(spark, str(tmp_path / "c")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.group_id, r.content) for r in back] == [(x[0], x[2], x[5]) for x in data]


def test_joined_chunks_keep_where_they_stand(spark):
    data = [(1, 0, "p", None, "a b", 3, 3, ["x"]), (1, 1, "p", None, "c d", 3, 5, ["y", "z"]), (1, 2, "p", "g", "e f", 6, 6, []), (1, 3, "q", None, "g h", None, None, None)]
    df = spark.createDataFrame(data, "doc_id int, chunk_index long, hierarchy_path string, group_id string, content string, page_start int, page_end int, boxes array<string>")
    got = [tuple(r)[1:] for r in C.merge_adjacent(df, 20).orderBy("chunk_index").collect()]
    assert got == [(0, "a b\n\nc d", 3, 5, ["x", "y", "z"]), (2, "e f", 6, 6, []), (3, "g h", None, None, None)]


def test_sections(spark):
    data = [(1, 0, "intro", 0), (1, 1, "A", 1), (1, 2, "a b c", 0), (1, 3, "d e f", 0), (1, 4, "g h i", 0), (1, 5, "B", 2), (1, 6, "C", 1), (1, 7, "D", 2), (1, 8, "w " * 60, 0)]
    lines = L.section_paths(spark.createDataFrame(data, "doc_id int, line_no long, text string, level int"))
    got = [(r.path, r.content) for r in C.chunk_sections(lines, 6).orderBy("first_line", "part").collect()]
    assert got[:4] == [([], "intro"), (["A"], "a b c\n\nd e f"), (["A"], "g h i"), (["A"], "B")]
    assert all(p == ["C", "D"] for p, _ in got[4:]) and sum(c.split().count("w") for _, c in got[4:]) >= 60


def test_headers(spark):
    two = [["Item", "", "FY 24", ""], ["", "", "", "Q1"], ["a", "", "", "1,000"], ["b", "", "", "20"]]
    plain = [["Item", "Cost"], ["a", "1000"], ["b", "2"]]
    left = [["Item", "", "Q2"], ["", "", ""], ["a", "5", ""], ["b", "6", ""]]
    df = spark.createDataFrame([(0, two), (1, plain), (2, left), (3, [["x"]]), (4, None)], "i int, m array<array<string>>")
    got = [(r.h.headers, r.h.rows) for r in df.orderBy("i").select(C.merge_headers(F.col("m")).alias("h")).collect()]
    assert got[0] == (["Item", "FY 24", "Q1"], [["a", "", "1,000"], ["b", "", "20"]]) and got[1] == (["Item", "Cost"], [["a", "1000"], ["b", "2"]])
    assert got[2] == (["Item", "Q2"], [["a", "5"], ["b", "6"]]) and got[3] == (["x"], []) and got[4] == ([], [])


def plain_blocks(blocks, most):
    """Sections' chunks block by block: (path, content, is grouped, is head)."""
    tokens = lambda t: max(1, int(len(re.split(r"\s+", t)) * 1.3))
    out, held = [], []

    def flush(path):
        if held:
            out.append((path, "\n\n".join(held).strip(), False, False))
        held.clear()

    def parts(path, lines, head):
        part, first = [], head is None
        for line in [*lines, None]:
            if part and (line is None or sum(map(tokens, part)) + tokens(line) > most):
                out.append((path, "\n".join([*([head] if head else []), *part]), True, first))
                part, first = [], False
            if line is not None:
                part.append(line)

    sections = {}
    for b in blocks:
        if b["level"] == 0:
            sections.setdefault(b["section"], []).append(b)
    for own in sections.values():
        path = own[0]["path"]
        for b in own:
            if b["kind"] == "table":
                flush(path)
                width = max(len(b["headers"]), len(b["rows"][0]) if b["rows"] else 0)
                row = lambda r: "| " + " | ".join((r[i] if i < len(r) and r[i] else "-") for i in range(width)) + " |"  # noqa: B023, E731
                head = "| " + " | ".join((b["headers"][i] if i < len(b["headers"]) and b["headers"][i] else f"Col {i + 1}") for i in range(width)) + " |\n" + "| " + " | ".join(["---"] * width) + " |"
                lines = [row(r) for r in b["rows"]]
                if tokens("\n".join([head, *lines])) <= most:
                    out.append((path, "\n".join([head, *lines]), False, False))
                else:
                    out.append((path, head, True, True))
                    parts(path, lines, head)
                continue
            text = "\n".join(b["items"]) if b["kind"] == "list" else b["text"]
            if b["kind"] == "list" and tokens(text) > most:
                flush(path)
                parts(path, b["items"], None)
                continue
            if held and sum(map(tokens, held)) + tokens(text) > most:
                flush(path)
            held.append(text)
        flush(path)
    return out


def test_blocks_of_kinds(spark):
    """A section of text, table, text and lists; tables and long lists close the chunk before them."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("river stone cloud meadow".split()) for _ in range(n))
    kinds = ["text", "table", "text", "list", "list", "text", "text", "table", "text"]
    rows = []
    for doc in range(6):
        for no, kind in enumerate(["head", *kinds, "head", "text", "head", *kinds]):
            n = rng.randrange(1, 9)
            items = ["- " + words(rng.randrange(1, 6)) for _ in range(n)] if kind == "list" else None
            table = ([words(1) if i else "" for i in range(rng.randrange(1, 4))], [[words(1) if rng.random() < 0.8 else "" for _ in range(rng.randrange(1, 5))] for _ in range(n - 1)]) if kind == "table" else (None, None)
            rows.append((doc, no, words(2) if kind == "head" else words(n) if kind == "text" else None, int(kind == "head"), "text" if kind == "head" else kind, items, *table))
    df = spark.createDataFrame(rows, "doc_id int, line_no long, text string, level int, kind string, items array<string>, headers array<string>, rows array<array<string>>")
    paths = L.section_paths(df.select("doc_id", "line_no", "text", "level"))
    blocks = paths.join(df.drop("text", "level"), ["doc_id", "line_no"])
    got = C.chunk_blocks(blocks, 14).orderBy("doc_id", "first_line", "part").collect()
    told = [r.asDict() | {"section": (r.doc_id, r.section_line)} for r in blocks.orderBy("doc_id", "line_no").collect()]
    assert [(r.path, r.content, r.group_id is not None, r.is_group_head) for r in got] == plain_blocks(told, 14)
    assert {(r.group_id is not None, r.is_group_head) for r in got} == {(False, False), (True, False), (True, True)}


def test_blocks_without_content(spark):
    rows = [(1, 0, "A", 1, "text", None, None, None), (1, 1, " ", 0, "text", None, None, None), (1, 2, None, 0, "list", [], None, None), (1, 3, None, 0, "table", None, [], []), (1, 4, None, 0, "table", None, None, None), (1, 5, None, 0, "text", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, line_no long, text string, level int, kind string, items array<string>, headers array<string>, rows array<array<string>>")
    blocks = L.section_paths(df.select("doc_id", "line_no", "text", "level")).join(df.drop("text", "level"), ["doc_id", "line_no"])
    assert [(r.path, r.content) for r in C.chunk_blocks(blocks).collect()] == [([], "A")]


TEXT = "a <think>deep < thought</think> b<|channel>thought more<channel|> c <thin"


@pytest.mark.parametrize("step", [1, 2, 5, 100])
def test_fragments(step):
    held, mark, parts = "", -1, []
    for i in range(0, len(TEXT), step):
        found, held, mark = streams.split_fragment(held, mark, TEXT[i : i + step], i + step >= len(TEXT))
        parts += found
    assert "".join(t for r, t in parts if not r) == "a  b c <thin" and "".join(t for r, t in parts if r) == "deep < thought more"
    assert held == ""


def test_thinking_stream(spark, tmp_path):
    schema = "message_id string, seq int, text string, is_last boolean"
    for batch, rows in enumerate([[("m", 0, "x <th", False), ("n", 0, "y", True)], [("m", 1, "ink>z", False)], [("m", 2, None, False), ("m", 3, "</think> w", True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = streams.thinking_split(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.message_id, r.part_no, r.is_reasoning, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("m", 0, False, "x "), ("m", 1, True, "z"), ("m", 2, False, " w"), ("n", 0, False, "y")]
