"""Recognised pages: regions, list text, long paragraphs, keyed tables and whole documents by hand."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from corvida.operators import evaluate
from corvida.operators import ocr as R

SCHEMA = "doc_id int, line_no int, page int, page_width double, page_height double, x double, y double, end_x double, end_y double, text string"


def page(*lines):
    """(x, y, text) on one page of 600 by 1000; lines 12 high."""
    return [(1, i, p, 600.0, 1000.0, float(x), float(y), float(x) + 200, float(y) + 12, t) for i, (p, x, y, t) in enumerate(lines)]


def test_regions(spark):
    lines = page((0, 40, 100, "Prose here"), (0, 40, 120, "• first"), (0, 80, 140, "goes on"), (0, 40, 200, "Finance costs fell"), (0, 40, 260, "After the list"), (1, 40, 10, "O2C item"), (2, 40, 10, "next page"), (2, 40, 30, None))
    df = spark.createDataFrame(lines, SCHEMA).withColumn("height", F.lit(12.0))
    got = [(r.is_list, r.region_no) for r in R.text_regions(df).orderBy("line_no").collect()]
    # figures stay with the list though the gap is wide; a page ends it
    assert got == [(False, 0), (True, 1), (True, 1), (True, 1), (False, 2), (True, 3), (False, 4), (False, 4)]
    assert R.text_regions(df.limit(0)).count() == 0


def line(x, y, text, page=0, n=0):
    return Row(page=page, y=float(y), x=float(x), line_no=n, height=12.0, page_width=600.0, text=text)


def test_list_text():
    assert R.list_text([]) == "" and R.list_text([line(40, 0, "  ")]) == ""
    got = R.list_text([line(40, 100, "· one"), line(60, 115, "more"), line(50, 130, "oSub part"), line(40, 145, "EBITDA up"), line(40, 160, "stood at 5"), line(40, 175, "plain")])
    assert got == "- one more\n  - Sub part\n- EBITDA up\n- stood at 5\nplain"
    marked = R.list_text([line(40, 0, "plain"), line(40, 40, "after a gap"), line(45, 55, "joined"), line(300, 100, "right")])
    assert marked == f"plain\n- {R.GAP_MARK}after a gap joined\n  - {R.GAP_MARK}right"
    # no gap is measured over a page's end, and the order is that of reading
    assert R.list_text([line(40, 10, "second", 1), line(40, 900, "first", 0)]) == "first\nsecond"


def test_line_ranges():
    assert R.line_ranges([], 5) == [] and R.line_ranges([9], 5) == [(0, 1)]
    assert R.line_ranges([1] * 10, 8) == [(0, 8), (2, 10)]
    assert R.line_ranges([3] * 4, 6) == [(0, 2), (2, 4)]  # fewer lines than overlap: none is repeated
    assert R.line_ranges([9, 1, 1], 5, 0) == [(0, 1), (1, 3)]


def table(rows=4):
    cells = [(0, 40, 300, "Rs. in crore"), (0, 40, 320, "Sr. No"), (0, 100, 320, "Particulars"), (0, 300, 320, "FY26"), (0, 400, 320, "FY25")]
    for i in range(1, rows + 1):
        cells += [(0, 40, 320 + 20 * i, str(i)), (0, 100, 320 + 20 * i, f"item {i}"), (0, 300, 320 + 20 * i, f"{i},000"), (0, 400, 320 + 20 * i, "5")]
    return [*cells, (0, 100, 335 + 20 * rows, "of more words")]


def test_document(spark):
    lines = [(0, 40, 5, "Page 1 of 2"), (0, 40, 60, "1.2 Results of the year"), (0, 40, 80, "Some words stand here."), *table(), (0, 30, 600, "• an item"), (0, 30, 615, "• another item"), (1, 40, 100, "2 Outlook for all"), (1, 40, 130, "Words on page two.")]
    df = spark.createDataFrame(page(*lines), SCHEMA)
    got = R.ocr_document_chunks(df).orderBy("chunk_index").collect()
    assert [r.chunk_type for r in got] == ["SECTION", "TABLE", "TEXT", "SECTION"]
    assert got[0].content == "1.2 Results of the year\n\nSome words stand here." and got[3].content == "2 Outlook for all\n\nWords on page two."
    assert got[1].content.split("\n") == ["Rs. in crore", "| Sr. No | Particulars | FY26 | FY25 |", "| --- | --- | --- | --- |", "| 1 | item 1 | 1,000 | 5 |", "| 2 | item 2 | 2,000 | 5 |", "| 3 | item 3 | 3,000 | 5 |", "| 4 | item 4 of more words | 4,000 | 5 |"]
    assert got[2].content == "- an item\n- another item" and {r.parent_chunk_id for r in got[1:3]} == {got[0].chunk_id} and {r.pages for r in got} == {2}
    assert got[3].parent_chunk_id is None and got[3].path == ["2 Outlook for all"]
    assert R.ocr_document_chunks(df.limit(0)).count() == 0
    # boxes: of the heading and of the text that joined it; of all cells of the table; of both items; all of page two
    own = {r.text: r for r in df.collect()}

    def box(*texts):
        rows = [own[t] for t in texts]
        x, y = min(r.x for r in rows), min(r.y for r in rows)
        return f'{{"page":{rows[0].page},"x":{x:.1f},"y":{y:.1f},"width":{max(r.end_x for r in rows) - x:.1f},"height":{max(r.end_y for r in rows) - y:.1f}}}'

    cells = [t for _, _, _, t in table()]
    want = [[("1.2 Results of the year",), ("Some words stand here.",)], [cells], [("• an item", "• another item")], [("2 Outlook for all",), ("Words on page two.",)]]
    for r, boxes in zip(got, want, strict=True):
        if boxes != [cells]:  # cells of one text would share a key
            assert r.bbox == "[" + ",".join(box(*b) for b in boxes) + "]"
    inside = [r for r in df.where("page = 0 and y >= 300 and y < 500").collect()]
    assert got[1].bbox == f'[{{"page":0,"x":{min(r.x for r in inside):.1f},"y":{min(r.y for r in inside):.1f},"width":{max(r.end_x for r in inside) - min(r.x for r in inside):.1f},"height":{max(r.end_y for r in inside) - min(r.y for r in inside):.1f}}}]'
    assert [(r.page_start, r.page_end) for r in got] == [(0, 0), (0, 0), (0, 0), (1, 1)]


def test_long_table(spark):
    got = R.ocr_document_chunks(spark.createDataFrame(page(*table(18)), SCHEMA), most=60).where("chunk_type = 'TABLE_PART'").orderBy("chunk_index").collect()
    assert len(got) > 1 and len({r.group_id for r in got}) == 1 and [r.is_group_head for r in got] == [True] + [False] * (len(got) - 1)
    assert [n for r in got for n in range(r.row_start, r.row_end + 1)] == list(range(1, 19))
    assert all(r.content.split("\n")[1] == "| Sr. No | Particulars | FY26 | FY25 |" for r in got)


def test_percentile(spark):
    for values, share, want in [([], 0.95, 0), ([7], 0.95, 7), ([None, 3, 1, 2], 0.5, 2), ([-5, 10**15, 4, 4, 4], 0.95, 4), ([-5, 10**15], 1.0, 10**15), (list(range(5000)), 0.95, 4749)]:
        df = spark.createDataFrame([(v,) for v in values], "ms long")
        assert evaluate.index_percentile(df, "ms", share, 16).head().p95 == want


def test_a_line_is_trimmed_once(spark):
    """Rules about a line don't each trim it anew."""
    from pyspark.sql import functions as F

    from corvida.functions import text as T
    from corvida.operators import layout

    df = spark.createDataFrame([("  Page 3 of 9 ", 12.0), ("1.2  Overview", 12.0), (None, 12.0), ("", 12.0), ("REVENUE UP", 20.0)], "t string, h double")
    furniture = df.select("t", T.is_furniture(F.col("t")).alias("f"))
    level = df.select("t", layout.heading_level_text(F.col("t"), F.col("h"), F.lit(100.0), F.lit(600.0), F.lit(12.0)).alias("l"))
    for got, most in ((furniture, 2), (level, 3)):
        assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= most
    assert {r.t: r.l for r in level.collect()} == {"  Page 3 of 9 ": None, "1.2  Overview": 2, None: None, "": None, "REVENUE UP": None}
    assert [r.f for r in furniture.collect()] == [True, False, False, False, False]
