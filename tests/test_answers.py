"""Small cases of routes, labels, table answers and evidence shaping, by hand."""

import pytest
from pyspark.sql import functions as F

from corvida.functions import questions as U
from corvida.functions import text as T
from corvida.operators import answers, context, judging, merge

ROUTES = [
    ("what is the optimal plan", True, "", "agentic", "DIRECT"),
    ("hello", True, "", None, "DIRECT"),
    ("2 + 2 * (3)", True, "", None, "DIRECT"),
    ("you mentioned a cost", True, "assistant: [Source: a.pdf]", "single", "DIRECT"),
    ("you mentioned a cost", True, "assistant: none", "single", "SINGLE_SHOT"),
    ("the amount under column 3", True, "", None, "AGENTIC"),
    ("what is the limit", True, "", "agentic", "SINGLE_SHOT"),
    ("revenue and ebitda of the unit", True, "", None, "AGENTIC"),
    ("compare both", False, "", None, "SINGLE_SHOT"),
    ("tell a story", True, None, "Direct", "DIRECT"),
    (None, True, None, None, "DIRECT"),
]


def test_routes(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROUTES)], "i int, q string, has boolean, h string, l string, want string")
    got = df.select("i", "want", U.route(F.col("q"), F.col("has"), F.col("h"), F.col("l")).alias("got")).orderBy("i").collect()
    # a null question is an empty one, which no rule but the label decides
    assert [(r.i, r.got) for r in got[:-1]] == [(r.i, r.want) for r in got[:-1]]
    assert got[-1].got == "SINGLE_SHOT"


def test_subqueries(spark):
    df = spark.createDataFrame([(0, 'x ["A", "a", "b"] y', "b"), (1, "none", "q"), (2, '["1","2","3","4","5"]', "q"), (3, None, "q")], "i int, r string, q string")
    got = [r.s for r in df.orderBy("i").select("i", U.subqueries(F.col("r"), F.col("q")).alias("s")).collect()]
    assert got == [["A", "b"], ["q"], ["1", "2", "3", "q"], ["q"]]


def reduced(query, content, budget):
    """The reduction in plain Python."""
    import re

    tokens = lambda t: max(1, int(len(re.split(r"\s+", t)) * 1.3))
    if tokens(content) <= budget:
        return content
    words = lambda t: {w for w in re.split(r"[^a-z0-9_]+", t.lower()) if len(w) > 2}
    lines = [x.rstrip() for x in content.split("\n") if x.strip()]
    rule = lambda x: x.strip().startswith("|") and not re.sub(r"[|\- ]", "", x)
    rules = list(dict.fromkeys(x for x in lines if rule(x)))
    data = [x for x in lines if not rule(x)]
    taken = []
    for score, _, x in sorted((-len(words(query) & words(x)), i, x) for i, x in enumerate(data)):
        if (score < 0 or not taken) and tokens("\n".join([*rules, *taken, x]).strip()) <= budget:
            taken.append(x)
    return "\n".join(rules + taken) or content[:1200]


@pytest.mark.parametrize("budget", [12, 30, 700])
def test_table_lines(spark, budget):
    texts = ["| a | b |\n| --- | --- |\n" + "\n".join(f"| item {i} | {'steel' if i % 4 == 0 else 'wood'} price {i} |" for i in range(30)), "plain text", "", "one two three\n" * 40]
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate((q, t) for q in ("steel price 8", "zzz") for t in texts)], "i int, query string, content string")
    got = {r.i: (r.query, r.content) for r in context.reduce_table_lines(df, budget).collect()}
    want = {r.i: (r.query, reduced(r.query, r.content, budget)) for r in df.collect()}
    assert got == want


def test_sums_and_facts(spark):
    cells = "array<struct<col:int,label:string,value:string>>"
    rows = spark.createDataFrame([("q", 1, "c", "f", 0, 3, [(0, "Name", "steel"), (1, "Cost", "(10)")], ["Name", "Cost"]), ("q", 2, "c", "f", 1, 2, [(0, "Name", "wood"), (1, "Cost", "₹1,200.5")], ["Name", "Cost"])], f"query_id string, place int, chunk_id string, file_name string, row_no int, row_score int, cells {cells}, headers array<string>")
    q = spark.createDataFrame([("q", "the sum of cost"), ("none", "sum")], "query_id string, query string")
    c = spark.createDataFrame([("c", "f", "text")], "chunk_id string, file_name string, content string")
    assert [tuple(r) for r in answers.sums(q, rows, c).collect()] == [("q", "(10) + ₹1,200.5 = 1190.50 (Source: f)")]
    assert [tuple(r) for r in answers.lookup(q, rows).collect()] == [("q", "steel — Cost: (10) (Source: f)", True)]
    hits = spark.createDataFrame([("q", "c", 1, 0.5, "text"), ("other", "c", 1, 0.5, "text")], "query_id string, chunk_id string, rank int, score double, content string")
    told = spark.createDataFrame([("q", "- f", None, "MEDIUM"), ("other", "- f", None, "NONE"), ("none", "- f", "a", "HIGH")], "query_id string, facts string, answer string, confidence string")
    got = answers.inject_facts(hits, told)
    assert sorted(r.chunk_id for r in got.collect()) == ["c", "c", "table-facts:c"]


def test_requery(spark):
    """0: used at once; 1: one new set; 2: two; 3: the second set isn't asked for; 4: the first try is empty; 5: the first
    search was; 6: there is no further rephrasing."""
    found = spark.createDataFrame([(f"{q}.{n}", q * 10 + n, 1, 1.0) for q, n in [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (4, 0), (4, 2), (5, 1), (6, 0)]], "query string, chunk_id int, rank int, score double")
    again = {(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0), (4, 1), (5, 0), (6, 0)}
    tries = spark.createDataFrame([(q, n, f"{q}.{n}", "REQUERY" if (q, n) in again else "USE") for q in range(7) for n in range(1 if q == 6 else 3)], "query_id int, attempt int, query string, action string")
    asked = []

    def search(questions):
        asked.append(sorted(r.query for r in questions.collect()))
        return questions.join(found, "query").drop("query")

    assert sorted((r.query_id, r.chunk_id) for r in merge.requery(search, tries).collect()) == [(0, 0), (1, 11), (2, 22), (3, 31), (4, 40), (5, 51), (6, 60)]
    assert asked == [["0.0", "1.0", "2.0", "3.0", "4.0", "5.0", "6.0"], ["1.1", "2.1", "3.1", "4.1", "5.1"], ["2.2"]]


def test_judged(spark):
    good = '{"faithfulness": 1, "correctness": 0.5, "citationCorrectness": 0, "refusalCorrectness": 1, "rationale": "x"}'
    df = spark.createDataFrame([(0, "a " + good + " b"), (1, None), (2, "{"), (3, good.replace("0.5", "2")), (4, good.replace('"x"', '" "'))], "i int, raw string")
    assert [r.i for r in df.where(judging.judge_score(F.col("raw")).isNotNull()).collect()] == [0]


HOLDINGS = "Holdings of the unit\n| Item | Amount | Profit |\n| --- | --- | --- |\n| Alpha | 10 | - |\n| Beta | 20 | (5) |\n| Gamma | 1,000 | 7 |"
TABLE_CASES = [
    # question, answer or None, confidence or None, a fact that is told
    ("highest amount and combined amount of Alpha and Beta", "Gamma — Amount: 1,000 (Source: h.txt)", "HIGH", "Gamma | Item: Gamma | Amount: 1,000 | Profit: 7"),
    ("lowest amount or profit", "Beta — Profit: (5) (Source: h.txt)", "HIGH", "Beta"),
    ("what profit had Alpha", None, "MEDIUM", "Alpha | Item: Alpha | Amount: 10"),  # its cell is blank
    ("what amount had Alpha", "Alpha — Amount: 10 (Source: h.txt)", "HIGH", "Alpha"),
    ("value under column 9 of Alpha", None, "MEDIUM", "Alpha"),  # there is no such column
    ("value under column nothingshared", None, "MEDIUM", "- h.txt: Alpha | Item: Alpha | Amount: 10\n- h.txt: Beta"),
    ("which row names Alpha", "Alpha — Item: Alpha; Amount: 10 (Source: h.txt)", "HIGH", "Alpha"),
    ("tell me about Alpha", None, None, None),  # no question about a table
]


def test_table_answers(spark):
    from corvida.operators import tables

    chunks = spark.createDataFrame([("c", "h.txt", HOLDINGS), ("d", "other.txt", "no table")], "chunk_id string, file_name string, content string")
    q = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TABLE_CASES)], "query_id int, query string")
    evidence = q.crossJoin(chunks.select("chunk_id")).selectExpr("query_id", "chunk_id", "1.0 as score")
    rows = tables.rank_rows(q, chunks, evidence)
    got = {r.query_id: r for r in answers.table_answers(q, rows, chunks).collect()}
    for i, (question, answer, confidence, fact) in enumerate(TABLE_CASES):
        if confidence is None:
            assert i not in got
        else:
            assert (got[i].answer, got[i].confidence) == (answer, confidence), question
            assert fact in got[i].facts
    assert {r.query_id: r.labels for r in answers.requested_columns(q, rows).collect()}[2] == ["Profit"]


def test_cells_beyond_the_headers(spark):
    from corvida.operators import tables

    chunks = spark.createDataFrame([("c", "h.txt", "| A | B |\n|---|---|\n| x | | 7 |\n| - | - |\n| y |")], "chunk_id string, file_name string, content string")
    assert [tuple(r)[1:] for r in tables.markdown_cells(chunks).orderBy("row_no", "col").collect()] == [(0, 0, "A", "x"), (0, 2, "Col 3", "7"), (1, 0, "A", "y")]
    q = spark.createDataFrame([(0, "value in col three")], "query_id int, query string")
    best = tables.rank_rows(q, chunks, spark.createDataFrame([(0, "c", 1.0)], "query_id int, chunk_id string, score double")).collect()
    assert [(r.row_no, r.row_score) for r in best] == [(0, 2)]  # `col` of the label that was made up, as a term and in a cell


def test_sums_of_shared_rows(spark):
    from corvida.operators import tables

    content = "| Site | Cost |\n| --- | --- |\n| North | 5100 |\n| South | 2300 |"
    chunks = spark.createDataFrame([("c", "s.txt", content)], "chunk_id string, file_name string, content string")
    q = spark.createDataFrame([(0, "combined total of North and South cost")], "query_id int, query string")
    rows = tables.rank_rows(q, chunks, spark.createDataFrame([(0, "c", 1.0)], "query_id int, chunk_id string, score double"))
    assert answers.table_answers(q, rows, chunks).first().answer == "5100 + 2300 = 7400 (Source: s.txt)"


#: Sizes and prices whose sum is whole or just beside it, by the order in which they are added.
CLOSE = [
    ([33, 11, 26], [946.68, 989.66, 919.66]), ([43, 40, 25], [999.56, 902.43, 982.01]), ([50, 45, 8], [978.01, 995.85, 933.14]), ([16, 40, 44], [959.43, 996.68, 994.89]),
    ([48, 23, 32], [959.85, 980.66, 998.49]), ([41, 35, 7], [988.51, 986.81, 929.68]), ([17, 39, 46], [990.43, 962.18, 992.39]), ([42, 32, 32], [965.53, 977.83, 900.64]),
]


def test_facts_of_sums_beside_whole_numbers(spark, tmp_path):
    """The query and its SQL add the same cells in the same order, whatever order the rows lie in."""
    from corvida.plans import question_plans
    from tests.oracle import differences

    rows = [(500 * run + i, f"b{j}", size, price) for j, (sizes, prices) in enumerate(CLOSE) for run in range(40) for i, (size, price) in enumerate(zip(sizes, prices, strict=True))]
    df = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double")
    df.orderBy(F.xxhash64("p_partkey", "p_brand")).coalesce(1).toPandas().to_parquet(tmp_path / "part.parquet")
    assert differences(spark, question_plans.QUERIES["inject_table_facts"], question_plans.ORACLES["inject_table_facts"], str(tmp_path)) is None
