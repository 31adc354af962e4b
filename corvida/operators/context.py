"""Shaping of evidence: sentence reduction, packing into a token budget, context strings, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import text as T


def words_over_two(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda w: F.length(w) > 2))


def reduce_sentences(hits: DataFrame, most: int = 5) -> DataFrame:
    """hits (query_id, chunk_id, query, content): the `most` sentences (over 10 characters) with the highest share of the
    question's words (over 2), in their order. Fewer sentences, no such words, or a table: unchanged."""
    q = words_over_two(F.col("query"))
    sents = F.filter(F.split(F.regexp_replace("content", r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.length(T.trimmed(s)) > 10)
    got = hits.withColumn("_q", q).withColumn("_s", sents)
    scored = F.transform("_s", lambda s, i: F.struct((-F.size(F.array_intersect("_q", words_over_two(s)))).alias("less"), i.alias("at"), s.alias("s")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: F.struct(x.at, x.s)))
    is_table = F.exists(F.split("content", "\n"), lambda x: F.startswith(T.trimmed(x), F.lit("|")))
    keep = is_table | (F.size("_s") <= most) | (F.size("_q") == 0)
    return got.withColumn("content", F.when(keep, F.col("content")).otherwise(F.array_join(F.transform(best, lambda x: x.s), " "))).drop("_q", "_s")


def is_table_chunk(c):
    return F.exists(F.split(c, "\n"), lambda x: F.startswith(T.trimmed(x), F.lit("|")))


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """hits (query_id, chunk_id, rank, content): by rank while the running token estimate stays within the budget; stops at
    the first overflow."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("tokens", F.sum(T.token_estimate(F.col("content"))).over(w)).where(F.col("tokens") <= budget)


def context_strings(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, file_name, score, content) to one context per question."""
    part = F.concat(F.lit("[Source: "), F.col("file_name"), F.lit(", relevance: "), F.format_string("%.2f", F.col("score")), F.lit("]\n"), F.col("content"))
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))).alias("parts"))
    return got.select("query_id", F.array_join(F.transform("parts", lambda p: p.text), "\n\n---\n\n").alias("context"))


def citations(hits: DataFrame, snippet: int = 200) -> DataFrame:
    """JSON array of title, snippet and score per question, best first."""
    s = F.struct((-F.col("score")).alias("_o"), "chunk_id", F.col("file_name").alias("title"), F.substring("content", 1, snippet).alias("snippet"), F.col("score").alias("score"))
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    return got.select("query_id", F.to_json(F.transform("s", lambda x: F.struct(x.title, x.snippet, x.score))).alias("sources"))


def parse_citations(raw):
    return F.coalesce(F.from_json(raw, "array<struct<title:string,snippet:string,score:double>>"), F.array().cast("array<struct<title:string,snippet:string,score:double>>"))


def is_rule_line(line):
    """A | line of nothing but bars, dashes and blanks."""
    return F.startswith(T.trimmed(line), F.lit("|")) & (F.regexp_replace(line, r"[|\- ]", "") == "")


def reduce_table_lines(hits: DataFrame, most_tokens: int | Column = 700) -> DataFrame:
    """hits (…, query, content): texts over the budget keep their separator lines and then the lines that share most words
    with the question, each that still fits; lines that share none only while nothing else was taken. The lines taken are
    bounded by the budget, so that one row's list stays small however long its text is."""
    q = words_over_two(F.col("query"))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: T.trimmed(x) != "")
    words = lambda x: F.size(F.split(T.trimmed(x), r"\s+"))
    got = hits.withColumn("_q", q).withColumn("_l", lines)
    got = got.withColumn("_rules", F.array_distinct(F.filter("_l", is_rule_line))).withColumn("_data", F.filter("_l", lambda x: ~is_rule_line(x)))
    ranked = F.array_sort(F.transform("_data", lambda x, i: F.struct((-F.size(F.array_intersect("_q", words_over_two(x)))).alias("less"), i.alias("at"), x.alias("x"))))
    start = F.struct(F.aggregate("_rules", F.lit(0), lambda a, x: a + words(x)).alias("n"), F.array().cast("array<string>").alias("taken"))

    def step(a, r):
        fits = F.floor((a.n + words(r.x)) * T.TOKENS_PER_WORD) <= most_tokens
        wanted = (r.less < 0) | (F.size(a.taken) == 0)
        return F.when(fits & wanted, F.struct((a.n + words(r.x)).alias("n"), F.concat(a.taken, F.array(r.x)).alias("taken"))).otherwise(a)

    kept = F.array_join(F.concat(F.col("_rules"), F.aggregate(ranked, start, step).taken), "\n")
    cut = F.when(T.trimmed(kept) == "", F.substring("content", 1, 1200)).otherwise(kept)
    return got.withColumn("content", F.when((T.token_estimate(F.col("content")) <= most_tokens) | (F.size("_q") == 0), F.col("content")).otherwise(cut)).drop("_q", "_l", "_rules", "_data")


def first_words(c, tokens):
    """The first floor(tokens / 1.3) words, one at least, joined by single blanks."""
    return F.array_join(F.slice(F.split(c, r"\s+"), F.lit(1), F.greatest(F.lit(1), F.floor(tokens / T.TOKENS_PER_WORD).cast("int"))), " ")


def trim_last_chunk(hits: DataFrame, budget: int, margin: int = 24, least: int = 80) -> DataFrame:
    """hits (query_id, chunk_id, rank, content): the first chunk that overflows the budget, cut to the largest of what
    remains and its halvings (over `least` tokens) whose cut text fits; no row where none does."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = T.token_estimate(F.col("content"))
    got = hits.withColumn("_own", own).withColumn("_upto", F.sum(own).over(w))
    got = got.where((F.col("_upto") > budget) & (F.col("_upto") - F.col("_own") <= budget)).withColumn("_left", (F.lit(budget) - (F.col("_upto") - F.col("_own")) - margin).cast("int"))
    halves = F.filter(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: F.col("_left") / F.pow(F.lit(2), n)), lambda b: F.floor(b) > least)
    fitting = F.filter(F.transform(halves, lambda b: F.floor(b)), lambda b: T.token_estimate(first_words(F.col("content"), b)) <= F.col("_left") + margin)
    return got.withColumn("budget", F.array_max(fitting)).where("budget is not null").select("query_id", "chunk_id", F.col("budget").cast("long").alias("budget"), first_words(F.col("content"), F.col("budget")).alias("content"))


#: Tokens kept free, the least reserve for the answer, the least input, the least cut chunk.
SAFETY_MARGIN, LEAST_RESERVE, LEAST_INPUT, CUT_MARGIN, LEAST_CUT = 128, 100, 512, 24, 80


def input_limit(window: int, output: int) -> int:
    """Tokens of a prompt: the window without the answer's reserve (half the window at most) and the margin."""
    return max(LEAST_INPUT, window - min(max(output, 1), max(window // 2, LEAST_RESERVE)) - SAFETY_MARGIN)


def word_count(c: Column) -> Column:
    text = T.trimmed(F.coalesce(c, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def budgeted_chunks(questions: DataFrame, hits: DataFrame, instructions: str, window: int = 4000, output: int = 1000) -> DataFrame:
    """(query_id, rank, chunk_id, file_name, score, content, budget): the chunks that the whole prompt has room for.

    questions: (query_id, query, note); hits: (query_id, rank, chunk_id, file_name, score, content). The prompt holds the
    instructions, a context string of the chunks, the question and the note. Chunks are taken by score (then rank) while
    it stays within input_limit(); the first that overflows is reduced to the question's sentences or table lines and cut
    to a budget, what is left and then its halvings over 80 tokens, and nothing follows it. budget is null for a chunk
    taken whole.
    """
    limit = input_limit(window, output)
    tokens = lambda words: F.floor(words * T.TOKENS_PER_WORD)
    fixed = F.lit(len(instructions.split())) + word_count(F.col("query")) + word_count(F.col("note"))
    head = F.concat(F.lit("[Source: "), F.col("file_name"), F.lit(", relevance: "), F.format_string("%.2f", F.col("score")), F.lit("]\n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    got = hits.join(questions.select("query_id", "query", fixed.alias("_fixed")), "query_id").withColumn("_at", F.row_number().over(w))
    own = lambda content: word_count(F.concat(head, content)) + (F.col("_at") > 1).cast("int")
    upto = F.sum(own(F.col("content"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("_upto", F.col("_fixed") + upto).withColumn("_before", F.coalesce(F.lag("_upto").over(w), F.col("_fixed")))
    names = ["query_id", "rank", "chunk_id", "file_name", "score", "content"]
    whole = got.where(tokens(F.col("_upto")) <= limit).select(*names, F.lit(None).cast("long").alias("budget"))
    over = got.where((tokens(F.col("_upto")) > limit) & ((tokens(F.col("_before")) <= limit) | (F.col("_at") == 1)))
    left = F.lit(limit) - tokens(F.col("_before")) - CUT_MARGIN
    tried = over.withColumn("budget", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda n: F.floor(left / F.pow(F.lit(2.0), n)).cast("long")), lambda b: b > LEAST_CUT)))
    tried = tried.withColumn("_table", is_table_chunk(F.col("content")))
    reduced = reduce_table_lines(tried.where("_table"), F.col("budget")).unionByName(reduce_sentences(tried.where("not _table")))
    cut = reduced.withColumn("content", first_words(F.col("content"), F.col("budget")))
    fits = cut.where(tokens(F.col("_before") + own(F.col("content"))) <= limit)
    best = fits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("budget")))).where("_n = 1")
    return whole.unionByName(best.select(*names, "budget"))


def budgeted_history(questions: DataFrame, chunks: DataFrame, instructions: str, window: int = 4000, output: int = 1000) -> DataFrame:
    """(query_id, history, tokens): the newest non-blank lines of questions.history while the whole prompt, with the chunks
    of budgeted_chunks(), stays within input_limit(); up to the first line that overflows it."""
    limit = input_limit(window, output)
    head = F.concat(F.lit("[Source: "), F.col("file_name"), F.lit(", relevance: "), F.format_string("%.2f", F.col("score")), F.lit("]\n"))
    used = chunks.groupBy("query_id").agg((F.sum(word_count(F.concat(head, F.col("content")))) + F.count("*") - 1).alias("used"))
    fixed = F.lit(len(instructions.split())) + word_count(F.col("query")) + word_count(F.col("note")) + F.coalesce("used", F.lit(0))
    all_lines = F.filter(F.transform(F.split(F.coalesce("history", F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: T.trimmed(x) != "")
    got = questions.join(used, "query_id", "left").select("query_id", fixed.alias("fixed"), all_lines.alias("lines"))
    lines = got.select("query_id", "fixed", F.posexplode("lines").alias("at", "line"))
    w = Window.partitionBy("query_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("upto", F.col("fixed") + F.sum(word_count(F.col("line"))).over(w)).where(F.floor(F.col("upto") * T.TOKENS_PER_WORD) <= limit)
    told = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n").alias("history"), F.max("upto").alias("words"))
    whole = got.select("query_id", "fixed").join(told, "query_id", "left")
    return whole.select("query_id", F.coalesce("history", F.lit("")).alias("history"), F.floor(F.coalesce("words", "fixed") * T.TOKENS_PER_WORD).cast("long").alias("tokens"))
