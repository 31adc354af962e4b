"""Column expressions that read questions and the free-text labels models give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvida.functions import text as T

# The signals of each routing rule.
OUTSIDE_DOCUMENTS = ["favorite color", "weather", "stock price today", "current market price", "latest news", "tomorrow", "near me"]
SPECULATIVE = [
    "optimal", "unforeseen", "unspoken", "future-proof", "future proof", "market sentiment", "ripple effects", "next five years", "anticipated",
    "undefined", "precisely translate", "maximize roi", "potential supply chain",
]
GREETINGS = ["hello", "hi ", "hey ", "good morning", "good afternoon", "good evening", "thanks", "thank you", "bye", "goodbye"]
ABOUT_THE_CONVERSATION = [
    "explain that again", "rephrase that", "say that again", "what did you mean", "summarize our conversation", "summarize what we discussed",
    "what can you do", "what are your capabilities", "who are you", "what are you",
]
ARITHMETIC_LINE = r"^\s*[\d\s+\-*/%(). ]+\s*$"
ARITHMETIC_PHRASES = ["% of ", "percent of ", "percentage of ", "divided by ", "multiplied by ", "times ", "square root", "power of"]
WORLD_KNOWLEDGE = [
    "capital of ", "president of ", "prime minister of ", "population of ", "currency of ", "who wrote ", "who invented ", "who discovered ", "define ",
    "meaning of ",
]
FOLLOW_UPS = [
    "you mentioned", "as you said", "from what you said", "you said", "that figure", "that number", "that value", "that amount", "that point",
    "the first point", "the second point", "the last point", "tell me more about that", "elaborate on that", "expand on that", "what was that",
    "what were those", "going back to", "based on what we discussed", "from the previous answer", "in your previous response", "in your last response",
]
TABLE_LOOKUPS = [
    "according to the table", "expenses table", "stock-in-trade table", "segment results", " col ", " column ", " row ", "under col", "under column",
    "in column", "inventory turnover", "payment of lease liabilities", "production figures", "amount associated with",
]
NAMED_DOCUMENTS = [
    "provided documents", "according to the documents", "in the documents", "first provided chunk", "second provided chunk", "first chunk", "second chunk",
]
BRIDGES = [
    " and what factors ", " and which components ", " and what operational ", " and what amount ", " and where ", " and how ", " and then ", " along with ",
    " as well as ", " sum of ",
]
LOOKUP_STARTS = [
    "what is ", "what was ", "what were ", "which ", "who ", "when ", "where ", "under which ", "according to ", "based on ", "for the ", "describe ",
    "identify ",
]
LOOKUP_EXCLUDED = [
    "compare", "comparison", "versus", " vs ", "difference between", "across different documents", "across all documents", "all documents",
    "synthesize", "summarize across",
]
COMPARISONS = [
    "compare", "comparison", "versus", " vs ", "difference", "differ", "across documents", "all documents", "between documents", "trend", "change from",
    "summarize the key", "synthes", "relationship", "correlat", "why did", "what are the risks",
]
METRICS = r"\b(q[1-4]|fy\d{2,4}|revenue|ebitda|profit|margin|capex|cash flow|assets|liabilities|borrowings|segment)\b"
RETRIEVED_MARK = "[Source:"
MOST_SUBQUERIES = 4


def _starts(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(c, w))


def route(query: Column, has_documents: Column, history: Column, label: Column) -> Column:
    """DIRECT, AGENTIC or SINGLE_SHOT: the first rule that holds decides, then the label. Nulls are empty texts."""
    q, history, label = F.lower(F.coalesce(query, F.lit(""))), F.coalesce(history, F.lit("")), F.upper(F.coalesce(label, F.lit("")))
    times = lambda pattern: F.regexp_count(q, F.lit(pattern))
    greets = _starts(q, GREETINGS) | F.rtrim(q).isin([g.strip() for g in GREETINGS])
    computes = q.rlike(ARITHMETIC_LINE) | (q.rlike(r"\d") & T.has_any(q, ARITHMETIC_PHRASES))
    direct = T.has_any(q, OUTSIDE_DOCUMENTS + SPECULATIVE) | greets | T.has_any(q, ABOUT_THE_CONVERSATION) | computes | T.has_any(q, WORLD_KNOWLEDGE)
    follows = F.contains(history, F.lit(RETRIEVED_MARK)) & T.has_any(q, FOLLOW_UPS)
    looks_up = _starts(q, LOOKUP_STARTS) & ~T.has_any(q, LOOKUP_EXCLUDED) & (times(r"\b(and|including)\b") <= 3)
    combines = T.has_any(q, COMPARISONS) | ((times(r"\b(and|versus|vs|while|whereas)\b") >= 1) & (times(METRICS) >= 2))
    by_rule = F.when(~has_documents, "SINGLE_SHOT").when(direct | follows, "DIRECT").when(T.has_any(q, TABLE_LOOKUPS + NAMED_DOCUMENTS + BRIDGES), "AGENTIC")
    return by_rule.when(looks_up, "SINGLE_SHOT").when(combines, "AGENTIC").otherwise(route_label(label))


def route_label(response: Column) -> Column:
    r = F.upper(response)
    return F.when(F.contains(r, F.lit("DIRECT")), "DIRECT").when(F.contains(r, F.lit("AGENTIC")), "AGENTIC").otherwise("SINGLE_SHOT")


def relevance_label(response: Column) -> Column:
    r = F.upper(response)
    return F.when(F.contains(r, F.lit("REQUERY")), "REQUERY").when(F.contains(r, F.lit("SUPPLEMENT")), "SUPPLEMENT").otherwise("USE")


def gap_query(response: Column) -> Column:
    """What stands behind the first colon of a response that starts with INSUFFICIENT; else null."""
    r = T.trimmed(response)
    return F.when(F.startswith(F.upper(r), F.lit("INSUFFICIENT")) & F.contains(r, F.lit(":")), T.trimmed(F.regexp_replace(r, "(?s)^[^:]*:", "")))


def retrieval_mode(preference: Column) -> Column:
    p = F.lower(preference)
    return F.when(p == "vector", "VECTOR").when(p == "bm25", "BM25").otherwise("HYBRID")


def first_of_each(items: Column, key) -> Column:
    """Items whose key did not occur before them."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, key), key(x)) == i + 1)


def subqueries(response: Column, original: Column, most: int = MOST_SUBQUERIES) -> Column:
    """Quoted strings of the outermost [...], distinct without regard to case; the original question is always among
    them, in the last place if it has to be added. Without any string: the original alone."""
    listed = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)\[.*\]", 0)
    items = F.slice(F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1)), 1, most)
    items = first_of_each(F.filter(F.transform(items, T.trimmed), lambda x: x != ""), F.lower)
    own = T.trimmed(original)
    known = F.exists(items, lambda x: F.lower(x) == F.lower(own))
    return F.when(known, items).otherwise(F.filter(F.concat(F.slice(items, 1, most - 1), F.array(own)), lambda x: x != ""))
