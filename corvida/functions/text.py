"""Column expressions over text: tokens, sentences, question terms, weights and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, signals and limits that results depend on.
QUESTION_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "in", "is", "it", "its",
    "me", "of", "on", "or", "should", "show", "than", "that", "the", "their", "these", "this", "to", "was", "were", "what", "when", "where", "which",
    "who", "with", "would", "you", "your"
]
KEY_WORDS = [
    "ebitda", "capex", "revenue", "profit", "margin", "assets", "liabilities", "borrowings", "inventory", "stock", "trade", "o2c", "jio", "retail",
    "quarter", "cash", "flow", "expense", "income"
]
FUSION_SIGNALS = [
    "table", " col ", " column ", " row ", " under ", "amount", "value", "inventory turnover", "ebit", "ebitda", "revenue", "profit", "margin",
    "borrowings", "assets", "liabilities", "stock-in-trade", "in crore",
]
TABLE_SIGNALS = [
    "table", "column", " col ", "under ", "row", "value", "amount", "total", "sum", "combined", "highest", "largest", "lowest", "ratio", "revenue",
    "ebit", "ebitda", "profit", "assets", "liabilities", "borrowings", "inventory", "stock-in-trade", "expenses",
]
TABLE_STOP_WORDS = [
    "what", "which", "where", "when", "that", "this", "with", "from", "were", "was", "are", "the", "and", "for", "under", "column", "table", "value",
    "values", "listed", "according", "reported", "provide", "show", "does", "did", "row", "rows", "in", "of", "to", "as", "by", "on", "a", "an"
]
#: Lines that say nothing, in lower case with single blanks: patterns, and what they are.
JUNK_PATTERNS = [r"^page\s+\d+\s+of\s+\d+$", r"^\(?₹\s*in\s*crore\)?$", r"^\(?rs\.?\s*in\s*crore\)?$", r"^\(?\$\s*in\s*millions?\)?$"]
JUNK_LINES = ["|", "-", "_", "continued"]
FURNITURE_TERMS = ["registered office", "corporate communications", "telephone", "cin:", "www.ril.com"]
#: Lines that are page furniture wherever they stand, in lower case with single blanks: patterns they hold, what they are, what
#: they hold.
FURNITURE_PATTERNS = [r"^page\s+\d+\s+of\s+\d+$", r"^\d{1,2}(?:st|nd|rd|th)?\s+[a-z]+,?\s+\d{4}$", r"^cin\b|^\s*:l\d"]
FURNITURE_LINES = ["|", "-", "_", "continued", "internet"]
FURNITURE_HOLDS = ["registered office:", "corporate communications:", "telephone", "telefax", "maker chambers", "nariman point", "mumbai 400", "www.ril.com"]
TOKENS_PER_WORD = 1.3


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    """1.3 times the pieces between runs of white space (empty pieces at the ends count), truncated, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.size(F.split(c, r"\s+")) * F.lit(TOKENS_PER_WORD)).cast("int"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), trimmed), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Pieces that end after . ! or ? with white space behind."""
    return F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: trimmed(s) != "")


def index_tokens(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits and of anything beyond ASCII."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda t: t != ""))


def query_terms(c: Column, most: int = 12) -> Column:
    """Words with inner - or & and their parts, without stop words; key words and those with a digit first, then the
    longer ones, else as they come; the first `most`."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:[-&][a-z0-9]+)*"), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda w: F.when(w.rlike("[-&]"), F.concat(F.array(w), F.split(w, "[-&]"))).otherwise(F.array(w))))
    stop = F.array(*[F.lit(w) for w in QUESTION_STOP_WORDS])
    kept = F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))
    key = F.array(*[F.lit(w) for w in KEY_WORDS])
    ranked = F.transform(kept, lambda w, i: F.struct((~(w.rlike("[0-9]") | F.array_contains(key, w))).cast("int").alias("late"), (-F.length(w)).alias("short"), i.alias("at"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(ranked), lambda s: s.w), 1, most)


def match_expression(c: Column, most: int = 12) -> Column:
    plain = F.filter(query_terms(c, most), lambda w: ~w.rlike("[-&]"))
    return F.array_join(F.transform(plain, lambda w: F.concat(w, F.lit("*"))), " OR ")


def query_phrases(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(c), "[,;?]"), trimmed), lambda p: F.length(p) >= 8)


def query_numbers(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"[-(]?\d[\d,]*(?:\.\d+)?%?[)]?"), F.lit(0)), lambda n: F.length(n) >= 2))


def once(value: Column, body) -> Column:
    """body(value), with the value taken once however often the body names it; what stands in a lambda or behind a condition
    is taken anew each time otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_any(c: Column, signals: list[str]) -> Column:
    return once(F.lower(c), lambda low: F.exists(F.array(*[F.lit(s) for s in signals]), lambda s: F.contains(low, s)))


def vector_weight(c: Column) -> Column:
    return F.when(has_any(c, FUSION_SIGNALS), 0.45).otherwise(0.75)


def is_table_question(c: Column) -> Column:
    return has_any(c, TABLE_SIGNALS)


def parse_number(c: Column) -> Column:
    """A cell's number: without , ₹ $ %, in brackets negative; null if there is none."""
    cleaned = trimmed(F.regexp_replace(c, r"[,₹$%]", ""))
    value = F.regexp_replace(cleaned, r"^[()]+|[()]+$", "").try_cast("double")
    return F.when(cleaned.rlike(r"^\(.*\)$"), -value).otherwise(value)


def masked_signature(c: Column) -> Column:
    """Lower-case text with page marks and digit runs masked and white space squeezed."""
    paged = F.regexp_replace(F.lower(trimmed(c)), r"page\s+\d+\s+of\s+\d+", "page # of #")
    return trimmed(F.regexp_replace(F.regexp_replace(paged, r"\d+", "#"), r"\s+", " "))


def is_junk(c: Column) -> Column:
    """Every non-blank line is a page number, unit caption or the like, or there is at most one character."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: trimmed(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x != "")
    whole = trimmed(F.regexp_replace(F.lower(c), r"\s+", " "))
    junk = lambda x: reduce(lambda found, p: found | x.rlike(p), JUNK_PATTERNS, x.isin(JUNK_LINES))
    return ((F.size(lines) > 0) & F.forall(lines, junk)) | (F.length(whole) <= 1) | junk(whole)


def is_furniture(c: Column) -> Column:
    """Boilerplate of pages, by FURNITURE_PATTERNS, _LINES and _HOLDS; false for a null text."""
    def found(low: Column) -> Column:
        held = low.isin(FURNITURE_LINES) | has_any(low, FURNITURE_HOLDS)
        for pattern in FURNITURE_PATTERNS:
            held = held | low.rlike(pattern)
        return F.coalesce(held, F.lit(False))

    return once(trimmed(F.regexp_replace(F.lower(c), r"\s+", " ")), found)


def furniture_key(signature: Column) -> Column:
    """Of a digit-masked signature, the first of FURNITURE_TERMS in it, or `page` for a page mark; null for any other."""
    terms = [F.when(F.contains(signature, F.lit(t)), F.lit(t)) for t in FURNITURE_TERMS]
    return F.coalesce(*terms, F.when(signature == "page # of #", F.lit("page")))
