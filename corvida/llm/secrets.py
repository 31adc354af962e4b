"""Secret scans in DataFrame functions: fixed patterns, then a randomness test battery over opaque tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm.common import cut, unused

#: kind, pattern, group whose length counts, least length. A run of a class is taken from its start only, which is
#: what the leftmost longest match finds; so the least length of hex and access keys can stand in the pattern.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
)
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding, pattern of the whole token, its alphabet in order; the first that fits is inferred.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+$", UPPER + "234567"),
    ("lower", r"^[a-z]+$", LOWER),
    ("UPPER", r"^[A-Z]+$", UPPER),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", r"^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
)
STEPS = 100
#: Random tokens drawn to tell how p-values of truly random ones of an encoding and length fall; lengths above LONGEST, at
#: which the tests are near their limits, are drawn at that.
DRAWN, LONGEST = 2000, 256
#: What random_shares has measured, by encoding and length: at most len(ENCODINGS) * LONGEST entries.
_MEASURED: dict[tuple[str, int], list[float]] = {}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end, token>>, in code points, of the matches whose group is long enough. The pieces
    between matches give the places."""
    joined = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    kind_of = "array<struct<start:int,kind:int,end:int,token:string>>"
    walked = F.aggregate(
        F.filter(joined, lambda x: x.hit.isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out")),
        lambda acc, x: _let(
            acc.at + F.length(x.gap),
            lambda start: F.struct(
                (start + F.length(x.hit)).alias("at"),
                F.when(F.length(x.value) >= least, F.array_append(acc.out, F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x.hit)).alias("end"), x.hit.alias("token")))).otherwise(acc.out).alias("out"),
            ),
        ),
    ).out
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(kind_of))


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal, by a rational approximation of erfc (absolute error under 2e-7)."""

    def of(x: Column) -> Column:
        t = 1 / (1 + 0.3275911 * x)
        return F.least(F.lit(1.0), (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x))

    return _let(F.least(F.abs(z) / 2**0.5, F.lit(25.0)), of)


def battery(token: Column) -> Column:
    """struct<encoding, n, p> of a token: p is 1 - (1 - m)^3 of the least m of three two-sided p-values under "uniform random
    symbols of the inferred alphabet": chi-squared of symbol counts (Wilson-Hilferty), number of runs above and below
    the alphabet's middle, correlation of neighbouring symbols."""
    name = F.coalesce(*[F.when(token.rlike(p), F.lit(e)) for e, p, _ in ENCODINGS])
    alphabet = F.coalesce(*[F.when(token.rlike(p), F.lit(a)) for _, p, a in ENCODINGS])

    def tests(x: Column) -> Column:
        ranks, k, n = x.ranks, x.k.cast("double"), F.size(x.ranks).cast("double")
        counts = F.transform(F.array_distinct(ranks), lambda d: F.size(F.filter(ranks, lambda r: r == d)).cast("double"))
        chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) - n
        spread = 2 / (9 * (k - 1))
        p_chi = _two_sided((F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        high = F.transform(ranks, lambda r: (2 * r >= x.k).cast("int"))
        pairs = F.arrays_zip(F.slice(ranks, F.lit(1), F.size(ranks) - 1), F.slice(ranks, F.lit(2), F.size(ranks) - 1))

        def runs(h: Column) -> Column:
            n1 = F.aggregate(h, F.lit(0), lambda a, v: a + v).cast("double")
            r = 1 + F.size(F.filter(F.arrays_zip(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1)), lambda v: v["0"] != v["1"]))
            mean = 2 * n1 * (n - n1) / n + 1
            return F.when((n1 == 0) | (n1 == n), 0.0).otherwise(_two_sided((r - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))))

        def serial(mean: Column) -> Column:
            top = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + (v["0"] - mean) * (v["1"] - mean))
            low = F.aggregate(ranks, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            return _let(low, lambda b: F.when(b == 0, 0.0).otherwise(_two_sided((top / b + 1 / n) * F.sqrt(n))))

        p_serial = _let(F.aggregate(ranks, F.lit(0.0), lambda a, v: a + v) / n, serial)
        return F.struct(x.encoding.alias("encoding"), F.size(ranks).alias("n"), (1 - F.pow(1 - F.least(p_chi, _let(high, runs), p_serial), F.lit(3.0))).alias("p"))

    # the inferred alphabet is held fast before the symbols are looked up in it, or its patterns would run for each symbol
    inferred = F.struct(name.alias("encoding"), alphabet.alias("alphabet"))
    ranked = lambda e: F.struct(e.encoding.alias("encoding"), F.length(e.alphabet).alias("k"), F.transform(F.split(token, ""), lambda c: F.position(c, e.alphabet) - 1).alias("ranks"))
    return _let(inferred, lambda e: _let(ranked(e), tests))


def _testable(t: Column) -> Column:
    """Letters and digits together, or a length at which letters or digits alone show whether they are random."""
    mixed = t.encoding.isin("hex", "HEX", "base32", "base36", "BASE36", "base62", "base64url", "base64") & t.mixed
    return mixed | ((t.n >= 52) & t.encoding.isin("lower", "UPPER", "letters")) | ((t.n >= 32) & (t.encoding == "decimal"))


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _step(p: Column) -> Column:
    return F.least(F.floor(p * STEPS), F.lit(STEPS - 1)).cast("int")


def drawn_tokens(spark: SparkSession, kinds: list[tuple[str, int]], each: int = DRAWN) -> DataFrame:
    """(encoding, n, token): `each` tokens of uniform random symbols for every (encoding, length); the same on every run."""
    alphabets = {e: a for e, _, a in ENCODINGS}
    told = spark.createDataFrame([(e, n, alphabets[e]) for e, n in kinds], "encoding string, n int, alphabet string")
    rows = told.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(each))))
    symbol = lambda at: F.substring(F.col("alphabet"), F.pmod(F.xxhash64("encoding", "n", "i", at), F.length("alphabet")).cast("int") + 1, F.lit(1))
    return rows.select("encoding", "n", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), symbol), "").alias("token"))


def random_shares(spark: SparkSession, kinds: list[tuple[str, int]]) -> dict[tuple[str, int], list[float]]:
    """For each (encoding, length) the share of random tokens with a p of step / STEPS or more, by step. Of the drawn ones
    those count that would be inferred to be of the encoding and would be tested. Measured once for each."""
    new = sorted(set(kinds) - set(_MEASURED))
    if new:
        drawn = drawn_tokens(spark, new).repartition(spark.sparkContext.defaultParallelism)
        tested = drawn.select("encoding", "n", battery(F.col("token")).alias("b"), (F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")).alias("mixed"))
        tested = tested.select(F.col("encoding").alias("drawn"), "n", F.struct("b.encoding", "b.n", "b.p", "mixed").alias("t")).where((F.col("t.encoding") == F.col("drawn")) & _testable(F.col("t")))
        counts: dict[tuple[str, int], list[int]] = {k: [0] * STEPS for k in new}
        for encoding, n, step, count in tested.groupBy("drawn", "n", _step(F.col("t.p"))).count().collect():
            counts[encoding, n][step] += count
        _MEASURED.update({k: [sum(c[step:]) / max(1, sum(c)) for step in range(STEPS + 1)] for k, c in counts.items()})
    return {k: _MEASURED[k] for k in kinds}


def thresholds(candidates: DataFrame, q: float = 0.1, level: float = 0.01) -> list[tuple[int, float]]:
    """For each length class (the power of two in n), the least p from which tokens (encoding, n, p) count as random.

    Tokens that aren't random are taken to have p under a half. How p-values of random ones fall is measured, for each
    encoding at the class's mean length (to the nearest 4), on drawn tokens; what lies over a half, less one standard error, then tells
    how many random tokens there are, and so how many of them lie between a cut and a half. What a class has there beyond
    them are false discoveries. The cut is the least one (level at first) at which those are at most the share q, in a class
    of one token as in one of millions; at a half, where the estimate begins, none are left. A small class so pays with
    missed tokens, never with false ones. Only counts by encoding, class and step are gathered.
    """
    grouped = candidates.groupBy("encoding", _length_class(F.col("n")).alias("length"), _step(F.col("p")).alias("step")).agg(F.count("*").alias("count"), F.sum("n").alias("symbols"))
    classes: dict[int, dict[str, list[int]]] = {}
    symbols: dict[tuple[int, str], list[int]] = {}
    for encoding, length, step, count, total in grouped.collect():
        classes.setdefault(length, {}).setdefault(encoding, [0] * STEPS)[step] += count
        symbols.setdefault((length, encoding), []).append(total)
    kind = {(length, e): (e, min(LONGEST, 4 * round(sum(symbols[length, e]) / sum(c) / 4))) for length, by in classes.items() for e, c in by.items()}
    shares = random_shares(candidates.sparkSession, sorted(set(kind.values()))) if kind else {}
    found, half = [], STEPS // 2
    for length, by in sorted(classes.items()):
        cut_at, counts = 1.1, [sum(c) for c in zip(*by.values(), strict=True)]
        for step in range(max(1, round(level * STEPS)), half + 1):
            between = 0.0  # random tokens from the cut to a half
            for e, c in by.items():
                share, over = shares[kind[length, e]], sum(c[half:])
                between += max(0.0, over - over**0.5) * (share[step] - share[half]) / share[half] if share[half] else 0.0
            flagged = sum(counts[step:])
            if flagged and sum(counts[step:half]) - between <= q * flagged:
                cut_at = step / STEPS
                break
        found.append((length, cut_at))
    return found


def _scan(text: Column) -> Column:
    return F.flatten(F.array(*[_spans(text, p, g, least, i) for i, (_, p, g, least) in enumerate(BASE)]))


def _tested(text: Column) -> Column:
    def of(s: Column) -> Column:
        both = s.token.rlike("[0-9]") & s.token.rlike("[A-Za-z]")
        return _let(battery(s.token), lambda b: F.struct(s.start.alias("start"), F.lit(len(BASE)).alias("kind"), s.end.alias("end"), b.encoding.alias("encoding"), b.n.alias("n"), b.p.alias("p"), both.alias("mixed")))

    return F.filter(F.transform(_spans(text, TOKEN, 0, 20, len(BASE)), of), _testable)


def find_spans(docs: DataFrame, text_col: str, q: float = 0.1, out: str = "spans", text_kept: bool = True) -> DataFrame:
    """docs with a column `out`, a name that docs doesn't have: array<struct<start, kind, end>> by start and kind; kind 0
    to 2 as in BASE, 3 for tokens that pass the battery and overlap no base span. Null text: none.

    One pass gathers base spans and tested tokens. The thresholds come from all documents' tokens; only counts reach
    the driver. Without text_kept the texts are left behind before that.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, tested = unused("base", docs), unused("tested", docs)
    scanned = docs.withColumn(base, F.transform(_scan(text), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))).withColumn(tested, _tested(text))
    scanned = cut(scanned if text_kept else scanned.drop(text_col), "spans")
    limits = thresholds(scanned.select(F.explode(tested).alias("t")).select("t.*"), q)
    limit = lambda n: F.coalesce(*[F.when(_length_class(n) == c, t) for c, t in limits], F.lit(1.1))
    clear = lambda t: ~F.exists(base, lambda b: (b.start < t.end) & (t.start < b.end))
    more = F.transform(F.filter(tested, lambda t: (t.p >= limit(t.n)) & clear(t)), lambda t: F.struct(t.start.alias("start"), t.kind.alias("kind"), t.end.alias("end")))
    return scanned.withColumn(out, F.array_sort(F.concat(base, more))).drop(base, tested)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.1) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_random. Null and empty texts have
    none, and the digest of an empty list. Rows with null or repeated ids each keep their row; other columns are left
    out; an empty table gives an empty result."""
    got = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", q, text_kept=False)
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind < len(BASE))
    return got.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), of(3).alias("n_random"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", q: float = 0.1) -> DataFrame:
    """docs with every span of the text replaced by `mark`, overlapping spans by one. Texts without a span, null ones
    included, stay as they are, and so do all other columns."""
    names, spans = docs.columns, unused("spans", docs)
    got = find_spans(docs, text_col, q, spans)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text_col), acc.at + 1, s.start - acc.at)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, gap, F.lit(mark))).otherwise(acc.out).alias("out"))

    walked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc.out, F.substring(F.col(text_col), acc.at + 1, F.length(text_col))))
    return got.withColumn(text_col, F.when(F.size(spans) > 0, walked).otherwise(F.col(text_col))).select(*names)
