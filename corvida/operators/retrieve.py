"""Retrieval of a table of questions against a table of chunks: postings, lexical and vector search, fusion, expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import text as T

RRF_K, GROUP_CAP, SECTION_CAP = 60, 3, 4
#: Scores that a task holds at once, whatever the sizes of the blocks that meet.
TILE = 1 << 20


def postings(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id, doc_id, chunk_index): distinct tokens of every chunk."""
    return chunks.select("chunk_id", "doc_id", "chunk_index", F.explode(T.index_tokens(F.col("content"))).alias("token"))


def lexical_candidates(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, doc_id, chunk_index): chunks with a token that starts with any plain term of the question, the
    first 6k in document order. The texts are read once."""
    return first_chunks(plain_terms(questions), postings(chunks), 6 * k)


def plain_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term): the terms that tokens are sought by."""
    return questions.select("query_id", F.explode(F.filter(T.query_terms(F.col("query")), lambda w: ~w.rlike("[-&]"))).alias("term"))


def first_chunks(asked: DataFrame, postings: DataFrame, most: int) -> DataFrame:
    """For each question of asked (query_id, term) the first `most` chunks, in document order, of the postings (token,
    chunk_id, doc_id, chunk_index) whose token starts with one of its terms.

    The first chunks of a question are among the first of each of its terms, and those among the first of each of the
    term's tokens. So postings are cut per token, then per term, whoever asks for it, then per question; every cut runs
    before its shuffle too. A token's row carries its first chunks alone, however frequent the word. Tokens meet terms by
    equality of their prefixes, and the chunks come in for those alone that a term begins.
    """
    places = ("doc_id", "chunk_index", "chunk_id")
    # a chunk that comes more than once has one place: rows are cut as they lie, and made distinct when few are left
    first = lambda df, by: df.withColumn("_at", F.dense_rank().over(Window.partitionBy(by).orderBy(*places))).where(F.col("_at") <= most).drop("_at").distinct()
    by_token = first(postings, "token").groupBy("token").agg(F.collect_list(F.struct("chunk_id", "doc_id", "chunk_index")).alias("places"))
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.length("token"), F.lit(2))), lambda n: F.substring("token", F.lit(1), n))
    begun = by_token.select("token", F.explode(prefixes).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    by_term = first(begun.join(by_token, "token").select("term", F.inline("places")), "term")
    return first(asked.join(by_term, "term").select("query_id", "chunk_id", "doc_id", "chunk_index"), "query_id")


def asked_words(query: Column) -> list[Column]:
    """What the lexical score looks for: terms, phrases and numbers of a question."""
    return [T.query_terms(query).alias("terms"), T.query_phrases(query).alias("phrases"), T.query_numbers(F.lower(query)).alias("numbers")]


def lexical_score(low: Column, path: Column, file: Column, kind: Column, group: Column) -> Column:
    """Score of a chunk, by its content in lower case, for the question whose `asked_words` stand beside it."""
    count = lambda test, of="terms": F.size(F.filter(F.col(of), test)).cast("double")
    score = 3 * count(lambda t: F.contains(low, t)) + 1.5 * count(lambda t: F.contains(path, t)) + 0.5 * count(lambda t: F.contains(file, t))
    score += 8 * count(lambda p: F.contains(low, p), "phrases")
    score += F.when(F.startswith(low, F.lit("table:")) | F.contains(low, F.lit("\ntable:")), 1 + 2.5 * count(lambda t: F.contains(low, F.concat(t, F.lit(":"))))).otherwise(0)
    score += F.when(kind.isin("TABLE", "TABLE_PART"), 1 + 2.5 * count(lambda t: F.contains(low, F.concat(t, F.lit(":"))) | F.contains(low, F.concat(F.lit("| "), t)))).otherwise(0)
    score += 4 * count(lambda n: F.contains(low, n), "numbers")
    return score + F.when(group.isNotNull(), 0.5).otherwise(0)


def lexical_topk(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, lexical_score, lexical_rank, score): candidates with a positive score, best first, equal ones
    in document order. A question's words are taken once, before it meets its candidates, a chunk's text is lower-cased
    once for each."""
    return scored_topk(questions, lexical_candidates(questions, chunks, k), chunks, k)


def scored_topk(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """candidates (query_id, chunk_id, doc_id, chunk_index), scored by their chunks' texts, the k best of each question."""
    asked = questions.select("query_id", *asked_words(F.col("query")))
    lower = lambda c: F.lower(c).alias(c)
    texts = chunks.select("chunk_id", lower("content"), lower("hierarchy_path"), lower("file_name"), "chunk_type", "group_id")
    found = candidates.join(texts, "chunk_id").join(asked, "query_id")
    score = lexical_score(*[F.col(c) for c in ("content", "hierarchy_path", "file_name", "chunk_type", "group_id")])
    scored = found.select("query_id", "chunk_id", "doc_id", "chunk_index", score.alias("lexical_score"))
    return ranked(scored.where("lexical_score > 0"), "lexical_score", k, ("doc_id", "chunk_index")).select("query_id", "chunk_id", "lexical_score", F.col("rank").alias("lexical_rank"), (1 / (RRF_K + F.col("rank"))).alias("score"))


def ranked(hits: DataFrame, by: str, k: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best per question; equal ones by the columns `ties`, then by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), *ties, "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(rows: pa.ListScalar) -> tuple[pa.StructArray, np.ndarray]:
    """The rows of a block and their vectors as a matrix of unit rows of doubles; zero vectors stay zero."""
    block = rows.values
    vectors = block.field("e")
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float, copy=False)
    return block, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def tiles(n: int, width: int) -> Iterator[slice]:
    """n rows in parts of about TILE scores of `width` a row."""
    step = max(1, TILE // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def best_of(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score to nine places) of the k best of each row, best first, equal ones by column; NaN comes last."""
    low = -sims
    k = min(k, low.shape[1])
    last = np.partition(low, k - 1, axis=1)[:, k - 1 : k]
    # what rounding can bring level with the k-th is kept until it is rounded
    who, what = np.nonzero(~(low > last + 2e-9))
    value = np.round(-low[who, what], 9)
    order = np.lexsort((what, -value, who))
    who, what, value = who[order], what[order], value[order]
    first = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[first], what[first], value[first]


def nearest(k: int, least: float | None, names: list[str]):
    """Arrow batches of (questions, vectors) blocks to the k best vectors of the block for each question, by products of a
    tile of questions each; equal ones (to nine places) by the columns `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1), strict=True):
                (q_rows, q), (v_rows, x) = _matrix(asked), _matrix(held)
                order = pc.sort_indices(pa.RecordBatch.from_struct_array(v_rows).select(names), sort_keys=[(n, "ascending") for n in names]).to_numpy()
                x = x[order]
                for tile in tiles(len(q), len(x)):
                    who, place, value = best_of(q[tile] @ x.T, k)
                    if least is not None:
                        who, place, value = who[value >= least], place[value >= least], value[value >= least]
                    columns = [q_rows.field("query_id").take(pa.array(who + tile.start)), *[v_rows.field(n).take(pa.array(order[place])) for n in names], pa.array(value)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", *names, "vector_score"])

    return run


def usable_vectors(df: DataFrame, *columns: str, as_stored: bool = False) -> DataFrame:
    """df's columns, e (the embedding as doubles, or, if asked for as stored, as the floats that it is) and n (its length),
    without null, empty or partly null embeddings."""
    kind = "array<float>" if as_stored and dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return df.where(good).select(*columns, F.col("embedding").cast(kind).alias("e"), F.size("embedding").alias("n"))


def blocks_of(rows: DataFrame, at_once: int, by: list[str], name: str) -> DataFrame:
    """rows dealt, within each value of `by`, by a hash into blocks of about `at_once`: by, parts, block, one array per
    block with all other columns."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / at_once).cast("int").alias(f"{name}_parts"))
    others = [c for c in rows.columns if c not in by]
    dealt = rows.join(sizes, by).withColumn(f"{name}_block", F.pmod(F.xxhash64(*others), F.col(f"{name}_parts")).cast("int"))
    return dealt.groupBy(*by, f"{name}_parts", f"{name}_block").agg(F.collect_list(F.struct(*others)).alias(name))


def block_topk(asked: DataFrame, held: DataFrame, by: list[str], k: int, ties: tuple[str, ...], at_once: int, least: float | None = None) -> DataFrame:
    """The k nearest of held (by, chunk_id, ties, e) for each of asked (by, query_id, e) with the same values of `by`.

    Both sides become blocks of about `at_once` vectors on Spark; every question block meets every vector block of its
    `by` once, in a task of its own, which keeps k hits a question. Nothing reaches the driver.
    """
    names = [*dict.fromkeys([*ties, "chunk_id"])]
    q, v = blocks_of(asked, at_once, by, "asked"), blocks_of(held, at_once, by, "held")
    q = q.join(v.select(*by, "held_parts").distinct(), by).withColumn("held_block", F.explode(F.sequence(F.lit(0), F.col("held_parts") - 1)))
    met = q.repartition(*by, "asked_block", "held_block").join(v.drop("held_parts"), [*by, "held_block"]).select("asked", "held")
    types = dict(asked.dtypes) | dict(held.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in ["query_id", *names]) + ", vector_score double"
    return ranked(met.mapInArrow(nearest(k, least, names), ddl), "vector_score", k, ties)


def vector_topk(questions: DataFrame, vectors: DataFrame, k: int = 5, at_once: int = 4096, ties: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, vector_score, rank): exact cosine, to nine places, of every question's vector with every
    chunk's, the best k; equal ones by the columns `ties` of vectors, then by id. Null, empty or partly null vectors, or
    ones of another length than a question's, are no match for it; a zero vector has cosine 0."""
    # floats become doubles when a pair of blocks is scored: blocks of them take half the room until then
    asked, held = usable_vectors(questions, "query_id", as_stored=True), usable_vectors(vectors, "chunk_id", *ties, as_stored=True)
    return block_topk(asked, held, ["n"], k, ties, at_once).select("query_id", "chunk_id", "vector_score", "rank")


def shared_vector_topk(questions: DataFrame, vectors: DataFrame, members: DataFrame, k: int = 5, ties: tuple[str, ...] = ("chunk_index",), at_once: int = 4096) -> DataFrame:
    """As vector_topk, of chunks that have their document's vector: vectors (doc_id, embedding), members (chunk_id, doc_id,
    ties); equal ones by doc_id, ties, then chunk_id.

    A vector is searched once, however many chunks have it. One that no chunk has is left out, so each of the k best brings a
    chunk at least, and the k best chunks are among theirs; of one document's, among its first k.
    """
    own = vectors.join(members, "doc_id", "left_semi").withColumnRenamed("doc_id", "chunk_id")
    best = vector_topk(questions, own, k, at_once).select("query_id", F.col("chunk_id").alias("doc_id"), "vector_score")
    first = Window.partitionBy("doc_id").orderBy(*ties, "chunk_id")
    few = members.select("doc_id", *ties, "chunk_id").withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= k).drop("_at")
    return ranked(best.join(few, "doc_id"), "vector_score", k, ("doc_id", *ties)).select("query_id", "chunk_id", "vector_score", "rank")


def vector_threshold(hits: DataFrame, least: float = 0.5, floor: float = 0.3, k: int = 5) -> DataFrame:
    """hits (query_id, chunk_id, vector_score, rank): those at or over the model's threshold; a question without any keeps
    its k best over the floor as `vector_fallback`. The order of the hits stays."""
    any_passes = F.max(F.col("vector_score") >= least).over(Window.partitionBy("query_id"))
    got = hits.withColumn("passes", any_passes)
    got = got.where(F.when(F.col("passes"), F.col("vector_score") >= least).otherwise(F.col("vector_score") >= floor) & (F.col("rank") <= k))
    return got.withColumn("retrieval_source", F.when(F.col("passes"), "vector").otherwise("vector_fallback")).drop("passes")


def hybrid(questions: DataFrame, vector_hits: DataFrame, lexical_hits: DataFrame, k: int = 5) -> DataFrame:
    """Weighted reciprocal ranks of both sides, ties by vector then lexical score, then in the order of the sides; a
    question with one empty side keeps the other's order and raw scores. vector_hits: rank, vector_score and
    retrieval_source (vector or vector_fallback); lexical_hits: lexical_rank, lexical_score, score. A hit of both sides
    is `hybrid`, one of the lexical side `lexical`."""
    v = vector_hits.select("query_id", "chunk_id", "vector_score", F.col("rank").alias("v_rank"), F.col("retrieval_source").alias("v_source"))
    x = lexical_hits.select("query_id", "chunk_id", "lexical_score", "lexical_rank", F.col("score").alias("l_score"))
    both = v.join(x, ["query_id", "chunk_id"], "full_outer").join(questions.select("query_id", T.vector_weight(F.col("query")).alias("weight")), "query_id")
    per = Window.partitionBy("query_id")
    both = both.withColumn("n_v", F.count("v_rank").over(per)).withColumn("n_l", F.count("lexical_rank").over(per))
    fused = F.coalesce(F.col("weight") / (RRF_K + F.col("v_rank")), F.lit(0.0)) + F.coalesce((1 - F.col("weight")) / (RRF_K + F.col("lexical_rank")), F.lit(0.0))
    score = F.when(F.col("n_l") == 0, F.col("vector_score")).when(F.col("n_v") == 0, F.col("l_score")).otherwise(fused)
    source = F.when(F.col("v_rank").isNotNull() & F.col("lexical_rank").isNotNull(), F.lit("hybrid")).when(F.col("v_rank").isNotNull(), F.col("v_source")).otherwise("lexical")
    zero = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), zero("vector_score"), zero("lexical_score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("lexical_rank"))
    got = both.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return got.select("query_id", "chunk_id", "rank", "score", source.alias("retrieval_source"))


def _resorted(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_index", "added", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w))


def expand_groups(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, score) and, for each group that they touch, its heads and then members one place from a
    hit: three of these at most, of which those already retrieved use up a place. Added chunks score 0."""
    info = chunks.select("chunk_id", "chunk_index", "group_id")
    own = hits.select("query_id", "chunk_id", "score").join(info, "chunk_id")
    members = chunks.where("group_id is not null").select(F.col("chunk_id").alias("m_id"), F.col("chunk_index").alias("m_index"), "group_id", "is_group_head")
    touched = own.where("group_id is not null").select("query_id", "group_id", F.col("chunk_index").alias("hit_index")).join(members, "group_id")
    wanted = touched.where("is_group_head or abs(m_index - hit_index) <= 1").select("query_id", "group_id", "m_id", "m_index", "is_group_head").distinct()
    w = Window.partitionBy("query_id", "group_id").orderBy(F.desc("is_group_head"), "m_index", "m_id")
    picked = wanted.withColumn("n", F.row_number().over(w)).where(F.col("n") <= GROUP_CAP).select("query_id", F.col("m_id").alias("chunk_id"), F.col("m_index").alias("chunk_index"))
    new = picked.join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return _resorted(own.select("query_id", "chunk_id", "score", "chunk_index", F.lit(0).alias("added")).unionByName(new.withColumn("score", F.lit(0.0)).withColumn("added", F.lit(1)))).select("query_id", "chunk_id", "score", "chunk_index", "rank")


def expand_sections(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, score, chunk_index, rank), walked by rank: the parent, then siblings of the section one
    place away that are no section themselves; at most four additions for a question, each once."""
    info = chunks.select("chunk_id", "parent_chunk_id", "section_id")
    own = hits.join(info, "chunk_id")
    ids = chunks.select(F.col("chunk_id").alias("new_id"), F.col("chunk_index").alias("new_index"), F.col("section_id").alias("new_section"), F.col("chunk_type").alias("new_type"))
    parents = own.join(ids, F.col("parent_chunk_id") == F.col("new_id")).select("query_id", F.col("rank"), F.lit(0).alias("step"), "new_id", "new_index")
    siblings = own.where("section_id <> ''").join(ids, F.col("section_id") == F.col("new_section")).where("new_type <> 'SECTION' and abs(new_index - chunk_index) <= 1").select("query_id", "rank", F.lit(1).alias("step"), "new_id", "new_index")
    offered = parents.unionByName(siblings).join(own.select("query_id", F.col("chunk_id").alias("new_id")), ["query_id", "new_id"], "left_anti")
    once = offered.groupBy("query_id", "new_id", "new_index").agg(F.min(F.struct("rank", "step")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.rank", "at.step", "new_index", "new_id")
    new = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SECTION_CAP)
    new = new.select("query_id", F.col("new_id").alias("chunk_id"), F.lit(0.0).alias("score"), F.col("new_index").alias("chunk_index"), F.lit(1).alias("added"))
    return _resorted(hits.select("query_id", "chunk_id", "score", "chunk_index", F.lit(0).alias("added")).unionByName(new)).select("query_id", "chunk_id", "score", "chunk_index", "rank")


def merge_subqueries(hits: DataFrame, k: int = 5) -> DataFrame:
    """hits (query_id, sub_no, rank, chunk_id, score): the first occurrence of each chunk over the sub-questions, best scores first."""
    first = hits.groupBy("query_id", "chunk_id").agg(F.min_by("score", F.struct("sub_no", "rank")).alias("score"), F.min(F.struct("sub_no", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "at.sub_no", "at.rank", "chunk_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
