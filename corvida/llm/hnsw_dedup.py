"""Embedding near-duplicates: a navigable small-world graph per shard, every shard queried, every query audited."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import cut
from corvida.llm.components import connected_components

LINKS, BEAM, WIDE, WIDEST = 12, 32, 4, 256
SHARD = 8192


@dataclass
class Graph:
    """unit: (n, d) unit vectors. levels: from the top down, members (ascending places) and links (n, 2 * LINKS), -1 where none."""

    unit: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]


def beam_search(unit: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, up to `width` nearest places found from its entry places (n, k), best first; -1 where none.
    All queries step together; each step opens a query's WIDE best places that are not opened yet."""
    n_q = len(q)
    seen = np.zeros((n_q, len(unit)), dtype=bool)
    ids = np.full((n_q, width), -1, dtype=np.int64)
    sims = np.full((n_q, width), -np.inf, dtype=np.float32)
    opened = np.ones((n_q, width), dtype=bool)
    k = min(entry.shape[1], width)
    ids[:, :k] = entry[:, :k]
    rows = np.arange(n_q)
    for j in range(k):
        ok = (ids[:, j] >= 0) & ~seen[rows, ids[:, j]]
        seen[rows[ok], ids[ok, j]] = True
        sims[ok, j] = np.einsum("ij,ij->i", unit[ids[ok, j]], q[ok])
        opened[:, j] = ~ok
        ids[~ok, j] = -1
    live = rows
    while len(live):
        waiting = np.where(opened[live], -np.inf, sims[live])
        best = np.argpartition(-waiting, min(WIDE, width - 1), axis=1)[:, :WIDE] if width > WIDE else np.argsort(-waiting, axis=1)
        value = np.take_along_axis(waiting, best, axis=1)
        some = value.max(axis=1) > -np.inf
        live, best, value = live[some], best[some], value[some]
        if not len(live):
            break
        new_ids, new_ok = [], []
        for j in range(best.shape[1]):
            ok = value[:, j] > -np.inf
            opened[live[ok], best[ok, j]] = True
            near = np.where(ok[:, None], links[np.where(ok, ids[live, best[:, j]], 0)], -1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            at, col = np.nonzero(fresh)
            seen[live[at], near[at, col]] = True
            new_ids.append(near)
            new_ok.append(fresh)
        near, fresh = np.concatenate(new_ids, axis=1), np.concatenate(new_ok, axis=1)
        got = np.full(near.shape, -np.inf, dtype=np.float32)
        at, col = np.nonzero(fresh)
        got[at, col] = np.einsum("ij,ij->i", unit[near[at, col]], q[live[at]])
        all_sims = np.concatenate([sims[live], got], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, top, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), top, axis=1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], axis=1), top, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def spread(unit: np.ndarray, places: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's places (best first, -1 where none), up to `keep`: first those nearer to the row than to any chosen
    one, so that links lead in all directions, then the nearest others."""
    n, c = places.shape
    valid = places >= 0
    among = np.einsum("ncd,nkd->nck", unit[places], unit[places])
    chosen = np.zeros((n, c), dtype=bool)
    for j in range(c):
        rival = np.where(chosen, among[:, j], -np.inf).max(axis=1)
        chosen[:, j] = valid[:, j] & (sims[:, j] > rival) & (chosen.sum(axis=1) < keep)
    rank = np.where(chosen, 0, 1) * c + np.arange(c) + np.where(valid, 0, 4 * c)
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(np.where(valid, places, -1), order, axis=1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1) if out.shape[1] < keep else out


def _link_back(unit: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray, most: int) -> None:
    """Adds source to the links of target; an overfull place keeps a spread of its nearest."""
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(touched), int(count.max())), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(touched)), count)
    wide[row, np.arange(len(target)) - np.repeat(first, count)] = source
    have = (links[touched] >= 0).sum(axis=1)
    fits = have + count <= most
    # places with room take the new links as they are
    r, c = np.nonzero((wide >= 0) & fits[:, None])
    links[touched[r], have[r] + c] = wide[r, c]
    full = np.flatnonzero(~fits)
    if not len(full):
        return
    places = np.concatenate([links[touched[full]], wide[full]], axis=1)
    places = places[:, (places >= 0).any(axis=0)]
    sims = np.where(places >= 0, np.einsum("ncd,nd->nc", unit[places], unit[touched[full]]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, : most + LINKS]
    links[touched[full]] = spread(unit, np.take_along_axis(places, order, axis=1), np.take_along_axis(sims, order, axis=1), most)


def build(unit: np.ndarray, seed: int = 1, batch: int = 256) -> Graph:
    """Levels hold about every LINKS-th member of the one below. A level starts from the links of the one above and takes
    its further members in batches: each is searched for from the nearest place above, linked both ways, and held
    against its own batch."""
    n = len(unit)
    unit32 = unit.astype(np.float32)
    most = 2 * LINKS
    depth = np.floor(-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / np.log(LINKS)).astype(int)
    top = 0
    while top < depth.max() and (depth >= top).sum() > 2 * LINKS:
        top += 1
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(top, -1, -1):
        members = np.flatnonzero(depth >= level)
        links = levels[-1][1].copy() if levels else np.full((n, most), -1, dtype=np.int64)
        have = levels[-1][0] if levels else members[:1]
        rest = np.setdiff1d(members, have, assume_unique=True)
        grown = list(have)
        at = 0
        while at < len(rest):
            new = rest[at : at + max(1, min(batch, len(grown)))]
            at += len(new)
            entry = descend(Graph(unit32, levels), unit32[new]) if levels else np.full((len(new), 1), grown[0], dtype=np.int64)
            places, sims = beam_search(unit32, links, unit32[new], entry, BEAM)
            own = unit32[new] @ unit32[new].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1)[:, : min(LINKS, len(new) - 1)]
            places = np.concatenate([places, new[near]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, axis=1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
            picked = spread(unit32, np.take_along_axis(places, order, axis=1), np.take_along_axis(sims, order, axis=1), LINKS)
            links[new, :LINKS] = picked
            source, col = np.nonzero(picked >= 0)
            _link_back(unit32, links, new[source], picked[source, col], most)
            grown += list(new)
        levels.append((members, links))
    return Graph(unit32, levels)


def descend(graph: Graph, q: np.ndarray) -> np.ndarray:
    """The nearest places found on the lowest of graph.levels, by way of those above."""
    entry = np.full((len(q), 1), graph.levels[0][0][0], dtype=np.int64)
    for _, links in graph.levels:
        entry = beam_search(graph.unit, links, q, entry, 8)[0][:, :4]
    return entry


def _wider(graph: Graph, part: np.ndarray, entry: np.ndarray, width: int, near: float) -> np.ndarray:
    """(len(part), len(graph.unit)) whether a beam of this width found the place at `near` or more."""
    ids, sims = beam_search(graph.unit, graph.levels[-1][1], part, entry, width)
    found = np.zeros((len(part), len(graph.unit)), dtype=bool)
    r, c = np.nonzero((sims >= near) & (ids >= 0))
    found[r, ids[r, c]] = True
    return found


def linked(graph: Graph, unit: np.ndarray, q: np.ndarray, least: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, place) with a double-precision cosine of at least `least`, a block of queries at a time.

    Every query is audited: a block is held against a scan of the shard, one matrix product. The beams of queries that
    lack one of their links are doubled in width until their own audit passes or WIDEST is reached; a query with more
    links than that, or still without one of them, takes those of the scan. No query is left out of the audit and none
    is judged by what others found, so a lone pair beside a large group of near copies can't be lost.
    """
    near = least - 1e-4
    for at in range(0, len(q), block):
        part = q[at : at + block].astype(np.float32)
        entry = descend(Graph(graph.unit, graph.levels[:-1]), part) if len(graph.levels) > 1 else np.full((len(part), 1), graph.levels[0][0][0], dtype=np.int64)
        true = part @ graph.unit.T >= near
        found = _wider(graph, part, entry, BEAM, near)
        size, width = true.sum(axis=1), 2 * BEAM
        while width <= WIDEST:
            again = np.flatnonzero((true & ~found).any(axis=1) & (size <= width))
            if len(again):
                found[again] = _wider(graph, part[again], entry[again], width, near)
            width *= 2
        missed = (true & ~found).any(axis=1)
        r, c = np.nonzero(np.where(missed[:, None], true, found))
        step = 1 << 16
        ok = [np.einsum("ij,ij->i", q[at + r[i : i + step]], unit[c[i : i + step]]) >= least for i in range(0, len(r), step)]
        ok = np.concatenate(ok) if ok else np.empty(0, dtype=bool)
        yield at + r[ok], c[ok]


def _build_shard(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("rep")
    raw = np.stack(part["embedding"].to_list()).astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # before squares, which may be beyond a double
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    graph = build(unit)
    kept = pickle.dumps([(m.astype(np.int32), x.astype(np.int32)) for m, x in graph.levels])
    return pd.DataFrame({"group": [part["group"].iloc[0]], "shard": [part["shard"].iloc[0]], "dim": [raw.shape[1]], "reps": [part["rep"].to_numpy(np.int64).tobytes()], "copies": [part["copies"].to_numpy(np.int64).tobytes()], "unit": [unit.tobytes()], "graph": [kept]})


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the smallest place that each place reaches, with the further links (a, b)."""
    n = len(root)
    pairs = np.unique(root[a] * n + root[b])
    a, b = pairs // n, pairs % n
    top = np.arange(n)
    while True:
        before = top.copy()
        low = np.minimum(top[a], top[b])
        np.minimum.at(top, a, low)
        np.minimum.at(top, b, low)
        top = top[top]
        if (top == before).all():
            return top[root]


def _query_pairs(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                whole = lambda k: (np.frombuffer(getattr(row, f"reps_{k}"), dtype=np.int64), np.frombuffer(getattr(row, f"copies_{k}"), dtype=np.int64), np.frombuffer(getattr(row, f"unit_{k}")).reshape(-1, row.dim))
                (reps_a, copies_a, unit_a), (reps_b, copies_b, unit_b) = whole("a"), whole("b")
                graph = Graph(unit_b.astype(np.float32), [(m.astype(np.int64), x.astype(np.int64)) for m, x in pickle.loads(row.graph)])
                same = row.shard_a == row.shard_b
                reps = reps_b if same else np.concatenate([reps_a, reps_b])
                order = np.argsort(reps, kind="stable")  # the smallest place is then the smallest class
                place = np.empty(len(reps), dtype=np.int64)
                place[order] = np.arange(len(reps))
                count, root = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
                for q, x in linked(graph, unit_b, unit_a, least):
                    if same:  # each link is found from both ends
                        q, x = q[q != x], x[q != x]
                    count[: len(reps_a)] += np.bincount(q, weights=copies_b[x], minlength=len(reps_a)).astype(np.int64)
                    if not same:
                        count[len(reps_a) :] += np.bincount(x, weights=copies_a[q], minlength=len(reps_b)).astype(np.int64)
                        x = len(reps_a) + x
                    root = _merged(root, place[q], place[x])
                some = np.flatnonzero(count > 0)
                if len(some):
                    yield pd.DataFrame({"rep": reps[some], "links": count[some], "root": reps[order][root[place[some]]]})

    return run


def usable(embedding: Column) -> Column:
    """Neither null nor empty, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & F.coalesce(~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, shard: int = SHARD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Rows with the same label and the same vector are one class and linked; classes of a label (and vector length) are
    dealt by a hash into shards of about `shard`, each with its graph. Every pair of a label's shards, each with
    itself too, is searched: the vectors of one through the graph of the other, which finds the pair's links from either
    end. A larger shard means fewer pairs; SHARD vectors and their graph take some tens of MB. What a pair of shards
    yields is counted there, block by block, and reduced to links to the smallest id, so links within a group of near
    copies are never listed. Rows with a null label, a vector that is not usable() or a null id
    link with nothing: no links, own component. Rows with the same id each keep their row. Ids are integers. Other
    columns are left out; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    group = F.concat_ws(":", F.size("embedding").cast("string"), "label").alias("group")
    rows = cut(rows.select("vec_id", F.when(fit, F.col("embedding")).alias("embedding"), F.when(fit, group).alias("group")), "vectors")
    classes = cut(rows.where("group is not null").groupBy("group", "embedding").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "classes")  # ids may repeat, rep doesn't
    sizes = cut(classes.groupBy("group").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards")), "sizes")
    placed = classes.join(sizes, "group").withColumn("shard", F.pmod(F.xxhash64("rep", F.lit("shard")), F.col("shards")))
    graphs = cut(placed.select("group", "shard", "rep", "copies", "embedding").groupBy("group", "shard").applyInPandas(_build_shard, "group string, shard long, dim long, reps binary, copies binary, unit binary, graph binary"), "graphs")
    numbers = sizes.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard_a"), "shards")
    numbers = numbers.select("group", "shard_a", F.explode(F.sequence(F.col("shard_a"), F.col("shards") - 1)).alias("shard_b"))
    # one side brings its vectors, the other one its graph too
    side = lambda k: graphs.select("group", F.col("shard").alias(f"shard_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("reps", "copies", "unit")], *[c for c in ("dim", "graph") if k == "b"])
    pairs = numbers.repartition("group", "shard_a", "shard_b").join(side("a"), ["group", "shard_a"]).join(side("b"), ["group", "shard_b"])
    found = cut(pairs.mapInPandas(_query_pairs(least), "rep long, links long, root long"), "found")
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = cut(classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = cut(rooted.join(lowest, "root").select("group", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    got = rows.join(known, ["group", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
