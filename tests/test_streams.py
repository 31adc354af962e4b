"""Streams run batch by batch: documents that are cancelled, fail or repeat, and live tables that change by key."""

import os

from pyspark.sql import functions as F

from corvida.plans.stream_plans import blocks_of_lines, ingested
from corvida.streaming import streams

lines = lambda text: text.split("|")


def run(events, state=None):
    return streams.advance(state, events, lines)


def test_states_of_a_document():
    state, out = run([(1, "PART", "a|b")])
    assert state == ("PROCESSING", 1, 2) and out == [(1, "PROCESSING", None, None), (1, "PROCESSING", 0, "a"), (1, "PROCESSING", 1, "b")]
    assert run([(2, "LAST", "c")], state) == (("READY", 2, 3), [(2, "READY", None, None), (2, "READY", 2, "c")])
    assert run([(2, "CANCEL", None), (3, "LAST", "c")], state) == (("CANCELLED", 2, 0), [(2, "CANCELLED", None, None)])
    assert run([(2, "LAST", None)], state) == (("FAILED", 2, 0), [(2, "FAILED", None, None)])
    assert run([(1, "PART", "again")], state) == (state, [])
    assert run([(3, "CANCEL", None)], ("READY", 2, 3))[0] == ("CANCELLED", 3, 0)
    assert run([(3, "LAST", "x")], ("READY", 2, 3)) == (("READY", 2, 3), [])
    assert run([(3, "CANCEL", None)], ("FAILED", 2, 0)) == (("FAILED", 2, 0), [])
    assert streams.advance(None, [(1, "LAST", "")], lambda t: []) == (("FAILED", 1, 0), [(1, "FAILED", None, None)])
    assert run([(2, "CANCEL", None), (1, "PART", "a")])[1] == [(2, "CANCELLED", None, None)]  # in order of seq, whatever way they come
    assert run([]) == (None, [])


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_ingestion_over_batches(spark, tmp_path):
    path, schema = str(tmp_path), "doc_id long, seq long, kind string, text string, at timestamp"

    def arrive(*events, at="2024-01-01 00:00:00"):
        spark.createDataFrame([(*e, at) for e in events], schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{path}/events")
        streams.ingest(spark.readStream.schema(schema).parquet(f"{path}/events"), lines, path, f"{path}/state").awaitTermination(120)
        chunks, status = streams.ingest_tables(spark, path)
        return sorted((r.doc_id, r.chunk_index, r.content) for r in chunks.read().collect()), sorted((r.doc_id, r.status, r.chunks) for r in status.read().collect())

    first = arrive((1, 1, "PART", "a|b"), (2, 1, "PART", "c"), (3, 1, "PART", "d"), (4, 1, "LAST", "e"), (5, 1, "LAST", None))
    assert first == ([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (4, 0, "e")], [(1, "PROCESSING", 2), (2, "PROCESSING", 1), (3, "PROCESSING", 1), (4, "READY", 1), (5, "FAILED", 0)])
    second = arrive((1, 2, "LAST", "f"), (2, 2, "CANCEL", None), (3, 2, "LAST", None), (1, 1, "PART", "a|b"), (9, 1, "CANCEL", None))
    assert second == ([(1, 0, "a"), (1, 1, "b"), (1, 2, "f"), (4, 0, "e")], [(1, "READY", 3), (3, "FAILED", 0), (4, "READY", 1), (5, "FAILED", 0)])
    assert arrive((2, 3, "LAST", "late"), (4, 2, "CANCEL", None), (1, 2, "LAST", "f")) == (second[0][:3], [second[1][0], second[1][1], second[1][3]])
    # no event of document 6 for two days by the events' own time: it is given up, and what it left goes
    assert (6, "PROCESSING", 1) in arrive((6, 1, "PART", "g"), at="2024-01-01 01:00:00")[1]
    arrive((7, 1, "LAST", "h"), at="2024-01-05 00:00:00")
    given_up = arrive((8, 1, "LAST", "i"), at="2024-01-05 00:00:01")
    assert (6, "FAILED", 0) in given_up[1] and (7, 0, "h") in given_up[0] and 6 not in {r[0] for r in given_up[0]}
    # a batch that is run again changes nothing, not even when others came after its first run
    changes = spark.createDataFrame([(1, 2, "READY", None, None), (1, 2, "READY", 2, "f")], streams.CHANGES)
    streams.apply_changes(changes, path)
    chunks, status = streams.ingest_tables(spark, path)
    assert sorted((r.chunk_index, r.content) for r in chunks.read().where("doc_id = 1").collect()) == [(0, "a"), (1, "b"), (2, "f")]
    assert [tuple(r) for r in status.read().where("doc_id = 1").select("status", "chunks").collect()] == [("READY", 3)]


def test_live_counts_write_changed_keys_alone(spark, tmp_path):
    path, schema = str(tmp_path), "doc_id long, collection_id string, chunk_count long, at timestamp"

    def arrive(*rows):
        spark.createDataFrame(rows, "doc_id long, collection_id string, chunk_count long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = streams.collection_counts(streams.once(spark.readStream.schema(schema).parquet(f"{path}/in"), ["doc_id"], "at"))
        streams.keep_latest(got, f"{path}/out", ["collection_id"], f"{path}/state").awaitTermination(120)
        return sorted((r.collection_id, r.documents, r.chunks) for r in streams.results(spark, f"{path}/out", "collection_id string, documents long, chunks long").read().collect())

    assert arrive((1, "a", 2, "2024-01-01 00:00:00"), (2, "b", 3, "2024-01-01 00:00:01"), (1, "a", 2, "2024-01-01 00:00:02")) == [("a", 1, 2), ("b", 1, 3)]
    before = files(f"{path}/out")
    assert arrive((2, "b", 3, "2024-01-01 00:01:00"), (3, "b", 4, "2024-01-01 00:01:01")) == [("a", 1, 2), ("b", 2, 7)]
    kept = before & files(f"{path}/out")
    assert kept and len(before - kept) == 1  # the bucket of b


def test_a_running_evaluation_keeps_each_sample_once(spark, tmp_path):
    path, schema = str(tmp_path), "query_id long, recall double, mrr double"
    for batch in ([(1, 0.0, 0.0), (2, 1.0, 0.5)], [(1, 1.0, 1.0)], [(2, 1.0, 0.5), (3, 0.0, 0.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(f"{path}/in")
        streams.eval_progress(spark.readStream.schema(schema).json(f"{path}/in"), lambda b: b, f"{path}/out", f"{path}/ck").awaitTermination(120)
    assert streams.eval_scores(spark, f"{path}/out").read().count() == 3
    assert tuple(round(x, 6) for x in streams.eval_summary(spark, f"{path}/out").first()) == (3, 0.666667, 0.5)


def test_blocks_of_lines():
    assert blocks_of_lines("a\nb\nc\nd\ne") == ["a\nb\nc\nd", "e"]


def test_changes_of_a_document_in_typed_columns():
    import pandas as pd

    from corvida.streaming import streams

    changes = [(3, "READY", None, None), (3, "READY", 0, "a"), (3, "READY", 1, "")]
    want = pd.DataFrame([(7, *c) for c in changes], columns=["doc_id", "seq", "status", "chunk_index", "content"]).astype({"chunk_index": "Int64"})
    pd.testing.assert_frame_equal(streams.changes_frame(7, changes), want)
    pd.testing.assert_frame_equal(streams.changes_frame(7, changes[:1]), want[:1])


def test_states_of_a_page():
    page, out = streams.advance_page({}, [(1, 1, "PART", "a|b", 5), (2, 1, "LAST", "c", 7), (None, 1, "PART", "n", 9), (1, 2, "LAST", "d", 8)], lines, 0, 10)
    assert page == {1: ("READY", 2, 3, 18), 2: ("READY", 1, 1, 17), None: ("PROCESSING", 1, 1, 19)}
    assert [c for c in out if c[0] == 1] == [(1, 1, "PROCESSING", None, None), (1, 1, "PROCESSING", 0, "a"), (1, 1, "PROCESSING", 1, "b"), (1, 2, "READY", None, None), (1, 2, "READY", 2, "d")]
    assert [c for c in out if c[0] is None] == [(None, 1, "PROCESSING", None, None), (None, 1, "PROCESSING", 0, "n")]
    # each document's time is its own: one is over when the watermark is past it, and not for a document with events, repeats too
    held = {1: ("PROCESSING", 4, 1, 10), 2: ("READY", 1, 1, 10), 3: ("PROCESSING", 1, 1, 11), 4: ("PROCESSING", 1, 1, 10)}
    assert streams.advance_page(held, [], lines, 10, 10) == (held, [])
    page, out = streams.advance_page(held, [(4, 1, "PART", "again", 3)], lines, 11, 10)
    assert page == {3: held[3], 4: ("PROCESSING", 1, 1, 21)} and out == [(1, 4, "FAILED", None, None)]
    # an event of no effect begins no state, and what is given stays as it was
    assert streams.advance_page({}, [(5, -1, "PART", "x", 1)], lines, 0, 10) == ({}, []) and len(held) == 4


def test_documents_are_worked_on_by_pages(spark, tmp_path):
    """A call of Python and a row of state for a page, not for a document; documents of a page end alone, by events and by time."""
    path, schema, n = str(tmp_path), "doc_id long, seq long, kind string, text string, at timestamp", 1 << streams.PAGE_BITS

    def arrive(*events, at="2024-01-01 00:00:00"):
        spark.createDataFrame([(*e, at) for e in events], schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(f"{path}/events")
        run = streams.ingest(spark.readStream.schema(schema).parquet(f"{path}/events"), lines, path, f"{path}/state")
        run.awaitTermination(120)
        chunks, status = streams.ingest_tables(spark, path)
        held = [r.content for r in chunks.read().orderBy("doc_id", "chunk_index").collect()]
        return run.lastProgress["stateOperators"][0]["numRowsTotal"], held, {r.doc_id: (r.status, r.chunks) for r in status.read().collect()}

    rows, held, status = arrive(*[(i, 1, "PART", f"{i}|x") for i in range(-1, 2 * n)])
    assert rows == 3 and len(held) == 2 * (2 * n + 1) and set(status.values()) == {("PROCESSING", 2)}
    rows, held, status = arrive((-1, 2, "LAST", "y"), (0, 2, "CANCEL", None), (1, 2, "LAST", None), (2, 2, "LAST", "y"), (n, 2, "LAST", "y"), at="2024-01-01 12:00:00")
    assert rows == 3 and 0 not in status and status[1] == ("FAILED", 0) and status[2] == status[n] == status[-1] == ("READY", 3) and status[3] == ("PROCESSING", 2)
    # two days on, by an event of another page, those that waited since midnight are given up, in pages without events too
    arrive((10 * n, 1, "LAST", "z"), at="2024-01-03 06:00:00")
    rows, held, status = arrive((10 * n, 2, "CANCEL", None), (10 * n + 1, 1, "LAST", "z"), at="2024-01-03 06:00:01")
    assert held == ["-1", "x", "y", "2", "x", "y", str(n), "x", "y", "z"]
    assert {i for i, s in status.items() if s[0] == "FAILED"} == {1, *range(3, 2 * n)} - {n} and 10 * n not in status and status[10 * n + 1] == ("READY", 1)
    # what ended at noon is still known, so that a repeat of it counts for nothing
    assert rows == 4 and arrive((2, 2, "LAST", "y"), at="2024-01-03 06:00:02")[1] == held


def test_registered_ingestion_keeps_a_row_of_state_for_a_page(spark):
    """Of the stream that stream_ingest and stream_ingest_status read."""
    sf = "/root/testdata/sf0.001"
    path = ingested(spark, sf)
    pages = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(F.shiftright("doc_id", streams.PAGE_BITS)).distinct().count()
    held = spark.read.format("statestore").load(f"{path}/state")
    assert held.count() == pages and held.select(F.explode("value.groupState.doc_id")).count() == spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").count()


def test_an_event_without_seq_leaves_the_others_of_its_page(spark, tmp_path):
    path, schema = str(tmp_path), "doc_id long, seq long, kind string, text string, at timestamp"
    for events in ([(1, None, "PART", "a"), (2, 1, "PART", "b|c")], [(2, 2, "LAST", "d"), (2, 1, "PART", "b|c")]):
        spark.createDataFrame([(*e, "2024-01-01 00:00:00") for e in events], schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{path}/events")
        streams.ingest(spark.readStream.schema(schema).parquet(f"{path}/events"), lines, path, f"{path}/state").awaitTermination(120)
    chunks, status = streams.ingest_tables(spark, path)
    assert sorted((r.seq, r.chunk_index, r.content) for r in chunks.read().where("doc_id = 2").collect()) == [(1, 0, "b"), (1, 1, "c"), (2, 2, "d")]
    assert [tuple(r) for r in status.read().where("doc_id = 2").select("seq", "status", "chunks").collect()] == [(2, "READY", 3)]
