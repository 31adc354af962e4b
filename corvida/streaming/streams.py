"""Streams: live counts, idempotent ingestion, and the split of visible and reasoning text over fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.operators import stored
from corvida.operators.chat import MARKS
from corvida.sources.folders import written


def once(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The rows of a stream without those that repeat a key within `late` of each other, by the timestamp column `time`; the
    keys that are remembered are those of that span."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def collection_counts(documents: DataFrame) -> DataFrame:
    """Live documents and chunks per collection of a document stream (collection_id, chunk_count)."""
    return documents.groupBy("collection_id").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


def session_activity(messages: DataFrame) -> DataFrame:
    """Live message count and last activity per session."""
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("created_at").alias("updated_at"))


def keep_latest(counts: DataFrame, path: str, keys: list[str], checkpoint: str):
    """What a stream of grouped results gave last for each group, as a table partitioned by a bucket of its keys. In update
    mode a batch brings only the groups that it changed, and only their buckets are written."""
    table = results(counts.sparkSession, path, ", ".join(f"`{c}` {t}" for c, t in counts.dtypes))

    def write(batch: DataFrame, _: int) -> None:
        stored.upsert(table, batch.withColumn("bucket", stored.bucket(*keys)), keys)

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, path: str, schema: str) -> stored.Stored:
    return stored.Stored(spark, path, f"{schema}, bucket int", "bucket")


#: What the processor of documents gives: for each event that counted one row without text, and a row per chunk.
CHANGES = "doc_id long, seq long, status string, chunk_index long, content string"
#: What is kept of the documents of a page, by place: those whose ids are equal without their last PAGE_BITS bits. A call of
#: Python takes a page, as most of a call's time goes by calls, not by documents; no page has more of them than that.
PAGE_BITS = 6
PAGE_STATE = "doc_id array<long>, status array<string>, seq array<long>, chunks array<long>, until array<long>"
ENDED = ("READY", "FAILED", "CANCELLED")


def advance(state: tuple[str, int, int] | None, events: list[tuple[int, str, str | None]], chunk: Callable[[str | None], list[str]]) -> tuple[tuple[str, int, int] | None, list[tuple]]:
    """A document's state (status, last seq, chunks so far) and events (seq, kind, text) to its next state and CHANGES
    without the id.

    A PART's chunks follow those before, and the document is PROCESSING; LAST is its last part, after which it is READY,
    or FAILED if there is no chunk in all. A part that `chunk` raises on makes it FAILED, CANCEL makes it CANCELLED. Of a
    failed or cancelled document nothing is left. An event with a seq that isn't above the last one is a repeat; parts of
    a document that has ended are passed over, but a CANCEL still counts once READY.
    """
    out = []
    for seq, kind, text in sorted(events, key=lambda e: e[0]):
        status, last, n = state or (None, -1, 0)
        if seq <= last or (status in ENDED and not (kind == "CANCEL" and status == "READY")):
            continue
        made: list[str] = []
        if kind == "CANCEL":
            status = "CANCELLED"
        else:
            try:
                made = chunk(text)
                status = "PROCESSING" if kind == "PART" else "READY" if n + len(made) else "FAILED"
            except Exception:  # noqa: BLE001  one document's error, of any kind, ends that document alone
                status, made = "FAILED", []
        if status in ("FAILED", "CANCELLED"):
            out, n = [], 0
        out.append((seq, status, None, None))
        out += [(seq, status, n + i, c) for i, c in enumerate(made)]
        state = (status, seq, n + len(made))
    return state, out


def advance_page(states: dict[int, tuple], events: list[tuple], chunk: Callable[[str | None], list[str]], now: int, wait: int) -> tuple[dict[int, tuple], list[tuple]]:
    """The states (status, last seq, chunks so far, until) of a page by document and events (doc_id, seq, kind, text, ms) to
    the next states and CHANGES, at the watermark `now`.

    A document with events goes on by `advance` and is kept until `wait` past the latest of them and of `now`. One without
    whose time is over is forgotten, and is FAILED if it was PROCESSING."""
    of: dict[int, list[tuple]] = {}
    for e in events:
        of.setdefault(e[0], []).append(e)
    states, out = dict(states), []
    for doc_id, own in of.items():
        old = states.get(doc_id)
        new, made = advance(old and old[:3], [e[1:4] for e in own], chunk)
        if new is not None:
            states[doc_id] = (*new, max(now, *(e[4] for e in own)) + wait)
        out += [(doc_id, *c) for c in made]
    for doc_id in [d for d, s in states.items() if s[3] < now and d not in of]:
        status, seq, _, _ = states.pop(doc_id)
        if status == "PROCESSING":
            out.append((doc_id, seq, "FAILED", None, None))
    return states, out


def changes_frame(doc_id: int | list[int], changes: list[tuple]):
    """CHANGES of one document, or each with a document of its own, at least one, made of typed columns."""
    import numpy as np
    import pandas as pd

    seq, status, at, content = zip(*changes, strict=True)
    numbers = pd.arrays.IntegerArray(np.array([i or 0 for i in at], dtype=np.int64), np.array([i is None for i in at]))
    return pd.DataFrame({"doc_id": np.full(len(seq), doc_id), "seq": np.array(seq), "status": list(status), "chunk_index": numbers, "content": list(content)})


def document_changes(events: DataFrame, chunk: Callable[[str | None], list[str]], patience: str = "1 day") -> DataFrame:
    """events (doc_id, seq, kind PART, LAST or CANCEL, text, at) of a stream to CHANGES, by a processor of each document's
    own, a page of documents at a time. `chunk` makes the chunks of a part's text; `at` is the timestamp of an event.

    The watermark stays `patience` behind the latest event; what comes later than that is passed over. A document that is
    PROCESSING when the watermark is `patience` past its last event is FAILED, and one that has ended is forgotten by then,
    so state is bounded by what came in that time. Timers go by events, not by the clock, so a batch that is run again
    gives the same."""
    number, unit = patience.split()
    wait = int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")]

    def run(key, batches, state):
        rows = []
        for b in () if state.hasTimedOut else batches:
            ids = [None if i != i else i for i in b["doc_id"].tolist()]  # null ids are a page
            seq = [i if i is None or i != i else int(i) for i in b["seq"].tolist()]  # a null makes floats of its neighbours
            rows += zip(ids, seq, b["kind"].tolist(), [t if isinstance(t, str) else None for t in b["text"].tolist()], map(int, b["ms"].tolist()), strict=True)
        old = {d: tuple(s) for d, *s in zip(*state.get, strict=True)} if state.exists else {}
        new, out = advance_page(old, rows, chunk, state.getCurrentWatermarkMs(), wait)
        if new:
            state.update(tuple(map(list, zip(*((d, *s) for d, s in new.items()), strict=True))))
            state.setTimeoutTimestamp(min(s[3] for s in new.values()))
        elif state.exists:
            state.remove()
        if out:
            yield changes_frame([c[0] for c in out], [c[1:] for c in out])

    timed = events.withWatermark("at", patience).select(F.shiftright("doc_id", PAGE_BITS).alias("page"), "doc_id", "seq", "kind", "text", "at", F.unix_millis("at").alias("ms"))
    return timed.groupBy("page").applyInPandasWithState(run, CHANGES, PAGE_STATE, "update", "EventTimeTimeout")


def ingest_tables(spark: SparkSession, path: str) -> tuple[stored.Stored, stored.Stored]:
    """(chunks, status) under path."""
    chunks = stored.Stored(spark, f"{path}/chunks", "doc_id long, seq long, chunk_index long, content string, bucket int", "bucket")
    return chunks, stored.Stored(spark, f"{path}/status", "doc_id long, seq long, status string, chunks long, bucket int", "bucket")


def apply_changes(changes: DataFrame, path: str) -> None:
    """Brings the tables up to a batch of CHANGES. Of each document in it, rows of the batch's own events are replaced, those
    of a failed or cancelled one go, of a cancelled one its state too; only its buckets are written. The same batch again
    changes nothing."""
    spark = changes.sparkSession
    chunks, status = ingest_tables(spark, path)
    new = written(changes.withColumn("bucket", stored.bucket("doc_id")), "changes")
    last = new.where("chunk_index is null").groupBy("doc_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("upto"), F.min("seq").alias("from"))
    partitions = stored.touched(chunks, new)
    if not partitions:
        return
    old = chunks.read().where(chunks.within(partitions))
    stay = old.join(last.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").where("status is null or (status not in ('FAILED', 'CANCELLED') and seq < from)").select(*old.columns)
    stored.rewrite(chunks, partitions, stay.unionByName(new.where("chunk_index is not null").select(*old.columns)))
    n = chunks.read().where(chunks.within(partitions)).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    now = last.where("status <> 'CANCELLED'").join(n, "doc_id", "left").select("doc_id", F.col("upto").alias("seq"), "status", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), stored.bucket("doc_id").alias("bucket"))
    known = status.read().where(status.within(partitions))
    stored.rewrite(status, partitions, known.join(last, stored.same_keys(known, last, ["doc_id"]), "left_anti").unionByName(now))


def ingest(events: DataFrame, chunk: Callable[[str | None], list[str]], path: str, checkpoint: str, patience: str = "1 day"):
    """Chunks of a stream of document events under path/chunks and the documents' states under path/status, see
    document_changes. A batch that broke off is repeated from the same states, hence with the same changes."""
    changes = document_changes(events, chunk, patience)
    return changes.writeStream.outputMode("update").foreachBatch(lambda batch, _: apply_changes(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of split fragments, and of the state kept between them: the text held back and the mark that is open.
PARTS = "message_id string, part_no long, is_reasoning boolean, text string"
STATE = "held string, open int, parts long"


def _held_back(text: str, marks: list[str]) -> int:
    """Length of the longest end of the text that begins one of the marks."""
    return max((n for m in marks for n in range(1, min(len(m), len(text) + 1)) if text.endswith(m[:n])), default=0)


def split_fragment(held: str, mark: int, text: str, last: bool) -> tuple[list[tuple[bool, str]], str, int]:
    """Tagged parts of what is held and the new text, what stays held, and the number of the open mark (-1: none). An end
    that may begin a mark waits for more; the last fragment gives all."""
    held, out = held + text, []
    while True:
        marks = [MARKS[mark][1]] if mark >= 0 else [start for start, _ in MARKS]
        at, which = min(((held.find(m), i) for i, m in enumerate(marks) if m in held), default=(-1, -1))
        if at < 0:
            keep = 0 if last else _held_back(held, marks)
            out.append((mark >= 0, held[: len(held) - keep]))
            return [p for p in out if p[1]], held[len(held) - keep :], mark
        out.append((mark >= 0, held[:at]))
        held, mark = held[at + len(marks[which]) :], which if mark < 0 else -1


def thinking_split(fragments: DataFrame) -> DataFrame:
    """fragments (message_id, seq, text, is_last) of a stream to PARTS: visible and reasoning text of each message in order,
    whatever way marks fall over fragments. A message's state is the end it holds back and goes with its last fragment.
    Fragments of a message have to come in order from batch to batch; within a batch they are sorted. Null texts are
    empty."""

    def parts(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("seq")
        held, mark, n = state.get if state.exists else ("", -1, 0)
        out, ended = [], False
        for text, last in zip(rows["text"], rows["is_last"], strict=True):
            found, held, mark = split_fragment(held, mark, text if isinstance(text, str) else "", bool(last))
            out += found
            ended = ended or bool(last)
        if ended:
            state.remove()
        else:
            state.update((held, mark, n + len(out)))
        yield pd.DataFrame({"message_id": [key[0]] * len(out), "part_no": range(n, n + len(out)), "is_reasoning": [r for r, _ in out], "text": [t for _, t in out]})

    return fragments.groupBy("message_id").applyInPandasWithState(parts, PARTS, STATE, "append", "NoTimeout")


def eval_progress(traces: DataFrame, score, path: str, checkpoint: str):
    """Traces of a stream to a running summary: every micro-batch upserts score(batch), rows (query_id, recall, mrr), so that
    a repeated batch replaces itself and the table holds each sample once, however many batches there were."""
    table = eval_scores(traces.sparkSession, path)

    def write(batch: DataFrame, _: int) -> None:
        latest = score(batch).groupBy("query_id").agg(F.max(F.struct("recall", "mrr")).alias("r")).select("query_id", "r.recall", "r.mrr")
        stored.upsert(table, latest.withColumn("bucket", stored.bucket("query_id")), ["query_id"])

    return traces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def eval_scores(spark: SparkSession, path: str) -> stored.Stored:
    return results(spark, path, "query_id long, recall double, mrr double")


def eval_summary(spark: SparkSession, path: str) -> DataFrame:
    """Samples, mean recall and mean reciprocal rank so far; a sample scored again counts with its latest batch."""
    return eval_scores(spark, path).read().agg(F.count("*").alias("samples"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("mrr"))
