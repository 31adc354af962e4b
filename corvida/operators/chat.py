"""Conversation tables: roll-ups, titles, history, step and marker codecs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import text as T

#: The two pairs of marks around reasoning text.
MARKS = (("<think>", "</think>"), ("<|channel>thought", "<channel|>"))


def session_rollup(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("created_at").alias("updated_at"))


#: Fixed value: the title of a session that has none yet.
UNTITLED = "New Chat"


def session_titles(messages: DataFrame, sessions: DataFrame, most: int = 45) -> DataFrame:
    """(id, title): an untitled session (title UNTITLED, message_count 0) takes the first `most` characters of its first
    user message, with … if those are `most`; the others keep their title. sessions: (id, title, message_count)."""
    first = messages.where("role = 'user'").groupBy(F.col("session_id").alias("id")).agg(F.substring(F.min_by("content", "turn"), 1, most).alias("text"))
    made = F.when(F.length("text") == most, F.concat("text", F.lit("…"))).otherwise(F.col("text"))
    untitled = (F.col("title") == UNTITLED) & (F.col("message_count") == 0)
    return sessions.join(first, "id", "left").select("id", F.when(untitled, F.coalesce(made, "title")).otherwise(F.col("title")).alias("title"))


def session_recency(sessions: DataFrame, now: Column) -> DataFrame:
    """Unpinned sessions as Today, Yesterday or Earlier at `now`; a date after it is Earlier."""
    days = F.datediff(now.cast("date"), F.col("updated_at").cast("date"))
    return sessions.where("not is_pinned").select("id", F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise("Earlier").alias("recency"))


def purge_empty(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.join(messages.select(F.col("session_id").alias("id")), "id", "left_semi")


def truncate_from(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Messages before each session's cut turn; sessions without a cut stay whole. cuts: (session_id, cut)."""
    got = messages.join(cuts, "session_id", "left")
    return got.where(F.col("cut").isNull() | (F.col("turn") < F.col("cut"))).drop("cut")


def regenerate_cuts(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """For each answer (session_id, turn) that is an assistant's message right after a user's: that user turn."""
    w = Window.partitionBy("session_id").orderBy("turn")
    pairs = messages.select("session_id", "turn", "role", F.lag("role").over(w).alias("asked"), F.lag("turn").over(w).alias("cut"))
    return pairs.where("role = 'assistant' and asked = 'user'").join(answers.select("session_id", "turn"), ["session_id", "turn"], "left_semi").select("session_id", "cut")


def encode_steps(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat_ws("::", s.type, s.description)), "|")


def decode_steps(raw: Column) -> Column:
    """Parts without a type and a description are dropped."""
    parts = F.transform(F.split(raw, r"\|"), lambda p: F.split(p, "::", 2))
    return F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("type"), p[1].alias("description")))


_BLOCK = "(?:" + "|".join(re.escape(start) + "(.*?)(?:" + re.escape(end) + r"|\z)" for start, end in MARKS) + ")"
_BLOCKS = _BLOCK.replace("(.*?)", ".*?")


def visible_text(c: Column) -> Column:
    """Without the blocks between marks, trimmed; an unclosed block runs to the end. White space on both sides of a block
    is that before it."""
    after_space = F.regexp_replace(c, rf"(?s)(?<=\s)(?:{_BLOCKS}\s*)+", "")
    return T.trimmed(F.regexp_replace(after_space, rf"(?s){_BLOCKS}+(\s*)(?:{_BLOCKS}\s*)*", "$1"))


def reasoning_text(c: Column) -> Column:
    """array<string>: what stands between marks, in order."""
    found = F.regexp_extract_all(c, F.lit(f"(?s){_BLOCK}"), F.lit(0))
    bare = lambda b: F.regexp_replace(b, "(?s)" + "|".join([rf"\A{re.escape(s)}" for s, _ in MARKS] + [rf"{re.escape(e)}\z" for _, e in MARKS]), "")
    return F.transform(found, bare)


def current_user_message(prompt: Column) -> Column:
    """The last line that starts with `user:`, else the last non-blank line, else the prompt."""
    lines = F.filter(F.transform(F.split(prompt, "\n"), T.trimmed), lambda x: x != "")
    asked = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("user:")))
    return F.coalesce(T.trimmed(F.regexp_replace(F.try_element_at(asked, F.lit(-1)), "(?i)^user:", "")), F.try_element_at(lines, F.lit(-1)), prompt)


def history_window(messages: DataFrame, last: int = 10) -> DataFrame:
    """Per session the last messages as `role: content` lines; of these, the latest user message goes."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    got = recent.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    latest = F.array_max(F.transform(F.filter("m", lambda m: m.role == "user"), lambda m: m.turn))
    kept = got.withColumn("latest", latest).withColumn("m", F.filter("m", lambda m: F.col("latest").isNull() | (m.turn != F.col("latest")) | (m.role != "user")))
    return kept.select("session_id", F.array_join(F.transform("m", lambda m: F.concat_ws(": ", m.role, m.content)), "\n").alias("history"))


def history_budget(messages: DataFrame, budget: int) -> DataFrame:
    """Newest messages first while the sum of their words stays within the budget."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    words = F.size(F.split("content", r"\s+"))
    return messages.withColumn("words", F.sum(words).over(w)).where(F.col("words") <= budget).select("session_id", "turn", "words")
