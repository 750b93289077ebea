"""Chat formatting from event logs.

A log has events (conv_id, message, seq, event, role, text) of these kinds: ``message`` sets a message, ``delta`` appends
to it (a streamed piece), ``edit`` and ``regenerate`` replace its text, ``delete`` removes it; a regeneration also drops
the messages after it that were last set before it. Folding is by message, so a conversation of any length is never
gathered in one place; what depends on the whole conversation is a running maximum over narrow rows.

Each message renders as one segment of the formatted text, with the place of its loss mask (the text of assistants).
Control strings inside texts get a backslash after their first character, and backslashes are doubled, so the formatted
text parses back to exactly the same messages.

Reading back assembles each conversation's segments, in order, to one stream of formatted text. The reader finds turns by
the template's marks alone, wherever segments begin or end, and the text under the loss mask by its places in the stream. Digests of a conversation are
sequential by nature, so one task streams a conversation, but it holds only hash states and the turn that is being read.

Defined results: null text is empty; null roles are empty; unknown roles are marked by name; equal (conv_id, turn) rows
are separate messages ordered by role and text; null conv_ids are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: The template: what stands before and after each role's text.
USER, ASSISTANT, SYSTEM = ("<s>[INST] ", " [/INST]"), (" ", " </s>"), ("<<SYS>>", "<</SYS>>")
OTHER = ("<<ROLE>>", "<</ROLE>>")
#: Where a control string begins, for escaping.
CONTROL = r"(<(?=/?s>|</?(?:SYS|ROLE)>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """Double backslashes, then break every control string by a backslash after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: a doubled backslash is one, a single one (after a control string's first character) is none."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold(events: DataFrame, message: tuple[str, ...] = ("message",)) -> DataFrame:
    """Final messages (conv_id, *message, role, text) of a log (conv_id, *message, seq, event, role, text); ``message`` names the columns that order messages.

    A message's text is that of its last setting event and the deltas after it; later deletion removes it. One aggregate holds
    the events of one message at a time.
    """
    key = ["conv_id", *message]
    kept_events = F.sort_array(F.collect_list(F.struct("seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))))
    sets = lambda e: e["event"].isin("message", "edit", "regenerate")
    set_at = F.array_max(F.transform(F.filter("log", lambda e: sets(e) | (e["event"] == "delete")), lambda e: e["seq"]))
    last = F.filter("log", lambda e: (F.col("set_at").isNull() | (e["seq"] >= F.col("set_at"))) & (sets(e) | e["event"].isin("delete", "delta")))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    folded = (
        events.groupBy(*key).agg(kept_events.alias("log")).withColumn("set_at", set_at).withColumn("last", last).filter(F.size("last") > 0)
        .select(
            *key, "set_at", F.exists("last", lambda e: e["event"] == "delete").alias("deleted"), F.exists("last", lambda e: e["event"] == "regenerate").alias("again"),
            F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"), F.array_join(F.transform("last", lambda e: e["text"]), "").alias("text"),
        )
    )
    before = W.partitionBy("conv_id").orderBy(*message).rowsBetween(W.unboundedPreceding, -1)
    regenerated = F.max(F.when(F.col("again"), F.col("set_at"))).over(before)
    # narrow rows alone pass the window; texts come back by key
    gone = folded.drop("text", "role").withColumn("cut", regenerated).filter(F.col("deleted") | (F.col("cut").isNotNull() & ~F.coalesce(F.col("set_at") > F.col("cut"), F.lit(False)))).select(*key)
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in key)
    return folded.alias("a").join(gone.alias("b"), F.expr(same), "left_anti").select(*key, "role", "text")


def render(messages: DataFrame, order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """``messages`` (conv_id, *order, role, text) as segments of formatted text, in the order of the columns ``order``; loss_start and loss_length are places in the segment."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    known = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
    wrapped = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), F.lit(SYSTEM[0]), text, F.lit(SYSTEM[1]))
    for name, (a, b) in known.items():
        wrapped = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(wrapped)
    spoken = role == "assistant"
    return messages.select(
        "conv_id", *order, wrapped.alias("segment"),
        F.when(spoken, F.lit(len(ASSISTANT[0]))).otherwise(F.lit(0)).cast("bigint").alias("loss_start"),
        F.when(spoken, F.length(text)).otherwise(F.lit(0)).cast("bigint").alias("loss_length"),
    )


def parse(segments: DataFrame) -> DataFrame:
    """Role, text and text under the loss mask, from the formatted segments alone."""
    s = F.col("segment")

    def inside(mark: tuple[str, str]) -> Column:
        return F.substr(s, F.lit(len(mark[0]) + 1), F.length(s) - F.lit(len(mark[0]) + len(mark[1])))

    other = F.substring_index(F.substr(s, F.lit(len(OTHER[0]) + 1)), OTHER[1], 1)
    rest = F.substr(s, F.lit(len(OTHER[0]) + len(OTHER[1]) + 1) + F.length(other))
    role = F.when(s.startswith(USER[0]), "user").when(s.startswith(SYSTEM[0]), "system").when(s.startswith(OTHER[0]), unescape(other)).otherwise("assistant")
    text = (
        F.when(s.startswith(USER[0]), inside(USER)).when(s.startswith(SYSTEM[0]), inside(SYSTEM))
        .when(s.startswith(OTHER[0]), F.substr(rest, F.lit(len(SYSTEM[0]) + 1), F.length(rest) - F.lit(len(SYSTEM[0]) + len(SYSTEM[1]))))
        .otherwise(inside(ASSISTANT))
    )
    loss = F.substr(s, F.col("loss_start") + 1, F.col("loss_length"))
    return segments.select("conv_id", "turn", role.alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"), F.length(s).cast("bigint").alias("chars"))


class Reader:
    """Turns of one conversation's formatted text, read as a stream by the template's marks."""

    def __init__(self) -> None:
        self.held = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that ``text`` completes."""
        self.held += text
        at = 0
        while True:
            found = self._turn(at)
            if found is None:
                break
            role, said, at = found
            yield role, said
        self.held = self.held[at:]

    def _turn(self, at: int) -> tuple[str, str, int] | None:
        held, role = self.held, None
        if held.startswith(OTHER[0], at):
            end = held.find(OTHER[1], at)
            if end < 0:
                return None
            role, at = plain(held[at + len(OTHER[0]) : end]), end + len(OTHER[1])
        for name, (a, b) in (("user", USER), ("system", SYSTEM), ("assistant", ASSISTANT)):
            if held.startswith(a, at):
                end = held.find(b, at + len(a))
                return None if end < 0 else (name if role is None else role, plain(held[at + len(a) : end]), end + len(b))
        return None


def plain(text: str) -> str:
    """Inverse of :func:`escape`."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def read_back(segments: DataFrame, order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """One row for each conversation: counts and checksums over its turns in order, parsed from the assembled formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("chat")
        now: list | None = None  # conv_id, turns, hash of turns, loss chars, hash of loss, chars, reader
        done: list[tuple] = []

        def close() -> None:
            if now:
                if now[6].held:
                    raise ValueError("formatted text ends inside a turn")
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return batch

        for batch in batches:
            for conv, segment, loss_start, loss_length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                for role, text in now[6].feed(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                loss = plain(segment[loss_start : loss_start + loss_length])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(segment)
            if done:
                yield out()
        close()
        if done:
            yield out()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", *order, "segment").select("conv_id", "segment", "loss_start", "loss_length")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_events(conversations: DataFrame) -> DataFrame:
    """A plain table of turns as a log: each row sets one message; equal turns get places of their own."""
    place = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("nth", F.row_number().over(place))
    return numbered.select("conv_id", "turn", "nth", F.lit(1).cast("bigint").alias("seq"), F.lit("message").alias("event"), F.coalesce("role", F.lit("")).alias("role"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    order = ("turn", "nth")
    messages = fold(as_events(rows.unionByName(extra)), order)
    return read_back(common.materialize(render(messages, order), "formatted"), order)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '<(</?(SYS|ROLE)>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS esc FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 15 ELSE 32 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
