"""Chat formatting by prefix-target expansion.

A conversation is written as one stream of turns; each turn is
``### role <text> text </turn>`` and a line feed. In roles and texts a backslash is put
before each backslash, ``#`` and ``<``, so that no text can hold a control string (in them
a blank or nothing stands before ``#`` and ``<``), and reading takes the backslashes away.

A stream is kept in segments of whole turns, so that no row grows with its conversation. Every
assistant turn becomes its own example: all turns before it are the context, and only its own
text is trainable. An example is a pair of spans over the stream of its conversation
(context_end; loss_start, loss_end in code points), kept beside the segment of its target, so
that the examples of a long conversation take room in proportion to its turns, not to their
square. ``example_texts`` writes them out.

Segments and examples are written, and all results read back from them: turns are found by the
template's marks alone, trained texts by the examples' loss spans.

Defined results: a null text or role counts as empty; null turns come first; turns of one
number are ordered by role, then text, and repeated rows are kept as turns. A null conv_id
is one conversation. Examples need an assistant turn: conversations without one have none.
An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import materialize, small_batches

#: Code points after which a stream goes on in another segment, at the next turn.
SEGMENT = 1 << 16
OPEN, MIDDLE, CLOSE = "### ", " <text> ", " </turn>\n"
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([\\#<])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, in order: conv_id, turn_no, role, rendered, start (of rendered in the conversation's stream), and for assistant turns context_end, loss_start and loss_end.

    A window per conversation numbers the turns and adds up lengths; it streams, and spills when a conversation is long.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    t = t.withColumn("rendered", F.concat("head", "body", F.lit(CLOSE)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("turn_no", F.row_number().over(order)).withColumn("stop", F.sum(F.char_length("rendered").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.col("stop") - F.char_length("rendered")
    trained = F.col("role") == TRAINED_ROLE
    loss_start = start + F.char_length("head")
    return t.select(
        "conv_id",
        "turn_no",
        "role",
        "rendered",
        start.alias("start"),
        F.when(trained, start).alias("context_end"),
        F.when(trained, loss_start).alias("loss_start"),
        F.when(trained, loss_start + F.char_length("body")).alias("loss_end"),
    )


def segments(formatted: DataFrame) -> DataFrame:
    """The streams in segments: conv_id, segment (ascending along a stream), start, stream, and the examples whose targets are in it."""
    example = F.when(F.col("loss_start").isNotNull(), F.struct(F.col("turn_no").alias("target_turn"), "context_end", "loss_start", "loss_end"))
    own = formatted.groupBy("conv_id", F.floor(F.col("start") / SEGMENT).alias("segment")).agg(
        F.min("start").alias("start"),
        F.array_sort(F.collect_list(F.struct("turn_no", "rendered"))).alias("turns"),
        F.array_sort(F.collect_list(example)).alias("examples"),
    )
    return own.select("conv_id", "segment", "start", F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("stream"), "examples")


def examples(written: DataFrame) -> DataFrame:
    """Every assistant turn as its own example: conv_id, segment, target_turn, context_end, loss_start, loss_end, and its target as the loss span has it."""
    e = written.select("conv_id", "segment", "start", "stream", F.explode("examples").alias("e")).select("conv_id", "segment", "start", "stream", "e.*")
    target = unescape(F.expr("substring(stream, int(loss_start - start) + 1, int(loss_end - loss_start))"))
    return e.select("conv_id", "segment", "target_turn", "context_end", "loss_start", "loss_end", target.alias("target"))


def example_texts(written: DataFrame) -> DataFrame:
    """The examples written out, as formatted: conv_id, target_turn, context, target. Its size grows with the square of a conversation's length."""
    streams = written.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "stream"))), lambda x: x["stream"]), "").alias("stream"))
    e = examples(written).drop("target")
    joined = e.alias("e").join(streams.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")))
    return joined.select(
        "e.conv_id",
        "target_turn",
        F.expr("substring(stream, 1, int(loss_start))").alias("context"),
        F.expr("substring(stream, int(loss_start) + 1, int(loss_end - loss_start))").alias("target"),
    )


def parse(written: DataFrame) -> DataFrame:
    """Turns read back from the segments by the template's marks: conv_id, segment, turns (role, text; in order)."""
    pieces = F.split("stream", CLOSE, -1)
    # in escaped roles and texts no blank stands before "<", so marks are found in their places only
    inner = lambda x: F.split(F.substring(x, len(OPEN) + 1, 1 << 30), MIDDLE, 2)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.struct(unescape(inner(x)[0]).alias("role"), unescape(inner(x)[1]).alias("text")))
    return written.select("conv_id", "segment", F.char_length("stream").cast("long").alias("size"), turns.alias("turns"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order, segments in order: one row for each. Holds a few numbers and two running hashes, however long a conversation is."""
    now, state = None, None

    def row() -> tuple:
        n, all_text, loss_chars, loss, size, trained, written = state
        return (now, n, all_text.hexdigest(), loss_chars, loss.hexdigest(), size, trained, written)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _OUT)

    for batch in batches:
        out = []
        for conv, size, turns, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "size", "turns", "own")), strict=True):
            if state is None or conv != now:
                if state is not None:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            state[4] += size
            for turn in turns:
                state[0] += 1
                state[1].update(f"{turn['role']}\n{turn['text']}\n".encode())
            for example in own or ():
                state[2] += len(example["target"])
                state[3].update(example["target"].encode())
                state[5] += 1
                state[6] += example["loss_end"]
        yield told(out)
    if state is not None:
        yield told([row()])


_OUT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]


def digest(written: DataFrame) -> DataFrame:
    """One row per conversation, read back from the segments and the examples.

    A hash of a whole conversation runs through its turns in order, so one task reads them, as a stream.
    """
    e = examples(written).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("target_turn", "target", "loss_end"))).alias("own"))
    t, e = parse(written).alias("t"), e.alias("e")
    both = t.join(e, F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.segment") == F.col("e.segment")), "left").select("t.conv_id", "t.segment", "size", "turns", "own")
    read = small_batches(both).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return read.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long")


#: A conversation whose texts hold the template's own control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def query(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digest(materialize(segments(format_turns(turns.select(*probe.columns).unionByName(probe))), "chat"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), s AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\#<]', '', 'g')) + 4 + 8 AS head,
         length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS body FROM c
), p AS (
  SELECT *, sum(head + body + 9) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM s
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(max(stop) AS BIGINT) AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant') AS n_examples,
       CAST(coalesce(sum(stop - 9) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM p GROUP BY conv_id
"""
