"""Chat formatting: conversations rendered by a compiled template, with the loss mask.

The rows of a conversation are dealt to a task by ``conv_id`` and sorted by turn; the template
renders them as a stream, one turn at a time, so a conversation may be of any length.  The
output has one row a piece: conv_id, part (its number), text, generated (under the loss mask).

Control strings inside roles and texts are escaped: a backslash goes in after the first character
of any control string, and one more where that form stands already.  Taking one away is
the exact inverse, and no escaped text holds a control string.

Defined results: a null role or text counts as empty; rows with the same turn are separate
turns, ordered by role and text; a null turn comes first; rows with a null conv_id are one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import arrow_type, read_table, small_batches
from .template import compile_template

# The control strings of the template and of other common formats.
TURN, SAY, STOP = "<|turn|>", "<|say|>", "<|end|>"
CONTROL = [TURN, SAY, STOP, "</s>", "[INST]", "[/INST]"]

TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role|escape }}" + SAY
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}" + STOP + "\n{% endfor %}")

_PLAIN = re.compile("|".join(rf"(?<={re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in CONTROL))
_MADE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(\\*)(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _MADE.sub(lambda m: m[0][1:], text)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _render(template: str, kind: pa.DataType, flush: int = 1000):
    """Sorted rows (conv_id, turn, role, text) to pieces (conv_id, part, text, generated)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, escape)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.bool_())], names=["conv_id", "part", "text", "generated"])

        for conv, rows in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            messages = ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)
            for part, (text, generated) in enumerate(render(messages=messages)):
                out.append((conv, part, text, generated))
                if len(out) >= flush:
                    yield batch()
        if out:
            yield batch()
    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Pieces of the formatted conversations (conv_id, part, text, generated), a conversation's in order."""
    small_batches(conversations.sparkSession)
    rows = (conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text"))
    kind = dict(conversations.dtypes)["conv_id"]
    return rows.mapInArrow(_render(template, arrow_type(conversations, "conv_id")), f"conv_id {kind}, part long, text string, generated boolean")


def turns(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts read back from formatted text that comes in parts."""
    waiting = ""
    for part in parts:
        waiting += part
        if not part.endswith("\n"):
            continue
        while (stop := waiting.find(STOP + "\n")) >= 0:
            turn, waiting = waiting[:stop], waiting[stop + len(STOP) + 1:]
            if not turn.startswith(TURN):
                raise ValueError("a turn doesn't start with its mark")
            role, say, text = turn[len(TURN):].partition(SAY)
            if not say:
                raise ValueError("a turn has no text mark")
            yield unescape(role), unescape(text)
    if waiting:
        raise ValueError("text after the last turn")


def _digest(kind: pa.DataType):
    """Pieces, a conversation's in order, to one row a conversation, from the formatted text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            chars, loss_chars, loss, span = 0, 0, hashlib.sha256(), []

            def close() -> int:
                text = unescape("".join(span))
                span.clear()
                loss.update(text.encode("utf-8", "surrogatepass"))
                return len(text)

            def parts() -> Iterator[str]:
                nonlocal chars, loss_chars
                for r in rows:
                    chars += len(r["text"])
                    if r["generated"]:
                        span.append(r["text"])
                    elif span:
                        loss_chars += close()
                    yield r["text"]

            n, all_turns = 0, hashlib.sha256()
            for role, text in turns(parts()):
                n += 1
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if span:
                loss_chars += close()
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2]),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, from the output of :func:`format_conversations`."""
    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(
        _digest(arrow_type(formatted, "conv_id")), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    table = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    own = "</s>[INST] ok [/INST]"
    kinds = dict(table.dtypes)
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    return read_back(format_conversations(table.unionByName(extra)))
