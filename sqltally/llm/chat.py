"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) to one string; nothing else is asked of it. Each
conversation's successive prefixes are rendered and consecutive outputs compared: what an output adds to the one
before is the span of the new turn. A second rendering with a marker in place of the new text shows where inside the span the text
itself begins and ends. An output that does not continue the one before shows a template that rewrites history.

The own template marks turns with bracketed control strings and escapes those inside texts reversibly: a backslash
goes in after the first character of a control string, one more than there are already.

Defined cases: a null text is empty, a null role too; turns are ordered by turn, role and text, nulls first, so repeated rows
are turns of their own; rows with a null conversation id form one conversation; an empty table gives an empty
answer; other columns are ignored, whatever their names. Where a template rewrites history or changes a text, the conversation is
flagged and has no loss mask. A conversation is one output text, so one task renders it; the work grows with the square of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.session import ship_package

Turns = list[tuple[str, str]]

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE", "[/ROLE]")
_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
#: Stands for a text while its place is looked for; any string that no template writes will do.
MARKER = ""


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def bracket_template(turns: Turns) -> str:
    """The own template; texts come escaped."""
    parts = ["<s>"]
    for role, text in turns:
        if role == "user":
            parts.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            parts.append(f" {text} </s>")
        else:
            parts.append(f"[ROLE {quote(role, safe='')}] {text} [/ROLE]")
    return "".join(parts)


def read_bracket(formatted: str) -> Turns:
    """The turns of a text that ``bracket_template`` made from escaped texts, unescaped."""
    at, turns = len("<s>"), []
    while at < len(formatted):
        if formatted.startswith("[INST]", at):
            role, start, mark = "user", at + len("[INST] "), "[/INST]"
        elif formatted.startswith("[ROLE", at):
            close = formatted.index("]", at)
            role, start, mark = unquote(formatted[at + len("[ROLE ") : close]), close + 2, "[/ROLE]"
        else:
            role, start, mark = "assistant", at + 1, "</s>"
        end = formatted.index(mark, start)
        turns.append((role, unescape(formatted[start : end - 1])))
        at = end + len(mark)
    return turns


def render(turns: Turns, template: Callable[[Turns], str], safe: Callable[[str], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """The formatted text, the span of each turn's text in it, and whether all spans hold.

    Without the last, history was rewritten or a text changed, and the spans mean nothing.
    """
    given: Turns = []
    before, spans = template(given), []
    for role, text in turns:
        shown = safe(text)
        probe = template([*given, (role, MARKER)])
        given.append((role, shown))
        now = template(given)
        place = probe.find(MARKER, min(len(before), len(probe)))
        after = len(probe) - place - len(MARKER)
        span = (place, len(now) - after)
        if place < 0 or not now.startswith(before) or now[span[0] : span[1]] != shown:
            return template([(r, safe(t)) for r, t in turns]), [], False
        spans.append(span)
        before = now
    return before, spans, True


def formatted(
    conversations: DataFrame,
    template: Callable[[Turns], str] = bracket_template,
    safe: Callable[[str], str] = escape,
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """Per conversation ``conv_id, text, spans`` (role, first, end, loss per turn; empty where not ``steady``) and ``steady``."""
    ship_package(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("row"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        "conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts")
    )
    span = pa.struct([("role", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())])
    schema = T.StructType([
        whole.schema["conv_id"],
        T.StructField("text", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()), T.StructField("first", T.LongType()),
            T.StructField("end", T.LongType()), T.StructField("loss", T.BooleanType()),
        ]))),
        T.StructField("steady", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, steady = [], [], []
            for roles, said in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                text, found, ok = render(list(zip(roles, said)), template, safe)
                texts.append(text)
                spans.append([{"role": r, "first": a, "end": b, "loss": r in loss_roles} for r, (a, b) in zip(roles, found)])
                steady.append(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span)), pa.array(steady)], schema.names
            )

    return whole.mapInArrow(run, schema)


def digests(made: DataFrame) -> DataFrame:
    """What ``formatted`` made with the own template, read back from its text and mask."""
    schema = T.StructType([
        made.schema["conv_id"],
        *[T.StructField(n, t) for n, t in (
            ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
            ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("steady", T.BooleanType()),
        )],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                turns = read_bracket(text)
                loss = "".join(unescape(text[s["first"] : s["end"]]) for s in spans if s["loss"])
                turns_hash = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                row = (len(turns), turns_hash, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays, batch.column("steady")], schema.names)

    return made.mapInArrow(run, schema)
