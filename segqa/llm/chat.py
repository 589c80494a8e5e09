"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Running sums of the turns' tokens decide where a
window ends. Each repeats the system turn and a limited stretch of the turns before it; of
those nothing is under the loss mask, so every assistant turn is a target exactly once.
The template marks turns with control strings, which are escaped where a text holds them.

Turns are numbered without gaps, and a conversation is cut into segments of so many turns, each of
which gets the system turn and the turns right before it, so a conversation of any length is
spread over many tasks. A window ends with its segment.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segqa.llm import bpe
from segqa.plans.scale import materialize

# Tokens of a window, and of the repeated turns in it; turns of a segment. A turn counts one token
# at least, so no more than ``HISTORY`` turns are ever repeated.
BUDGET = 1024
HISTORY = 256
SEGMENT = 4096

# Control strings of the template; a mark goes before each of them, and before itself, in texts.
OPEN, CLOSE, MARK = "### ", "</turn>\n", "\\"
_ESCAPED = re.compile(r"\\|###|</turn>")
_ESCAPED_ROLE = re.compile(r"\\|###|</turn>|:")
_PLAIN = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")

WINDOWS = "segment long, window long, repeated int, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: MARK + m.group(), text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m.group(1), text)


def template(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends in it."""
    head = OPEN + _ESCAPED_ROLE.sub(lambda m: MARK + m.group(), role) + ": "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted window."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(text)]


def windows(
    turns: Iterator[tuple[str, str, int, bool]], budget: int, history: int, opens: bool = True
) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """Windows (number of repeated turns, text, loss spans) of one segment's turns (role, text, tokens, fresh).

    Turns that are not fresh come first and only serve as system turn and history, which never
    holds a system turn. The first of all may be the system turn if the conversation ``opens`` with it. A turn that alone is over the budget still gets a window.
    """
    system: list[tuple[str, str, int]] = []
    before: deque[tuple[str, str, int]] = deque()
    held: list[tuple[str, str, int]] = []
    opening = None
    # Running sums of tokens: of all turns so far, and of those before the window.
    total = begun = 0

    def remember(turn: tuple[str, str, int]) -> None:
        if turn[0] != "system":
            before.append(turn)
            while before and sum(t[2] for t in before) > history:
                before.popleft()

    def finish() -> tuple[int, str, list[tuple[int, int]]]:
        parts: list[str] = []
        loss: list[tuple[int, int]] = []
        at = 0
        again = len(system) + len(before)
        for n, (role, text, _) in enumerate([*system, *before, *held]):
            made, start, end = template(role, text)
            if n >= again and role == "assistant":
                loss.append((at + start, at + end))
            parts.append(made)
            at += len(made)
        for turn in held:
            if turn is opening:
                system.append(turn)
            else:
                remember(turn)
        held.clear()
        return again, "".join(parts), loss

    for n, (role, text, tokens, fresh) in enumerate(turns):
        turn = (role, text, tokens)
        leads = opens and n == 0 and role == "system"
        if not fresh:
            if leads:
                system.append(turn)
            else:
                remember(turn)
            continue
        repeated = sum(t[2] for t in [*system, *before])
        if held and repeated + total + tokens - begun > budget:
            yield finish()
            begun = total
        held.append(turn)
        total += tokens
        if leads:
            opening = turn
    if held:
        yield finish()


def by_key(run: Callable[[tuple, Iterator[dict]], Iterator[tuple]], keys: list[str], schema: pa.Schema):
    """A function for mapInArrow over rows sorted by ``keys``: ``run`` gets the rows of one key after the other.

    The first column of ``schema`` is the first key, whose type is taken from the rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_of = schema

        def rows() -> Iterator[tuple[tuple, dict]]:
            nonlocal made_of
            for batch in batches:
                made_of = schema.set(0, batch.schema.field(keys[0]))
                for row in batch.to_pylist():
                    yield tuple(row[k] for k in keys), row

        stream = rows()
        ahead = next(stream, None)
        made: list[tuple] = []
        size = 0
        while ahead is not None:
            key = ahead[0]

            def group() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:  # noqa: B023
                    row = ahead[1]
                    ahead = next(stream, None)
                    yield row

            members = group()
            for row in run(key, members):
                made.append(row)
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(made) >= 1000 or size > 8_000_000:
                    yield _batch(made, made_of)
                    made, size = [], 0
            for _ in members:
                pass
        if made:
            yield _batch(made, made_of)

    return work


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_places(rows: DataFrame, path: str) -> DataFrame:
    """Add ``tokens`` of each ``(conv_id, turn, role, text)`` and ``at``, its place in its conversation from 0 without gaps.

    Rows are dealt by ranges of their order, so a conversation of any size is spread, also where
    many rows have one turn number. A range counts its own rows. Only a conversation that goes
    on from an earlier range has to be shifted: there is one a range at most, so that list is
    no longer than there are tasks.
    """
    source = bpe.vocabulary_source(rows.sparkSession, path)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    names = [*rows.columns, "tokens", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(source)
        current, n = None, 0
        for batch in batches:
            counts = [max(1, len(ids) // 4) for ids in coder.encode(batch.column("text").to_pylist())]
            places = []
            for conv in batch.column("conv_id").to_pylist():
                n = n + 1 if conv == current else 0
                current = conv
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(places, pa.int64())], names=names)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = sorted_rows.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, tokens long, inside long")
    counted = materialize(counted.withColumn("part", F.spark_partition_id()))
    parts = counted.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.withColumn("shift", F.sum("n").over(earlier)).where("shift is not null")
    shifts = shifts.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), "shift")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))
    return counted.join(F.broadcast(shifts), same, "left").select(
        *rows.columns, "tokens", (F.col("inside") + F.coalesce("shift", F.lit(0))).alias("at")
    )


def format_windows(conversations: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, segment, window, repeated, text, loss)``: the windows of every conversation.

    Turns go by number, then role and text, however far apart the numbers are; a null number comes
    last, and a null role or text is empty. Rows that repeat are turns like any other, and rows with
    a null conversation are one conversation. ``repeated`` is the number of turns at the start of a
    window that an earlier one has in full; ``loss`` holds the code points of each assistant text
    that is not repeated. Only a first turn by ``system`` is a system turn. Other columns are left
    out; ids are of any type that can be ordered.
    """
    blank = F.lit("")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    length = SEGMENT
    placed = with_places(rows, path).withColumn("segment", F.floor(F.col("at") / length))
    placed = materialize(placed.select("conv_id", "segment", "at", "role", "text", "tokens"))

    # What a later segment sees of the others: the turns right before it that fit the history, and the system turn.
    later = placed.where((F.col("segment") > 0) & (F.col("at") % length == 0)).select(F.col("conv_id").alias("__conv"), F.col("segment").alias("__segment"))
    own = F.col("conv_id").eqNullSafe(F.col("__conv"))
    leads = (F.col("at") == 0) & (F.col("role") == "system")
    reaches = F.floor((F.col("at") + history) / length)
    near = placed.where((reaches > F.col("segment")) & (F.col("role") != "system"))
    near = near.withColumn("segment", F.explode(F.sequence(F.col("segment") + 1, reaches)))
    back = Window.partitionBy("conv_id", "segment").orderBy(F.desc("at"))
    last = near.withColumn("back", F.sum("tokens").over(back)).where(F.col("back") <= history).drop("back")
    last = last.join(later, own & (F.col("segment") == F.col("__segment")), "left_semi")
    system = placed.where(leads).drop("segment").join(later, own).withColumnRenamed("__segment", "segment").drop("__conv")

    # By place, the system turn and history come before a segment's own turns.
    fresh = placed.withColumn("fresh", F.lit(True))
    whole = fresh.unionByName(last.withColumn("fresh", F.lit(False))).unionByName(system.withColumn("fresh", F.lit(False)))
    ready = whole.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    fields = [("segment", pa.int64()), ("window", pa.int64()), ("repeated", pa.int32()), ("text", pa.string()), ("loss", pa.list_(span))]
    schema = pa.schema([("conv_id", pa.null()), *fields])

    def run(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        first = next(group)
        turns = ((r["role"], r["text"], r["tokens"], r["fresh"]) for r in chain([first], group))
        for n, (again, text, loss) in enumerate(windows(turns, budget, history, opens=first["at"] == 0)):
            yield (*key, n, again, text, [{"start": a, "end": b} for a, b in loss])

    return ready.mapInArrow(by_key(run, ["conv_id", "segment"], schema), f"conv_id {dict(conversations.dtypes)['conv_id']}, {WINDOWS}")
