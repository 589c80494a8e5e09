"""Best-fit packing of token pieces into sequences through a configuration linear program.

Only the histogram of the lengths, at most ``capacity`` numbers, reaches the driver. There a
covering program over configurations (which lengths share a sequence) is solved by
multiplicative weights: each round prices the length classes, finds the most valuable
configuration by a knapsack dynamic program, and lowers the prices of what it covers.
The solution is rounded down to whole sequences, and the lengths left over go best fit,
longest first, into the room that is left. All of it works on runs of equal sequences,
so its cost does not depend on the number of pieces.

The plan then says, for each length, which ranks go to which sequences. Pieces get their
rank within their length from blocks of rows, so a length that a third of all pieces have
does not meet in one task.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segqa.llm import bpe
from segqa.llm.arrow import with_fields
from segqa.plans.scale import materialize

# Classes of equal width that the lengths fall into for the program; with as many classes as
# tokens in a sequence, a class is one length.
CLASSES = 4096
# Rounds of multiplicative weights, configurations a round, the share of the scarcest class
# that one of them covers at most, and how fast the price of a covered class falls.
ROUNDS = 60
CONFIGURATIONS = 64
STEP = 0.5
RATE = 1.0
# Blocks that pieces of one length are numbered in.
BLOCKS = 1024


@dataclass
class Plan:
    """Where pieces go: runs (length, first rank, number, first sequence, pieces a sequence, offset)."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def knapsack(price: np.ndarray) -> np.ndarray:
    """The class to take next, for each room 0..K, in the most valuable multiset of classes of that total size.

    ``price[k]`` is the value of class k, whose size is k. Zero stands for leaving a unit empty.
    """
    size = len(price) - 1
    best = np.zeros(size + 1)
    last = np.zeros(size + 1, np.int64)
    # Only classes with a price can pay; of equally good ones the largest goes first.
    classes = np.flatnonzero(price)[::-1].copy()
    values = price[classes]
    from_ = np.searchsorted(-classes, -np.arange(size + 1))
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        if from_[room] < len(classes):
            totals = values[from_[room] :] + best[room - classes[from_[room] :]]
            at = int(totals.argmax())
            if totals[at] > best[room]:
                best[room], last[room] = totals[at], classes[from_[room] + at]
    return last


def configurations(demand: np.ndarray, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Fractional uses of configurations that cover ``demand[k]`` pieces of each class k, or most of them.

    A round prices the classes, by their size and how far they are covered, and solves one
    knapsack. Its table holds the most valuable filling of every room, so it gives the best
    configuration around each of the classes that are least covered.
    """
    size = len(demand) - 1
    mass = np.arange(size + 1) / size
    covered = np.where(demand > 0, 0.0, 1.0)
    uses: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        price = np.where(covered < 1, mass * np.exp(-RATE * covered), 0.0)
        if not price.any():
            break
        last = knapsack(price)
        missing = (1 - covered) * demand * mass
        for k in np.argsort(-missing, kind="stable")[:CONFIGURATIONS].tolist():
            if covered[k] >= 1:
                continue
            found, room = [k], size - k
            while room > 0:
                k = int(last[room])
                room -= k or 1
                if k:
                    found.append(k)
            hit, times = np.unique(found, return_counts=True)
            open_ = (1 - covered[hit]) * demand[hit] / times
            # One whole sequence at least, as long as the demand allows it.
            amount = min(max(STEP * (demand[hit] / times).min(), 1.0), open_.min())
            if amount <= 0:
                continue
            uses[tuple(found)] = uses.get(tuple(found), 0.0) + amount
            covered[hit] = np.minimum(1.0, covered[hit] + amount * times / demand[hit])
    return uses


def plan_packing(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Plan:
    """Pack ``counts[length]`` pieces of each length into as few sequences as the program finds."""
    plan = Plan(capacity)
    width = -(-capacity // CLASSES)
    top = capacity // width
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    rank = dict.fromkeys(left, 0)
    # Longest first within a class.
    classes: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        classes.setdefault(min(top, -(-n // width)) if n <= top * width else 0, []).append(n)
    demand = np.zeros(top + 1)
    for k, lengths in classes.items():
        if k:
            demand[k] = sum(left[n] for n in lengths)

    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def leave(space: int, first: int, number: int) -> None:
        """``number`` sequences from ``first`` on have ``space`` tokens left."""
        if space and number:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((first, number))

    def put(n: int, number: int, first: int, each: int, offset: int) -> None:
        plan.runs.append((n, rank[n], number, first, each, offset))
        rank[n] += number
        left[n] -= number

    open_ = demand.copy()
    for found, amount in sorted(configurations(demand, rounds).items(), key=lambda x: (-x[1], x[0])):
        times = np.bincount(found, minlength=top + 1)
        hit = times > 0
        number = int(min(np.floor(amount + 1e-9), (open_[hit] // times[hit]).min()))
        open_ -= number * times
        while number > 0:
            # The longest pieces left of each class, as far as all places keep their length.
            lengths: list[int] = []
            stretch = number
            need: dict[int, int] = {}
            for k in found:
                n = next(n for n in classes[k] if left[n] > need.get(n, 0))
                need[n] = need.get(n, 0) + 1
                lengths.append(n)
            for n, each in need.items():
                stretch = min(stretch, left[n] // each)
            offset = 0
            for n in sorted(set(lengths), reverse=True):
                put(n, need[n] * stretch, plan.sequences, need[n], offset)
                offset += need[n] * n
            leave(capacity - offset, plan.sequences, stretch)
            plan.sequences += stretch
            number -= stretch
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                full, rest = divmod(left[n], each)
                for number, load in ((full, each), (1 if rest else 0, rest)):
                    if number:
                        put(n, number * load, plan.sequences, load, 0)
                        leave(capacity - load * n, plan.sequences, number)
                        plan.sequences += number
                continue
            space = rooms[at]
            first, number = room[space].pop()
            if not room[space]:
                del room[space], rooms[at]
            each = min(space // n, left[n])
            full = min(number, left[n] // each)
            put(n, full * each, first, each, capacity - space)
            leave(space - each * n, first, full)
            leave(space, first + full, number - full)
    return plan


def token_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokens of each text and ``end_id``, cut where longer than ``capacity``.

    Returns the id column, piece (from 0), start, length, ids_crc32 (little-endian unsigned
    32-bit ids) and, if asked for, ids. A null text is the empty text: one piece with ``end_id``.
    Repeated rows and null ids are pieces like any other; other columns are left out.
    """
    source = bpe.vocabulary_source(docs.sparkSession, path)
    base = docs.select(F.col(id_col), F.col(text_col))
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = with_fields(docs.select(id_col).schema, fields)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(source)
        for batch in batches:
            rows: list[tuple] = []
            owners: list[int] = []
            for row, ids in enumerate(coder.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    owners.append(row)
                    rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part), *([array("i", part)] if with_ids else [])))
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), *made], names=schema.names)

    return base.mapInArrow(run, schema)


def pack(pieces: DataFrame, length_col: str, capacity: int) -> DataFrame:
    """Add sequence_id and offset: each piece's sequence and its place there, without gaps.

    Pieces of no length or a null one take no room: they get null in both. Lengths over the
    capacity are an error. Columns named like the new ones are replaced.
    """
    rows = pieces.drop("sequence_id", "offset").withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows)
    counted = rows.where(F.col(length_col) > 0).groupBy(length_col).count()
    # One number for each length; an error below if some exceed the capacity.
    if counted.where(F.col(length_col) > capacity).head(1):
        raise ValueError(f"a piece is longer than {capacity}")
    plan = plan_packing({r[0]: r[1] for r in counted.collect()}, capacity)

    block = F.pmod(F.xxhash64("__row"), F.lit(BLOCKS)).cast("int")
    rows = rows.withColumn("__block", block)
    sizes = rows.groupBy(length_col, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(length_col).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(length_col, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(length_col, "__block").orderBy("__row")
    ranked = rows.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, [length_col, "__block"], "left")
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first"))

    # The plan has at most a few runs a length and configuration, however many pieces there are.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, first, _, sequence, each, offset in plan.runs:
        runs.setdefault(n, []).append((first, sequence, each, offset))
    kind = "__length long, __runs array<struct<first:long,sequence:long,each:long,offset:long>>"
    table = pieces.sparkSession.createDataFrame([(n, sorted(r)) for n, r in runs.items()], kind)
    placed = ranked.join(F.broadcast(table), F.col(length_col) == F.col("__length"), "left")
    run = F.element_at(F.filter("__runs", lambda r: r["first"] <= F.col("__rank")), -1)
    placed = placed.withColumn("__run", run)
    at = F.col("__rank") - F.col("__run.first")
    each = F.col("__run.each")
    return placed.withColumns({
        "sequence_id": (F.col("__run.sequence") + F.floor(at / each)).cast("long"),
        "offset": (F.col("__run.offset") + at % each * F.col(length_col)).cast("long"),
    }).drop("__row", "__block", "__rank", "__first", "__length", "__runs", "__run")


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id and the ids of its pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    return packed.where("sequence_id is not null").groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
