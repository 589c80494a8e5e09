"""Mixing sources to target weights by pivotal dependent rounding.

A source's target says how many of its words the mix takes, so each of its documents is due
target / size of the source copies: some whole ones and a fraction. The fractions are rounded
together. Two documents meet, and words move from one to the other, either way at random and
by as much as makes one of them whole; the odds keep what each is due on average, and the
words of the two stay what they were. So a source is off its target by no more than the one
document that is left over.

Documents meet in blocks dealt by hash, largest first, so that a source with a third of all rows is
many tasks and a small document tends to be left. The documents that the blocks leave over meet
in blocks again, and so on: a reduction tree, whose levels write their rows to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segqa.plans.scale import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
# Copies of a document at most, so times that a source may be stretched.
MOST = 3
# Documents that meet in one block, and blocks whose left-overs meet in one of the next level.
BLOCK = 4096
# Rows alike in id, source and text that are handled as one.
ALIKE = 1 << 16
SEED = 11


def word_count(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(table: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order, without bringing them to one task."""
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")))
    # One row a partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    starts = parts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(starts, "__part").withColumn(name, F.col("__id") + F.col("__shift")).drop("__part", "__id", "__shift")


def with_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, ...)``, one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes by weight. A
    target stops at ``most`` times the size; the excess goes to the others by weight until none is
    above. Each round finds the sources that the rest would lift above their limit, and only three sums
    reach the driver.
    """
    numbered = _numbered(sources, [F.asc_nulls_last("source")], "__at")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = materialize(numbered.select(*sources.columns, turn.alias("__weight"), (F.col("source_size") * most).cast("double").alias("__limit")))
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("__weight")).first()
    level, stopped = (total or 0) / (all_weights or 1), 0
    while True:
        above = F.col("__limit") < F.col("__weight") * level
        number, words, weight = weighed.where(above).agg(F.count(F.lit(1)), F.sum("__limit"), F.sum("__weight")).first()
        if number <= stopped:
            break
        stopped, level = number, (total - words) / (all_weights - weight)
    return weighed.withColumn("target", F.least("__limit", F.col("__weight") * level)).drop("__weight", "__limit")


def transfer(size: list[int], share: list[float], draw: Sequence[float]) -> None:
    """Round fractional ``share`` in place until one at most is neither 0 nor 1; the words, size times share, stay the same.

    A document without words has none to move and is rounded by its own draw.
    """
    held = -1
    for i, draws in enumerate(draw):
        if share[i] <= 0.0 or share[i] >= 1.0:
            continue
        if not size[i]:
            share[i] = float(draws < share[i])
            continue
        if held < 0:
            held = i
            continue
        has, other_has = size[held] * share[held], size[i] * share[i]
        room, other_room = size[held] - has, size[i] - other_has
        up, down = min(room, other_has), min(has, other_room)
        if draws * (up + down) < down:
            # The held one takes from the other.
            if room <= other_has:
                share[held], share[i] = 1.0, max(0.0, (other_has - room) / size[i]) if room < other_has else 0.0
            else:
                share[held], share[i] = (has + other_has) / size[held], 0.0
        elif has <= other_room:
            share[held], share[i] = 0.0, (other_has + has) / size[i] if has < other_room else 1.0
        else:
            share[held], share[i] = max(0.0, (has - other_room) / size[held]), 1.0
        held = next((x for x in (held, i) if 0.0 < share[x] < 1.0), -1)


def _settled(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes after one level of the tree: one at most of each ``(source, block)`` still has a fraction."""

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "hash", "part"], ascending=[False, True, True], kind="stable")
        draw = np.random.default_rng([SEED, level, int(rows["hash"].iloc[0]) & (1 << 63) - 1, int(key[2])]).random(len(rows))
        share = rows["share"].tolist()
        transfer(rows["size"].tolist(), share, draw.tolist())
        return rows.assign(share=share)

    return materialize(nodes.groupBy("source_hash", "source", "block").applyInPandas(meet, nodes.schema))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[int], most: int) -> DataFrame:
    """``(id, source, size, source_size, target, hash, part, n, total)``: n rows alike have total copies."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        _hash(id_col, source_col, text_col).alias("hash"),
    )
    # Rows alike are one from the start, however many they are.
    alike = materialize(rows.groupBy("id", "source", "size", "hash").agg(F.count(F.lit(1)).alias("n")))
    sources = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("__nodes"))
    sources = materialize(with_targets(sources, weights, most))
    blocks = F.ceil(F.col("__nodes") / BLOCK).cast("long")
    known = sources.select(
        F.col("source").alias("__source"), "source_size", "target", blocks.alias("blocks"), F.xxhash64("source").alias("source_hash"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__due"),
    )
    # Both sides are shuffled from tables unless the sources are few, so a hot source can be split.
    joined = alike.join(known, alike["source"].eqNullSafe(F.col("__source"))).drop("__source")
    parts = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE))))
    parts = parts.withColumn("n", F.least(F.col("n") - F.col("part") * ALIKE, F.lit(ALIKE)))
    due = F.col("n") * F.col("__due")
    nodes = parts.select(
        "id", "source", "size", "source_size", "target", "hash", "part", "n", "source_hash", F.floor(due).cast("long").alias("whole"),
        (due - F.floor(due)).alias("share"), F.pmod(F.xxhash64("hash", "part"), "blocks").alias("block"),
    )
    most_blocks = sources.agg(F.max(blocks)).first()[0] or 1
    fraction = (F.col("share") > 0) & (F.col("share") < 1)
    level, settled = 0, _settled(nodes, 0)
    done = [settled.where(~fraction)]
    while most_blocks > 1:
        level, most_blocks = level + 1, -(-most_blocks // BLOCK)
        left = settled.where(fraction).withColumn("block", F.floor(F.col("block") / BLOCK).cast("long"))
        settled = _settled(left, level)
        done.append(settled.where(~fraction))
    # One a source at most: to the nearer side.
    done.append(settled.where(fraction))
    made = done[0]
    for more in done[1:]:
        made = made.unionByName(more)
    return made.withColumn("total", F.col("whole") + (F.col("share") >= 0.5).cast("long")).drop("whole", "share", "block", "source_hash")


def _hash(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, source_col, text_col)


def copies(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies)`` for every row: how often the mix takes it, up to ``most`` times.

    Size is the number of words; a null or empty text has 0. A null source is one of its own, the
    last. copies is what the row is due, rounded down or up: the words taken of a source, size
    times copies, are off its target by half its longest document at most (by a rounding error of the
    doubles if all documents come out whole). Rows that repeat id, source and text share their
    copies as evenly as can be. The last fraction of a source goes to the nearer side; all others
    are rounded at random with a fixed seed, so reruns agree. Rows in, rows out: an empty table
    gives an empty one. Other columns play no part, whatever their names.
    """
    planned = _planned(docs, id_col, source_col, text_col, weights, most)
    each = planned.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    more = (F.col("__k") < F.col("total") % F.col("n")).cast("long")
    return each.select("id", "source", "size", "source_size", "target", (F.floor(F.col("total") / F.col("n")) + more).cast("long").alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as :func:`copies` says.

    Rows that repeat id, source and text give their copies from the one whose columns hash lowest.
    """
    planned = _planned(docs, id_col, source_col, text_col, weights, most).where("total > 0")
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _hash(id_col, source_col, text_col).alias("hash"))
    whole = F.struct(*docs.columns)
    ones = docs.groupBy(key.alias("__key")).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("__row"))
    wanted = planned.select(F.struct("id", "source", "hash").alias("__key"), "total")
    each = wanted.join(ones, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))))
    return each.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
