"""Sharding by fixed virtual slots and a versioned map of slots to shards.

A record's slot is a hash and never changes; only the map from slots to shards does. A map
is made from the bytes of each slot, heaviest first to the lightest shard, and edited, slot
by slot, when shards are added or have drifted apart. Every edit makes a new version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segqa.plans.scale import materialize

SLOTS = 8192
# A shard has drifted when its bytes are so much over the mean.
DRIFT = 0.005
MAP = "version int, slot int, shard int, bytes long"


def slot_of(*keys: str) -> Column:
    """A record's slot, from its key columns; nulls hash like a value of their own."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def slot_sizes(records: DataFrame, slot: str, size: str) -> dict[int, int]:
    """Bytes of each slot: at most ``SLOTS`` numbers."""
    return {r[0]: r[1] for r in records.groupBy(slot).agg(F.sum(size)).collect()}


def first_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot -> shard; the heaviest slot left always goes to the lightest shard."""
    loads = [(0, s) for s in range(shards)]
    made = {}
    for slot in sorted(range(SLOTS), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(loads)
        made[slot] = shard
        heapq.heappush(loads, (load + sizes.get(slot, 0), shard))
    return made


def rebalanced(current: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """``current`` with as few slots moved as it takes to bring ``shards`` shards near equal.

    Only shards that hold more than ``DRIFT`` over the mean give slots, the heaviest first, down
    to the mean, and always to the lightest shard. With one more shard than before, slots move
    into the new one only.
    """
    made = dict(current)
    loads = dict.fromkeys(range(shards), 0)
    for slot, shard in made.items():
        loads[shard] = loads.get(shard, 0) + sizes.get(slot, 0)
    mean = sum(loads.values()) / shards
    giving = {s for s, load in loads.items() if load > (1 + DRIFT) * mean}
    for slot in sorted((s for s in made if made[s] in giving), key=lambda s: (-sizes.get(s, 0), s)):
        size, source = sizes.get(slot, 0), made[slot]
        target = min(range(shards), key=lambda s: (loads[s], s))
        # No further from the mean than before, on either side.
        if size and loads[source] - size / 2 >= mean and loads[target] + size / 2 <= mean:
            made[slot] = target
            loads[source] -= size
            loads[target] += size
    return made


def store_map(spark: SparkSession, version: int, slots: dict[int, int], sizes: dict[int, int], earlier: DataFrame | None = None) -> DataFrame:
    """The map as a table of all versions so far: one row a slot and version."""
    rows = [(version, slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(slots.items())]
    table = spark.createDataFrame(rows, MAP)
    return materialize(earlier.unionByName(table) if earlier is not None else table)


def read_map(table: DataFrame, version: int | None = None) -> dict[int, int]:
    """One version of a stored map, the last one by default."""
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return {r["slot"]: r["shard"] for r in table.where(F.col("version") == version).collect()}


def assign(records: DataFrame, table: DataFrame, slot: str, version: int | None = None, shard_col: str = "shard") -> DataFrame:
    """Add each record's shard from a stored map of ``SLOTS`` rows a version."""
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    chosen = table.where(F.col("version") == version).select(F.col("slot").alias(slot), F.col("shard").alias(shard_col))
    return records.drop(shard_col).join(F.broadcast(chosen), slot)


def number_in_shard(records: DataFrame, table: DataFrame, slot: str, order: list[str], place_col: str, version: int = 1) -> DataFrame:
    """Place of each record in its shard, from 0 without gaps: slots one after the other, ``order`` within."""
    counts = records.groupBy(slot).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    chosen = table.where(F.col("version") == version).select(F.col("slot").alias(slot), "shard")
    starts = counts.join(F.broadcast(chosen), slot).select(slot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(slot).orderBy(*order)
    numbered = records.withColumn("__at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(materialize(starts)), slot).withColumn(
        place_col, (F.col("__at") + F.col("__start")).cast("long")
    ).drop("__at", "__start")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents in shards of near-equal bytes, and the first version of the map.

    Returns ``(doc_id, size, text_crc32, virtual_slot, shard, place)`` for every row. Size is the bytes
    of the text in UTF-8 plus 1; a null text has none and the checksum of the empty one.
    Slots come from the id and the text's checksum, so rows with a null id spread too; rows
    that repeat both stay together, in any order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = materialize(rows.withColumn("virtual_slot", slot_of("doc_id", "text_crc32")))
    sizes = slot_sizes(rows, "virtual_slot", "size")
    table = store_map(docs.sparkSession, 1, first_map(sizes, shards), sizes)
    placed = number_in_shard(assign(rows, table, "virtual_slot", 1), table, "virtual_slot", ["doc_id", "text_crc32", "size"], "place")
    return placed, table
