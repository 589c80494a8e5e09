import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from segqa.llm import sharding

SIZES = {s: 1000 + s * 7919 % 500 for s in range(sharding.SLOTS)}


def loads(slots, shards):
    made = dict.fromkeys(range(shards), 0)
    for slot, shard in slots.items():
        made[shard] += SIZES[slot]
    return made


def test_map_is_even_and_grows_into_the_new_shard_only():
    first = sharding.first_map(SIZES, 8)
    even = loads(first, 8)
    assert max(even.values()) - min(even.values()) <= max(SIZES.values())
    grown = sharding.rebalanced(first, SIZES, 9)
    moved = {s for s in first if first[s] != grown[s]}
    assert {grown[s] for s in moved} == {8}
    assert max(loads(grown, 9).values()) <= 1.01 * min(loads(grown, 9).values())
    assert len(moved) <= 1.02 * sharding.SLOTS / 9


def test_rebalancing_edits_little_where_little_has_drifted():
    first = sharding.first_map(SIZES, 4)
    drifted = dict(first)
    for slot in [s for s in first if first[s] == 0][:100]:
        drifted[slot] = 1
    mended = sharding.rebalanced(drifted, SIZES, 4)
    assert sum(mended[s] != drifted[s] for s in drifted) <= 120
    even = loads(mended, 4)
    assert max(even.values()) <= 1.01 * min(even.values())
    assert sharding.rebalanced(first, SIZES, 4) == first


def test_stored_versions(spark):
    first = sharding.first_map(SIZES, 3)
    table = sharding.store_map(spark, 1, first, SIZES)
    grown = sharding.rebalanced(first, SIZES, 4)
    table = sharding.store_map(spark, 2, grown, SIZES, table)
    assert sharding.read_map(table) == grown and sharding.read_map(table, 1) == first
    records = spark.range(50).withColumn("slot", sharding.slot_of("id")).withColumn("shard", F.lit("clash"))
    for version, slots in ((1, first), (2, grown), (None, grown)):
        rows = sharding.assign(records, table, "slot", version).collect()
        assert len(rows) == 50 and all(r.shard == slots[r.slot] for r in rows)


def test_every_row_has_its_place(spark):
    texts = [(i, "text é " * (i % 17)) for i in range(500)] + [(None, None), (None, "x"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("size", F.lit("clash"))
    placed, table = sharding.shard(df, 8)
    rows = placed.collect()
    assert len(rows) == len(texts) and table.count() == sharding.SLOTS
    by_shard, by_slot = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r.place)
        by_slot[r.virtual_slot].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    assert all(len(s) == 1 for s in by_slot.values())
    expected = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == expected
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)
    assert sharding.shard(df.limit(0), 8)[0].count() == 0
