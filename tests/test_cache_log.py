"""The cache as a log against the whole table merged at once."""

import random

from pyspark.sql import functions as F

from segqa.operators import memory
from segqa.sources.cache_log import CacheLog

COLUMNS = "cache_key string, normalized_source string, translation string, origin_job_id string, origin_segment_id string, created_at timestamp, updated_at timestamp, last_used_at timestamp, hits bigint"


def rows(spark, seed, n):
    rnd = random.Random(seed)
    made = []
    for i in range(n):
        k = rnd.randrange(60)
        at = seed * 1000 + i
        made.append((f"k{k}", f"s{k}", f"t{at}", f"j{at}", f"o{at}", at, at, at, 0))
    names = COLUMNS.replace("timestamp", "long")
    df = spark.createDataFrame(made, names)
    return df.withColumns({c: F.timestamp_seconds(c) for c in ("created_at", "updated_at", "last_used_at")})


def test_versions_equal_the_whole_table(spark, tmp_path):
    schema = rows(spark, 0, 1).schema
    log = CacheLog(spark, str(tmp_path / "cache"), schema, buckets=8, every=2)
    whole = spark.createDataFrame([], schema)
    for version in range(5):
        if version == 3:
            used = spark.createDataFrame([(f"k{n % 70}", 90_000 + n) for n in range(200)], "cache_key string, at long").select("cache_key", F.timestamp_seconds("at").alias("used_at"))
            whole = memory.cache_touch(whole, used)
            # A version that is written again counts once.
            log.touch(used, version)
            log.touch(used, version)
        else:
            new = rows(spark, version, 40)
            whole = memory.cache_upsert(whole, new)
            log.upsert(new, version)
        whole = spark.createDataFrame(whole.collect(), schema)
    assert sorted(map(tuple, log.table(5).collect())) == sorted(map(tuple, whole.collect()))
    some = spark.createDataFrame([("k1",), ("k2",), ("nowhere",), (None,)], "cache_key string")
    assert sorted(map(tuple, log.lookup(some, 5).collect())) == sorted(tuple(r) for r in whole.collect() if r.cache_key in ("k1", "k2"))


def test_a_write_touches_its_own_keys_only(spark, tmp_path):
    schema = rows(spark, 0, 1).schema
    log = CacheLog(spark, str(tmp_path / "cache"), schema, buckets=32)
    big = spark.range(3200).select(F.concat(F.lit("k"), "id").alias("cache_key"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
    log.upsert(big.withColumn("updated_at", F.timestamp_seconds(F.lit(1))), 0)
    one = rows(spark, 3, 1)
    log.upsert(one, 1)
    assert spark.read.parquet(str(tmp_path / "cache" / "batch" / "epoch=1")).count() == 1
    plan = log.lookup(one, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert log.table(2).count() == 3200
