"""The persistent cache, or another keyed memory, as a log in the shared folder (M4, M7, M8).

Every write is a version. It reads the buckets that its keys fall into, merges the rows of these keys, and writes those
rows alone; the rest of the cache is neither read nor written. Writing a version again, after a failure, gives the
same rows, as a version never sees itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from segqa.operators.memory import touch_by_key, upsert_by_key
from segqa.plans.scale import materialize
from segqa.streaming.keyed import KeyedLog


class CacheLog:
    """Rows of ``schema``, one a ``key``; ``replaced`` columns follow the latest row that is stored."""

    def __init__(
        self, spark: SparkSession, root: str, schema: StructType, key: str = "cache_key",
        replaced: Sequence[str] = ("translation", "origin_job_id", "origin_segment_id"), buckets: int = 256, every: int = 16,
    ) -> None:
        self.spark, self.schema, self.key, self.replaced = spark, schema, key, list(replaced)
        # The newest version of a key comes first.
        kept = StructType([*schema.fields, StructField("age", LongType())])
        self.log = KeyedLog(spark, root, kept, [key], ["age"], buckets, every)

    def lookup(self, wanted: DataFrame, version: int) -> DataFrame:
        """Rows of the keys of ``wanted`` before ``version`` was written (M4)."""
        self.log.compact(version)
        known = self.log.known(wanted.where(F.col(self.key).isNotNull()), version)
        return self.spark.createDataFrame([], self.schema) if known is None else known.select(*self.schema.names)

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Store new rows (M7)."""
        rows = materialize(rows.select(*self.schema.names))
        self._write(upsert_by_key(self.lookup(rows, version), rows, self.key, self.replaced), version)

    def touch(self, used: DataFrame, version: int) -> None:
        """Count uses ``used(key, used_at)`` (M8); keys that are not stored are not counted."""
        used = materialize(used.select(self.key, "used_at"))
        self._write(touch_by_key(self.lookup(used, version), used, self.key), version)

    def _write(self, rows: DataFrame, version: int) -> None:
        self.log.add(rows.withColumn("age", F.lit(-version).cast("long")), version)

    def table(self, versions: int) -> DataFrame:
        """The whole table after so many versions."""
        self.log.compact(versions)
        rows = self.log.before(versions)
        return self.spark.createDataFrame([], self.schema) if rows is None else self.log.first(rows).select(*self.schema.names)
