"""What a stream has seen by key, as a log that every micro-batch looks into and adds to.

A batch writes its rows as a folder of its own, by bucket of their key, so a replayed batch writes the same folder
again and never sees its own rows. Every ``every`` batches the log is written anew as one base with
one row a key. A look-up reads the buckets that its keys fall into, of the last base and of the batches
since, and nothing else. Which base that is follows from the number of the batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass(frozen=True)
class KeyedLog:
    """Rows of ``schema`` under ``root``; of those with equal ``keys``, nulls included, the one that ``order`` puts first counts.

    Logs of one ``root`` read the same rows by keys of their own; ``by``, the keys that the buckets go by, is one for all of them.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: Sequence[str]
    order: Sequence[str]
    buckets: int = 64
    every: int = 16
    by: Sequence[str] | None = None

    def first(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        rest = [c for c in self.schema.names if c not in self.keys]
        if not rest:
            return rows.select(*self.schema.names).distinct()
        # All columns decide between equal ones, so the result does not depend on how rows arrive.
        order = F.struct(*self.order, *[c for c in rest if c not in self.order])
        return rows.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*self.keys, "__row.*").select(*self.schema.names)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        # A task has whole buckets, but Spark splits large ones.
        dealt = rows.select(*self.schema.names, self.bucket().alias("bucket")).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def _read(self, paths: list[str]) -> DataFrame:
        # Batches without rows have no file to tell a schema.
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    def before(self, epoch: int) -> DataFrame | None:
        """All rows of earlier batches with their ``bucket``, a key perhaps several times."""
        paths = self._paths(epoch - epoch % self.every, epoch)
        return self._read(paths) if paths else None

    def _paths(self, base: int, epoch: int) -> list[str]:
        return [f"{self.root}/base/epoch={base}"] * (base > 0) + [f"{self.root}/batch/epoch={e}" for e in range(base, epoch)]

    def compact(self, epoch: int) -> None:
        """Write the base that batches from ``epoch`` on start with, if one is due; call it before their look-ups.

        It follows from earlier batches alone, so writing it again changes nothing.
        """
        if epoch and epoch % self.every == 0:
            rows = self._read(self._paths(epoch - self.every, epoch))
            self._write(self.first(rows), f"{self.root}/base/epoch={epoch}")

    def known(self, wanted: DataFrame, epoch: int) -> DataFrame | None:
        """Rows of earlier batches for the ``keys`` of ``wanted``, one a key; None before the first batch."""
        rows = self.before(epoch)
        if rows is None:
            return None
        asked = wanted.select(*self.keys).distinct()
        # At most ``buckets`` numbers; the scan reads only their folders.
        touched = [r[0] for r in asked.select(self.bucket().alias("b")).distinct().collect()]
        same = [F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}")) for k in self.keys]
        found = rows.where(F.col("bucket").isin(touched)).alias("__a").join(asked.alias("__b"), same, "left_semi")
        return self.first(found)

    def add(self, rows: DataFrame, epoch: int) -> None:
        self._write(rows, f"{self.root}/batch/epoch={epoch}")

    def all(self) -> DataFrame:
        """One row a key over all batches so far; bases repeat what batches hold and are not read."""
        return self.first(self.spark.read.schema(self.schema).parquet(f"{self.root}/batch"))
