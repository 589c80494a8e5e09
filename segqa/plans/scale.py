"""Building blocks that keep plans safe at scale.

A key may hold a third of all rows. These helpers number, look at neighbours and
join without ever putting such a group into one task.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Rows of one group handled by one window partition.
CHUNK = 8192
# A join key is hot from this many rows on, and is dealt to one join key for each so many rows.
HOT_FLOOR = 200_000
# The keys that are salted; any other holds less than one part in HOT_KEYS of all rows.
HOT_KEYS = 10_000
# Groups of keys that are counted before single keys are.
KEY_GROUPS = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of a single split, which is at most one split's size, to all cores.

    Tables of more splits are returned as they are, whatever the number of cores.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


def hot_keys(counts: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """Keys of ``counts(on..., n)`` with more than ``HOT_FLOOR`` rows and their number of salts, largest first.

    At most ``HOT_KEYS`` of them: any further key holds less than 1/HOT_KEYS of all rows.
    This short list is the only thing that passes through the driver.
    """
    on = list(on)
    salts = F.ceil(F.col("n") / HOT_FLOOR).cast("int").alias("__salts")
    top = counts.where(F.col("n") > HOT_FLOOR).orderBy(F.desc("n")).limit(HOT_KEYS).select(*on, salts)
    rows = top.collect()
    return counts.sparkSession.createDataFrame(rows, top.schema) if rows else None


def _crowded(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key, for all keys that may be hot.

    A hot key makes its group of keys hot, so groups are counted first, of which each task has at most
    ``KEY_GROUPS``; single keys are counted, and shuffled, in hot groups only.
    """
    grouped = rows.select(*on, F.pmod(F.xxhash64(*on), F.lit(KEY_GROUPS)).cast("int").alias("__group"))
    sizes = grouped.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_FLOOR)
    full = [r[0] for r in sizes.select("__group").collect()]
    kept = grouped.where(F.col("__group").isin(full)) if full else grouped.limit(0)
    return kept.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    spread_by: Sequence[str],
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table that has one row per key, salting the hot keys of ``big``.

    Hot keys come from a count on the key columns (``counts``: keys plus ``n``, when the
    caller has it already). Their rows are spread over as many join keys as they have
    ``HOT_FLOOR`` rows, and the one matching row of ``small`` is repeated that often. Without
    hot keys it is a plain join.
    """
    on = list(on)
    hot = hot_keys(_crowded(big, on) if counts is None else counts, on)
    if hot is None:
        return big.join(small, on, how)
    hot = F.broadcast(hot)
    spread = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__salts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    salted_big = big.join(hot, on, "left").withColumn("__salt", spread).drop("__salts")
    salted_small = small.join(hot, on, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return salted_big.join(salted_small, [*on, "__salt"], how).drop("__salt")


def running_offsets(
    counts: DataFrame, keys: Sequence[str], position: str, value: str, offset: str = "offset", chunk: int = CHUNK
) -> DataFrame:
    """Exclusive running sum of ``value`` by integer ``position`` within ``keys``.

    Two levels: sums inside chunks of ``chunk`` positions, then over the chunk totals,
    so no window partition sees more than a chunk (or one row per chunk).
    """
    keys = list(keys)
    # One row per position; written down because both levels read it.
    cut = materialize(counts).withColumn("__chunk", F.floor(F.col(position) / chunk))
    inner = W.partitionBy(*keys, "__chunk").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = cut.withColumn("__in", F.sum(value).over(inner) - F.col(value))
    outer = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = cut.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__t"))
    starts = totals.withColumn("__start", F.sum("__t").over(outer) - F.col("__t")).drop("__t")
    joined = inside.join(starts, [*keys, "__chunk"])
    return joined.withColumn(offset, F.col("__in") + F.col("__start")).drop("__in", "__start", "__chunk")


def number_rows(
    df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence[Column | str], name: str, chunk: int = CHUNK
) -> DataFrame:
    """Dense 0-based row number within ``keys``.

    ``coarse`` is an integer that leads ``order``: rows are numbered inside blocks of
    ``chunk`` coarse values and shifted by the number of rows in earlier blocks.
    """
    keys = list(keys)
    cut = df.withColumn("__block", F.floor(coarse / chunk).cast("long"))
    sizes = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_offsets(sizes, keys, "__block", "__n", "__offset").drop("__n")
    inner = W.partitionBy(*keys, "__block").orderBy(*order)
    numbered = cut.withColumn("__rn", F.row_number().over(inner) - 1)
    return (
        numbered.join(offsets, [*keys, "__block"])
        .withColumn(name, (F.col("__rn") + F.col("__offset")).cast("long"))
        .drop("__rn", "__offset", "__block")
    )


def with_neighbours(
    df: DataFrame, keys: Sequence[str], index: str, value: str, previous: str, following: str, chunk: int = CHUNK
) -> DataFrame:
    """Previous and next ``value`` along a dense 0-based integer ``index`` within ``keys``.

    Windows run over chunks of the index. The first and last row of a chunk are also
    sent to the neighbouring chunk as a border row, so results cross chunk borders.
    """
    at = F.col(index)
    home = F.floor(at / chunk).cast("long")
    before = F.when((at % chunk == 0) & (at > 0), F.struct((home - 1).alias("c"), F.lit(True).alias("border")))
    after = F.when(at % chunk == chunk - 1, F.struct((home + 1).alias("c"), F.lit(True).alias("border")))
    own = F.struct(home.alias("c"), F.lit(False).alias("border"))
    spread = df.withColumn("__at", F.explode(F.array_compact(F.array(own, before, after))))
    spread = spread.withColumn("__chunk", F.col("__at.c"))
    w = W.partitionBy(*keys, "__chunk").orderBy(index)
    return (
        spread.withColumn(previous, F.lag(value).over(w))
        .withColumn(following, F.lead(value).over(w))
        .where(~F.col("__at.border"))
        .drop("__at", "__chunk")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A session whose driver and tasks are one process may do without: it gets a temporary
    folder. On a cluster a folder of the driver's machine would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="segqa-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage of results that several branches use, survives lost executors, and
    gives the planner real sizes and column pruning for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segqa-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
