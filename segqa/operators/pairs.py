"""Work that depends on the two texts of a pair alone, done once for all equal pairs.

Equal pairs are one row per task before anything is shuffled. What is found for a pair goes
back to its rows by a key of 32 bytes, so no text is moved again; the keys of pairs that repeat
without end are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.plans.scale import skew_join

SEGMENT = ["job_id", "segment_id"]
TEXTS = ["source_text", "translated_text"]
KEY = "pair_key"


def pair_key(source: Column, target: Column) -> Column:
    """32 bytes that only equal pairs share; a null text is no blank one."""
    # The length says where the source ends.
    size = F.coalesce(F.octet_length(source), F.lit(-1)).cast("string")
    second = F.coalesce(F.concat(F.lit("\x1f"), target), F.lit(""))
    key = F.unhex(F.sha2(F.concat(size, F.lit("|"), F.coalesce(source, F.lit("")), second), 256))
    # Never null, and known to be so: a join would make every key twice to test it.
    return F.coalesce(key, F.lit(b""))


def keyed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(KEY, pair_key(*map(F.col, TEXTS)))


def distinct_pairs(keyed_pairs: DataFrame) -> DataFrame:
    """``(pair_key, source_text, translated_text, n)`` of all pairs, with the number of their rows."""
    return keyed_pairs.groupBy(KEY, *TEXTS).agg(F.count(F.lit(1)).alias("n"))


def back_to_rows(keyed_rows: DataFrame, per_pair: DataFrame, counts: DataFrame, how: str) -> DataFrame:
    """Rows with what ``per_pair(pair_key, ...)`` has for their pair; ``counts(pair_key, n)`` are those of all pairs."""
    return skew_join(keyed_rows, per_pair, [KEY], how, spread_by=SEGMENT, counts=counts.select(KEY, "n")).drop(KEY)
