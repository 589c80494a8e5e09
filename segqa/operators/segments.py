"""Segment-level projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.functions.text import let
from segqa.functions.tokens import TOKEN_KEY_MARK, extract_tokens, key_count, token_key, token_prefix
from segqa.plans.scale import CHUNK, with_neighbours

_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Every run of cased letters starts with a capital and goes on in lower case."""
    broken = rf"(?<!{_CASED})\p{{Ll}}|(?<={_CASED})[\p{{Lu}}\p{{Lt}}]"
    return text.rlike(_CASED) & ~text.rlike(broken)


def block_type(text: Column, font_size: Column | None = None, median_size: Column | None = None) -> Column:
    size = F.lit(None).cast("double") if font_size is None else font_size
    median = F.lit(None).cast("double") if median_size is None else median_size
    large = (size != 0) & (median != 0) & (size >= median + 2)
    short_title = (F.length(text) <= 90) & (is_upper(text) | is_title(F.regexp_replace(text, ":+$", "")))
    return (
        F.when(large, F.lit("heading"))
        .when(short_title, F.lit("heading"))
        .when(F.ltrim(text).rlike("^[-•]"), F.lit("list_item"))
        .otherwise(F.lit("paragraph"))
    )


def attach_context(segments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Neighbouring texts in job order, across pages. ``order_index`` is dense per job."""
    return with_neighbours(
        segments, ["job_id"], "order_index", "source_text", "preceding_context", "following_context", chunk
    )


def protect(segments: DataFrame) -> DataFrame:
    """Segments with their protected tokens; row-local."""
    tokens = extract_tokens(F.col("source_text"), token_prefix(F.col("segment_id")))
    return segments.withColumn("protected_tokens", tokens)


def token_inventory(segments: DataFrame) -> DataFrame:
    """Tokens of the corpus by (kind, normalized): occurrences, segments, jobs (T4).

    Each segment first reduces to its own distinct tokens with counts, so the corpus
    needs no distinct aggregation; jobs are counted in a second, pre-aggregated step.
    """
    keys = F.transform(extract_tokens(F.col("source_text")), lambda t: token_key(t["kind"], t["normalized"]))
    counted = let(
        keys,
        lambda all_keys: F.transform(
            F.array_distinct(all_keys),
            lambda k: F.struct(k.alias("k"), key_count(all_keys, k).alias("n")),
        ),
    )
    # The outer form keeps the planner from computing the array a second time to test it.
    per_segment = segments.select("job_id", F.inline_outer(counted)).where(F.col("k").isNotNull())
    by_job = per_segment.groupBy("k", "job_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"))
    by_key = by_job.groupBy("k").agg(
        F.sum("n").alias("occurrences"), F.sum("s").alias("segments"), F.count(F.lit(1)).alias("jobs")
    )
    parts = F.split("k", TOKEN_KEY_MARK, 2)
    return by_key.select(
        parts[0].alias("kind"), parts[1].alias("normalized"), "occurrences", "segments", "jobs"
    )
