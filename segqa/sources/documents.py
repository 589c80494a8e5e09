"""Documents to ordered segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.functions.text import WS_CHARS, normalize_ws
from segqa.plans.scale import running_offsets


def page_blocks(text: Column) -> Column:
    """Non-blank lines of a page with their 0-based line position (blank lines keep theirs)."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(i.cast("int").alias("pos"), normalize_ws(line).alias("source_text")),
    )
    return F.filter(lines, lambda b: b["source_text"] != "")


def block_count(text: Column) -> Column:
    """Number of :func:`page_blocks`, without making them."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{WS_CHARS}]")))


def segment_id(page: Column, block: Column) -> Column:
    return F.format_string("p%03d-b%04d", page, block)


def read_segments(pages: DataFrame) -> DataFrame:
    """Segments of ``pages(job_id, page_number, text, ...)``, numbered densely per job.

    The order inside a page comes from the page's own array; only one row per page
    takes part in the running offset, which is then joined back on the page key.
    """
    blocks = pages.withColumn("__blocks", page_blocks(F.col("text"))).drop("text")
    sizes = pages.select("job_id", F.col("page_number").cast("long").alias("page_number"), block_count(F.col("text")).alias("n"))
    offsets = running_offsets(sizes, ["job_id"], "page_number", "n").drop("n")
    rest = [c for c in pages.columns if c not in ("job_id", "page_number", "text")]
    located = blocks.withColumn("page_number", F.col("page_number").cast("long")).join(
        offsets, ["job_id", "page_number"]
    )
    # The outer form keeps the planner from computing the array a second time to test it.
    return located.select(
        "job_id", "page_number", *rest, "offset", F.posexplode_outer("__blocks").alias("__i", "__b")
    ).where(F.col("__b").isNotNull()).select(
        "job_id",
        "page_number",
        *rest,
        F.col("__b.pos").alias("pos"),
        segment_id(F.col("page_number"), F.col("__b.pos")).alias("segment_id"),
        (F.col("offset") + F.col("__i")).cast("long").alias("order_index"),
        F.col("__b.source_text").alias("source_text"),
    )
