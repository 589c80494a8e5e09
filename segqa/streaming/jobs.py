"""Incremental jobs over arriving segments and progress events (ST1-ST3)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from segqa.config import JobConfig
from segqa.functions.text import normalize_ws
from segqa.operators.memory import cache_rows, cache_scope, group_key, route_reuse, scope_hash, translate_distinct, written
from segqa.operators.review import review
from segqa.operators.translation import Reviewer, Translator, empty_translation
from segqa.operators.validation import pair_issues
from segqa.plans.scale import materialize
from segqa.sources.documents import page_blocks, segment_id
from segqa.sources.glossary import Term
from segqa.streaming.keyed import KeyedLog

log = logging.getLogger(__name__)
KEYS = ["job_id", "segment_id"]
# Room in a stream's order index for every position that the array of a page's blocks can have.
PAGE_STRIDE = 1 << 32
# Spark's setting by which shuffle files go when what they were written for has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stream_segments(pages: DataFrame) -> DataFrame:
    """Segments of arriving pages; row-local, so it runs on streams as well.

    The order index rises along the job but has gaps, since later pages may not be there yet.
    """
    rest = [c for c in pages.columns if c not in ("job_id", "page_number", "text")]
    page = F.col("page_number").cast("long")
    return pages.select("job_id", page.alias("page_number"), *rest, F.explode_outer(page_blocks(F.col("text"))).alias("b")).where(
        F.col("b").isNotNull()
    ).select(
        "job_id", "page_number", *rest,
        segment_id(F.col("page_number"), F.col("b.pos")).alias("segment_id"),
        (F.col("page_number") * PAGE_STRIDE + F.col("b.pos")).alias("order_index"),
        F.col("b.source_text").alias("source_text"),
    )


def _logs(spark: SparkSession, segments: DataFrame, root: str) -> tuple[KeyedLog, KeyedLog, KeyedLog]:
    """What earlier batches have done: their segments, the first translation of a text by job, and over all jobs.

    The last two read the same rows, one a text and job: the first over all jobs is one of these.
    """
    kept = segments.select(*KEYS, "order_index", "source_text", "key", empty_translation().alias("translation")).schema
    first = ["order_index", "segment_id"]
    return (
        KeyedLog(spark, f"{root}/log-segments", segments.select(*KEYS).schema, KEYS, []),
        KeyedLog(spark, f"{root}/log-translations", kept, ["job_id", "key"], first, by=["key"]),
        KeyedLog(spark, f"{root}/log-translations", kept, ["key"], ["job_id", *first], by=["key"]),
    )


def process_batch(
    batch: DataFrame, epoch: int, root: str, translator: Translator, reviewer: Reviewer, terms: Sequence[Term],
    config: JobConfig, phrases: DataFrame | None = None,
) -> None:
    """Translate, review and validate one micro-batch and write it as its own folder.

    Segments done in an earlier batch are skipped; the first translation of each text, in the job and over all,
    serves as job memory and cache for the new ones. They are looked up by key in logs of what is done, so a
    batch reads the buckets of its own keys. The folders of a batch are overwritten on replay, so a
    restart neither repeats nor loses work. ``phrases`` is the operator's phrase memory for the review.
    """
    spark = batch.sparkSession
    segments = batch.select(*KEYS, "order_index", "source_text").dropDuplicates(KEYS)
    segments = materialize(segments.withColumn("key", group_key(normalize_ws(F.col("source_text")), F.col("segment_id"))))
    done_log, memory_log, text_log = _logs(spark, segments, root)
    for kept in (done_log, memory_log):
        kept.compact(epoch)
    columns = [*KEYS, "order_index", "source_text"]
    scope = cache_scope(config)
    done = done_log.known(segments, epoch)
    todo = segments if done is None else materialize(segments.join(done, KEYS, "left_anti"))
    none = segments.limit(0).withColumn("translation", empty_translation())
    in_job = none if epoch == 0 else materialize(memory_log.known(todo, epoch))
    anywhere = none if epoch == 0 else text_log.known(todo, epoch)
    memory_segments = todo.select(*columns).unionByName(in_job.select(*columns))
    known = in_job.select(*KEYS, "translation")
    stored = cache_rows(anywhere.select(*KEYS, "source_text", "translation"), scope, F.lit("1970-01-01 00:00:00").cast("timestamp"))
    cache = stored.groupBy("cache_key").agg(
        F.min_by(F.struct("translation", "origin_job_id", "origin_segment_id"), F.struct("origin_job_id", "origin_segment_id")).alias("c")
    ).select("cache_key", "c.*")
    routed = route_reuse(memory_segments, known, cache, scope_hash(scope), config.target_language)
    # Read three times below: by the texts to translate, by their rows and by all others.
    fresh = written(routed.where(F.col("route") != "existing"))
    made = translate_distinct(fresh, translator, config.target_language)
    ready = fresh.where(~F.col("route").isin("miss", "duplicate")).unionByName(made)
    # Routing knows the first new segment of each text in its job, so the logs need not look for it.
    leads = (F.col("segment_id") == F.col("first_id")).alias("leads")
    reviewed = review(
        ready.select(*columns, "route", F.col("group_key").alias("key"), leads, "translation"), reviewer, config, phrases
    )
    issues = pair_issues(F.col("source_text"), F.col("translation.translated_text"), terms, config.target_language)
    path = f"{root}/epoch={epoch}"
    # The logs get what has been written, not what would be computed again.
    result = reviewed.withColumn("issues", issues)
    result.write.mode("overwrite").option("compression", "zstd").parquet(path)
    stored_rows = spark.read.schema(result.schema).parquet(path)
    done_log.add(stored_rows, epoch)
    memory_log.add(stored_rows.where("leads"), epoch)


def start_incremental(
    segments: DataFrame, root: str, checkpoint: str, translator: Translator, reviewer: Reviewer, terms: Sequence[Term],
    config: JobConfig, available_now: bool = False, phrases: DataFrame | None = None,
) -> StreamingQuery:
    """Process segments as they arrive (ST1); results are read with :func:`read_results`."""
    def run(batch: DataFrame, epoch: int) -> None:
        # The session of the batch is the stream's own. Its steps shuffle the texts one after the other, and each ends in a table.
        batch.sparkSession.conf.set(CLEANUP, "true")
        process_batch(batch, epoch, root, translator, reviewer, terms, config, phrases)

    writer = segments.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_results(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/epoch=*").drop("leads")


def first_log(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], order: Sequence[str]) -> KeyedLog:
    """The log of :func:`write_first`."""
    return KeyedLog(spark, root, schema, keys, order)


def write_first(
    stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (), since: Column | None = None,
) -> DataStreamWriter:
    """One row per key of all that arrives (ST2): the one that ``order``, then its other columns, puts first.

    Null keys are keys. Which rows remain does not depend on how the stream is cut into batches: a batch
    adds the keys that are new and the rows that come before the one known so far, and :func:`read_first`
    reads one row a key. What is known lies in a keyed log in the shared folder, not in the memory of the executors.
    ``since``, a condition on the rows, is the rule of expiry: rows without it neither arrive nor count as known.
    """
    keys, order = list(keys), list(order)

    def run(batch: DataFrame, epoch: int) -> None:
        kept = first_log(batch.sparkSession, root, stream.schema, keys, order)
        kept.compact(epoch)
        rows = materialize(kept.first(batch if since is None else batch.where(since)))
        known = kept.known(rows, epoch)
        if known is not None:
            known = materialize(known if since is None else known.where(since))
            # Rows of a key that is known come out of both only if they are first.
            rows = kept.first(rows.unionByName(known)).exceptAll(known)
        kept.add(rows, epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def read_first(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows of :func:`write_first`, one a key."""
    return first_log(spark, root, schema, list(keys), list(order)).all()


def progress_stream(events: DataFrame) -> DataFrame:
    """Furthest progress per job and stage (ST3)."""
    return events.groupBy("job_id", "stage").agg(
        F.max("current").alias("current"), F.max("total").alias("total"), F.count(F.lit(1)).alias("events")
    )


def write_progress(events: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Progress of every batch by itself, one folder per batch; see :func:`read_progress`.

    The stream holds no state: a batch is reduced to one row per job and stage, and the
    batches are put together when they are read.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        progress_stream(batch).write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """Furthest progress per job and stage over all batches of :func:`write_progress`."""
    return read_results(spark, root).groupBy("job_id", "stage").agg(
        F.max("current").alias("current"), F.max("total").alias("total"), F.sum("events").alias("events")
    )


def progress_windows(events: DataFrame, event_time: str = "ts", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events per stage and time window, closed by a watermark."""
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), "stage").agg(
        F.count(F.lit(1)).alias("events"), F.max("current").alias("current")
    ).select(F.col("w.start").alias("window_start"), "stage", "events", "current")


def safe_sink(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A progress sink whose failure is logged and does not stop the stream."""
    def run(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch, epoch)
        except Exception:  # noqa: BLE001 - progress display must not interrupt the work
            log.exception("progress sink failed for batch %s", epoch)
            # The batch still has to run through, or its state would not be committed.
            batch.write.format("noop").mode("overwrite").save()

    return run


def write_updates(updates: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Write an update-mode aggregate, one folder per batch; see :func:`latest_updates`."""
    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    return updates.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)


def latest_updates(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key of a table written by :func:`write_updates`."""
    rows = spark.read.option("basePath", root).parquet(f"{root}/epoch=*")
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("l")).select(*keys, "l.*")
