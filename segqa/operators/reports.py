"""Reports, progress, previews and output checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from segqa.functions.rules import is_blocking
from segqa.functions.text import normalize_ws, short_text
from segqa.operators.pieces import PIECE, Filter, key_filter, piece_places, pieces_of
from segqa.plans.scale import CHUNK, materialize, number_rows, skew_join, spread

KEYS = ["job_id", "segment_id"]
FINISHED = ("completed", "completed_with_output_warnings")
# The names of the metrics of a report.
METRICS = (
    "segments_total", "segments_human_review_required", "deterministic_issues", "critical_deterministic_issues",
    "review_findings", "critical_or_major_review_findings", "translation_memory_hits",
    "persistent_translation_cache_hits", "translation_memory_misses", "user_phrase_memory_hits", "llm_requests",
    "llm_input_tokens", "llm_output_tokens", "llm_total_tokens",
)
# Output verification: a translation counts as found when its first characters are.
PREFIX = 40
# Places of a text whose fragments are held at a time.
PLACES = 4096
# Found prefixes that a task holds before it hands them on.
HELD = 16_384


def _contribution(df: DataFrame, **values: Column) -> DataFrame:
    """Rows of one table as contributions to the job metrics."""
    zero = F.lit(0)
    return df.select("job_id", *[values.get(m, zero).cast("bigint").alias(m) for m in METRICS])


def audit_report(
    segments: DataFrame, unresolved: DataFrame, issues: DataFrame, findings: DataFrame, routed: DataFrame | None = None,
    usages: DataFrame | None = None, phrase_hits: DataFrame | None = None,
) -> DataFrame:
    """The fifteen metrics of every job (A1).

    All tables are stacked as contributions and summed in one group-by with map-side
    sums: one shuffle of partial sums, whatever the number of tables.
    ``usages`` is (job_id, token_usage) of translations and reviews; ``phrase_hits`` is (job_id, n).
    """
    one = F.lit(1)
    parts = [
        _contribution(segments, segments_total=one),
        _contribution(unresolved, segments_human_review_required=one),
        _contribution(
            issues, deterministic_issues=one,
            critical_deterministic_issues=F.when(F.col("severity") == "critical", 1).otherwise(0),
        ),
        _contribution(
            findings, review_findings=one,
            critical_or_major_review_findings=F.when(is_blocking(F.col("severity")), 1).otherwise(0),
        ),
    ]
    if routed is not None:
        def is_route(*names: str) -> Column:
            return F.when(F.col("route").isin(*names), 1).otherwise(0)

        parts.append(_contribution(
            routed, translation_memory_hits=is_route("memory", "duplicate"),
            persistent_translation_cache_hits=is_route("persistent"), translation_memory_misses=is_route("miss"),
        ))
    if usages is not None:
        parts.append(_contribution(
            usages.where(F.col("token_usage").isNotNull()), llm_requests=one,
            llm_input_tokens=F.col("token_usage.input_tokens"), llm_output_tokens=F.col("token_usage.output_tokens"),
            llm_total_tokens=F.col("token_usage.total_tokens"),
        ))
    if phrase_hits is not None:
        parts.append(_contribution(phrase_hits, user_phrase_memory_hits=F.col("n")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    sums = stacked.groupBy("job_id").agg(*[F.sum(m).alias(m) for m in METRICS])
    accepted = F.col("segments_total") - F.col("segments_human_review_required")
    return sums.withColumn("segments_auto_accepted", accepted)


def token_usage(usages: DataFrame, *by: str) -> DataFrame:
    """Requests and token sums of the rows that have a usage (A2), rolled up over ``by``."""
    rows = usages.where(F.col("token_usage").isNotNull()).select(
        *[F.col(c) if c in usages.columns else F.col(f"token_usage.{c}").alias(c) for c in by], "token_usage"
    )
    sums = [
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(f"token_usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
    ]
    return (rows.rollup(*by) if len(by) > 1 else rows.groupBy(*by)).agg(*sums)


def percent_done(done: Column, total: Column) -> Column:
    return (
        F.when(total <= 0, 0)
        .when(done >= total, 100)
        .otherwise(F.greatest(F.lit(0), F.floor(done * 100 / total)))
        .cast("int")
    )


def ratio_done(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0)))


def job_progress(jobs: DataFrame) -> DataFrame:
    """Progress columns for ``jobs`` with segments, translations and reviews counts (A3)."""
    n, t, r = F.col("segments"), F.col("translations"), F.col("reviews")
    done = F.least(t, n) + F.least(r, n)
    return jobs.withColumns({
        "translation_percent": percent_done(t, n),
        "review_percent": percent_done(r, n),
        "translation_ratio": ratio_done(t, n),
        "pipeline_current": done,
        "pipeline_total": F.greatest(n * 2, F.lit(1)),
    })


def job_counts(segments: DataFrame, translations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Segment, translation and review counts per job, in one pre-aggregated group-by."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select("job_id", *[F.lit(int(c == name)).alias(c) for c in ("segments", "translations", "reviews")])

    stacked = rows(segments, "segments").unionByName(rows(translations, "translations")).unionByName(rows(reviews, "reviews"))
    return stacked.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in ("segments", "translations", "reviews")])


def ready_for_output() -> Column:
    """Everything translated and reviewed, nothing open, nothing written yet (A4).

    Reads segments, translations, reviews, unresolved, has_output and status.
    """
    n = F.col("segments")
    return (
        ~F.col("has_output")
        & (F.col("unresolved") == 0)
        & (n > 0)
        & (F.col("translations") >= n)
        & (F.col("reviews") >= n)
        & ~F.col("status").isin(*FINISHED, "needs_human_review")
    )


def can_resume() -> Column:
    """Whether a stopped job has work left to pick up (A5)."""
    n, t, r = F.col("segments"), F.col("translations"), F.col("reviews")
    closed = F.col("has_output") | (F.col("status") == "needs_human_review") | ready_for_output()
    open_work = (n == 0) | (t < n) | (r < t) | ~F.col("status").isin(*FINISHED)
    return ~closed & open_work


def needs_pipeline() -> Column:
    n, t, r = F.col("segments"), F.col("translations"), F.col("reviews")
    return (n > 0) & ((t < n) | (r < t))


def reviews_complete() -> Column:
    return (F.col("translations") > 0) & (F.col("reviews") >= F.col("translations"))


def normalize_status() -> Column:
    """Status with stale in-progress values corrected from the counts."""
    status = F.coalesce("status", F.lit(""))
    n, t, r = F.col("segments"), F.col("translations"), F.col("reviews")
    translated = (n > 0) & (t >= n)
    return (
        F.when(status.startswith("translating") & translated, F.lit("segments_translated"))
        .when(status.startswith("reviewing") & (t > 0) & (r >= t), F.lit("translation_reviewed"))
        .when(status.startswith("pipeline") & translated & (r >= t), F.lit("translation_reviewed"))
        .otherwise(F.col("status"))
    )


def job_routing(require_human_review: bool) -> Column:
    """Next step of a job from its revise and unresolved counts."""
    human = (F.col("unresolved") > 0) & F.lit(require_human_review)
    return (
        F.when(F.col("revise") > 0, F.lit("revise_flagged_segments"))
        .when(human, F.lit("human_review"))
        .otherwise(F.lit("render_pdf"))
    )


def placeholder_leaks(text: Column) -> Column:
    """Sorted distinct unreplaced placeholders of an output text."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{[A-Z0-9_]+\}\}"), F.lit(0))))


def _expected_prefixes(translations: DataFrame, length: int) -> DataFrame:
    text = F.lower(normalize_ws(F.col("translated_text")))
    return translations.select(*KEYS, text.alias("t")).where(F.length("t") > 2).select(
        *KEYS, F.left("t", F.lit(length)).alias("prefix")
    )


def _held_prefixes(output: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(job_id, prefix)``: which of the ``wanted(job_id, prefix)`` the output texts ``(job_id, out)`` hold, and few others.

    Each text is read once, where it is. A place is looked at only if its first bytes start a prefix of any job,
    and leaves the task only if one of the lengths asked for gives a fingerprint that its own job wants; both are
    tested with filters of a fixed size.
    """
    fingerprint = F.xxhash64("job_id", "prefix")
    starts = wanted.select("prefix").distinct().select(F.monotonically_increasing_id().alias("id"), F.expr(f"left(prefix, {PIECE})").alias("start"))
    # Eight characters may be more than eight bytes: the pieces after the first do no harm.
    anchors = materialize(pieces_of(starts, "id", "start"))
    sizes = sorted(r[0] for r in anchors.select("size").distinct().collect())
    lengths = sorted(r[0] for r in wanted.select(F.length("prefix")).distinct().collect())
    first, own = key_filter(anchors.select("key")), key_filter(wanted.select(fingerprint.alias("key")))
    # The seed that the job gives to the fingerprints of its prefixes.
    rows = output.select("job_id", F.xxhash64("job_id").alias("seed"), "out")

    def held_rows(batch: pa.RecordBatch, held: set[tuple[int, str]]) -> pa.RecordBatch:
        made = sorted(held)
        jobs = batch.column(0).take(pa.array([m[0] for m in made]))
        return pa.RecordBatch.from_arrays([jobs, pa.array([m[1] for m in made], pa.string())], names=["job_id", "prefix"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_start, may_want = Filter(first), Filter(own)
        for batch in batches:
            texts = batch.column(2)
            held: set[tuple[int, str]] = set()
            for at in range(len(texts)):
                # One text at a time: a batch may hold many megabytes of them.
                text, seed = texts[at].as_py(), batch.column(1)[at].as_py() % (1 << 64)
                for size, places in _starting(texts.slice(at, 1), sizes, may_start):
                    # A piece of less than the usual size is a whole prefix.
                    possible = [n for n in lengths if n <= size] if size < PIECE else lengths
                    found = list({text[i : i + n] for i in places for n in possible if i + n <= len(text)})
                    prints = np.array([xxhash.xxh64_intdigest(f.encode("utf-8"), seed) for f in found], np.uint64).view(np.int64)
                    held.update((at, found[k]) for k in np.flatnonzero(may_want.may_hold(prints)).tolist())
                    if len(held) >= HELD:
                        yield held_rows(batch, held)
                        held = set()
            if held:
                yield held_rows(batch, held)

    schema = StructType([rows.schema["job_id"], *StructType.fromDDL("prefix string").fields])
    return rows.mapInArrow(scan, schema)


def _starting(text: pa.Array, sizes: Sequence[int], known: Filter) -> Iterator[tuple[int, list[int]]]:
    """Places of one text, in characters and in parts, whose first bytes the filter knows, with their size."""
    data = np.frombuffer(text[0].as_py().encode("utf-8"), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    for size in sizes:
        for place, key in piece_places(text, [size]):
            hit = np.unique(character[place[known.may_hold(key)]])
            for part in range(0, len(hit), PLACES):
                yield size, hit[part : part + PLACES].tolist()


def missing_segments(texts: DataFrame, translations: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Translations that do not occur in their job's output text.

    A translation is looked for whole, or else by its first ``prefix`` characters; the whole text
    contains its own start, so the prefix alone decides. One plan serves texts of any length and jobs of any number
    of segments: texts give the prefixes they hold, which are joined by equality. Jobs without an output
    text are left out; a null or blank text holds no translation.
    """
    output = texts.select("job_id", F.lower(normalize_ws(F.coalesce("text", F.lit("")))).alias("out"))
    expected = _expected_prefixes(translations, prefix).join(texts.select("job_id").distinct(), "job_id", "left_semi")
    expected = materialize(expected)
    wanted = materialize(expected.select("job_id", "prefix").distinct())
    held = _held_prefixes(spread(output), wanted).distinct()
    lost = wanted.join(held, ["job_id", "prefix"], "left_anti")
    return skew_join(expected, lost, ["job_id", "prefix"], "inner", spread_by=["segment_id"]).select(*KEYS)


def verify_output(texts: DataFrame, translations: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One verdict per job with an output text (A7, A8); the missing ids are in :func:`missing_segments`."""
    lost = missing_segments(texts, translations, prefix).groupBy("job_id").agg(F.count(F.lit(1)).alias("missing"))
    leaks = placeholder_leaks(F.coalesce("text", F.lit("")))
    return texts.select("job_id", F.length(F.coalesce("text", F.lit(""))).alias("extracted_text_chars"), leaks.alias("placeholder_leaks")).join(
        lost, "job_id", "left"
    ).select(
        "job_id",
        ((F.size("placeholder_leaks") == 0) & F.col("missing").isNull()).alias("ok"),
        "extracted_text_chars",
        F.coalesce("missing", F.lit(0)).alias("missing_segments"),
        "placeholder_leaks",
        # The wording of the messages.
        F.array_compact(F.array(
            F.when(F.size("placeholder_leaks") > 0, F.lit("PDF wynikowy zawiera niepodmienione placeholdery.")),
            F.when(
                F.col("missing").isNotNull(),
                F.lit("Nie wszystkie zatwierdzone segmenty odnaleziono w ekstrakcji PDF-a wynikowego."),
            ),
        )).alias("messages"),
    )


def translation_preview(
    pairs: DataFrame, last: int | None = None, source_chars: int = 500, translation_chars: int = 900, chunk: int = CHUNK
) -> DataFrame:
    """Translated segments of each job in order, numbered from 1, texts shortened.

    With ``last`` only the final rows of each job are shown; they are cut per task before
    the shuffle and numbered back from the job's total.
    """
    def shown(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(
            *KEYS, "page_number", "block_type", "order_index",
            short_text(F.col("source_text"), source_chars).alias("source"),
            short_text(F.col("translated_text"), translation_chars).alias("translation"),
            "confidence", *more,
        )

    if last is None:
        return number_rows(shown(pairs), ["job_id"], F.col("order_index"), ["order_index"], "number", chunk).withColumn(
            "number", F.col("number") + 1
        )
    back = W.partitionBy("job_id").orderBy(F.desc("order_index"))
    # Only what is shown is shortened.
    tail = shown(pairs.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= last), "__back")
    totals = pairs.groupBy("job_id").agg(F.count(F.lit(1)).alias("__n"))
    return tail.join(totals, "job_id").withColumn("number", F.col("__n") - F.col("__back") + 1).drop("__n", "__back")


def joined_text(pairs: DataFrame, label: str = "page", chunk: int = 1000) -> DataFrame:
    """The translated text of a job, every segment under a ``[page n | id]`` line (A10).

    One row per ``chunk`` order positions; the parts of a job joined by a blank line are
    its whole text, and no row grows with the length of the job.
    """
    head = F.concat(F.lit(f"[{label} "), F.col("page_number"), F.lit(" | "), F.col("segment_id"), F.lit("]\n"))
    item = F.struct("order_index", F.concat(head, F.coalesce("translated_text", F.lit(""))).alias("t"))
    part = F.floor(F.col("order_index") / chunk).cast("long").alias("part")
    return pairs.groupBy("job_id", part).agg(F.sort_array(F.collect_list(item)).alias("items")).select(
        "job_id", "part", F.array_join(F.transform("items", lambda i: i["t"]), "\n\n").alias("text")
    )


def close_reports(report: DataFrame, jobs: DataFrame, fingerprints: DataFrame, texts: DataFrame, translations: DataFrame) -> DataFrame:
    """A report with its job's files, their SHA-256, status and output verification.

    ``jobs(job_id, source_path, output_path, status)`` has a null ``output_path`` where there is no output, and then no
    hash of it either; a file without an entry in ``fingerprints(path, sha256)`` is "missing". ``texts`` and
    ``translations`` are as for :func:`verify_output`; jobs without an output text have a null verification.
    The ids of missing segments may be any number and stay in :func:`missing_segments`; the report counts them.
    """
    checked = verify_output(texts, translations)
    verification = checked.select("job_id", F.struct(*[c for c in checked.columns if c != "job_id"]).alias("output_verification"))

    def hashed(rows: DataFrame, side: str) -> DataFrame:
        found = fingerprints.select(F.col("path").alias(f"{side}_path"), F.col("sha256").alias(f"{side}_sha256"))
        absent = F.when(F.col(f"{side}_path").isNotNull(), F.lit("missing"))
        return rows.join(found, f"{side}_path", "left").withColumn(f"{side}_sha256", F.coalesce(f"{side}_sha256", absent))

    files = hashed(hashed(jobs.select("job_id", "source_path", "output_path", "status"), "source"), "output")
    closed = report.join(files, "job_id", "left").join(verification, "job_id", "left")
    return closed.withColumn("status", F.coalesce("status", F.lit("unknown")))


def nested_reports(report: DataFrame, issues: DataFrame, findings: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Audit reports with their issue and finding lists.

    A job with more than ``part_size`` entries is written as several parts that share the
    metrics; together they hold every entry once.
    """
    entry = "struct<kind:string,segment_id:string,severity:string,type:string,source:string,target:string,message:string>"
    entries = issues.select(
        "job_id", F.struct(
            F.lit("issue").alias("kind"), "segment_id", "severity", F.col("issue_type").alias("type"),
            F.col("source_value").alias("source"), F.col("translated_value").alias("target"), "message",
        ).cast(entry).alias("e"),
    ).unionByName(findings.select(
        "job_id", F.struct(
            F.lit("finding").alias("kind"), "segment_id", "severity", F.col("category").alias("type"),
            F.col("source_evidence").alias("source"), F.col("translation_evidence").alias("target"),
            F.col("explanation").alias("message"),
        ).cast(entry).alias("e"),
    ))
    counts = report.select(
        "job_id", F.ceil((F.col("deterministic_issues") + F.col("review_findings")) / part_size).alias("parts")
    ).where(F.col("parts") > 0)
    keyed = entries.withColumn("segment_id", F.col("e.segment_id"))
    placed = skew_join(keyed, counts, ["job_id"], "inner", spread_by=["segment_id"])
    # Aim at parts of half the size so that uneven hashing stays below it.
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("e"), F.col("parts") * 2)).otherwise(F.lit(0))
    grouped = placed.groupBy("job_id", part.alias("part")).agg(F.sort_array(F.collect_list("e")).alias("entries"))
    lists = grouped.select(
        "job_id",
        F.col("part").cast("long").alias("part"),
        F.filter("entries", lambda e: e["kind"] == "issue").alias("issues"),
        F.filter("entries", lambda e: e["kind"] == "finding").alias("findings"),
    )
    empty = report.where(F.col("deterministic_issues") + F.col("review_findings") == 0).select("job_id")
    heads = empty.withColumn("part", F.lit(0).cast("long"))
    return report.join(lists.unionByName(heads, allowMissingColumns=True), "job_id")
