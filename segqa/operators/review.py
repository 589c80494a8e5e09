"""Review, routing of findings and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from segqa.config import JobConfig
from segqa.functions.rules import FINDING_TYPE, is_blocking
from segqa.functions.text import short_text
from segqa.operators.phrases import add_phrase_findings, phrase_apply, phrase_matches
from segqa.operators.translation import Reviewer
from segqa.plans.scale import CHUNK, number_rows, running_offsets, skew_join

KEYS = ["job_id", "segment_id"]
QUEUE_DEFAULT = ("critical", "major", "warning")


def review(
    pairs: DataFrame, reviewer: Reviewer, config: JobConfig, memory: DataFrame | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Review ``pairs(job_id, segment_id, source_text, translation, ...)``.

    The trusted phrase memory is applied before the review; when it is switched off its
    phrases become findings after it. Segments in ``existing`` are left out.
    """
    rows = pairs if existing is None else pairs.join(existing.select(*KEYS), KEYS, "left_anti")

    def flat(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "translated_text": F.col("translation.translated_text"), "confidence": F.col("translation.confidence")
        })

    if memory is not None and config.use_user_phrase_memory:
        rows = phrase_apply(phrase_matches(flat(rows), memory, config)).drop("matches")
    else:
        rows = rows.withColumn("applied", F.expr("cast(array() as array<string>)"))
    reviewed = reviewer.review(flat(rows))
    if memory is not None and not config.use_user_phrase_memory:
        reviewed = add_phrase_findings(phrase_matches(reviewed, memory, config)).drop("matches")
    return reviewed.drop("translated_text", "confidence")


def explode_findings(reviews: DataFrame) -> DataFrame:
    """One row per finding, numbered within its segment."""
    # The outer form keeps the planner from computing the array a second time to test it.
    rows = reviews.select(*KEYS, F.posexplode_outer("findings").alias("pos", "f"))
    return rows.where(F.col("f").isNotNull()).select(*KEYS, "pos", "f.*")


def resolve(
    segments: DataFrame, issues: DataFrame, findings: DataFrame, attempts: DataFrame, config: JobConfig
) -> DataFrame:
    """Segments that are ``unresolved`` and/or ``revise`` (R4); others do not appear.

    Issues, findings, attempts and the strict-mode rule are stacked and reduced in one
    pre-aggregated group-by per segment.
    """
    none = F.lit(None).cast("boolean")

    def part(df: DataFrame, critical=none, blocking=none, proposal=none, phrase=none, strict=none, n=F.lit(0)) -> DataFrame:
        return df.select(
            *KEYS, critical.alias("critical"), blocking.alias("blocking"), proposal.alias("proposal"),
            phrase.alias("phrase"), strict.alias("strict"), n.cast("int").alias("n"),
        )

    yes = F.lit(True)
    parts = [
        part(issues.where(F.col("severity") == "critical"), critical=yes),
        part(
            findings.where(is_blocking(F.col("severity"))),
            blocking=yes,
            proposal=F.coalesce(F.col("proposed_translation") != "", F.lit(False)),
            phrase=F.coalesce(F.col("category") == "user_phrase_memory", F.lit(False)),
        ),
        part(attempts, n=F.col("n")),
    ]
    if config.mode == "strict_regulatory":
        strict = (F.col("block_type") == "table_cell") | F.lower("source_text").contains("regulation")
        parts.append(part(segments.where(strict), strict=yes))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    per_segment = stacked.groupBy(*KEYS).agg(
        F.bool_or("critical").alias("critical"),
        F.bool_or("blocking").alias("blocking"),
        F.bool_and("proposal").alias("proposal"),
        F.bool_or("phrase").alias("phrase"),
        F.bool_or("strict").alias("strict"),
        F.max("n").alias("n"),
    )
    blocked = F.coalesce("blocking", F.lit(False))
    can_revise = blocked & F.col("proposal") & ~F.col("phrase") & (F.col("n") < config.max_revision_attempts)
    flagged = F.coalesce("critical", F.lit(False)) | F.coalesce("strict", F.lit(False))
    return per_segment.select(
        *KEYS,
        (flagged | (blocked & ~F.coalesce(can_revise, F.lit(False)))).alias("unresolved"),
        F.coalesce(can_revise, F.lit(False)).alias("revise"),
    ).where(F.col("unresolved") | F.col("revise"))


def segment_issues(issues: DataFrame, findings: DataFrame) -> DataFrame:
    """Issues and findings in one shape."""
    return issues.select(
        *KEYS, F.lit("issue").alias("origin"), "severity", F.col("issue_type").alias("type"), "message",
        F.lit(None).cast("string").alias("proposed_translation"), F.col("translated_value").alias("translation_evidence"),
    ).unionByName(findings.select(
        *KEYS, F.lit("finding").alias("origin"), "severity", F.col("category").alias("type"),
        F.col("explanation").alias("message"), "proposed_translation", "translation_evidence",
    ))


def findings_table(findings: DataFrame, segments: DataFrame, translations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Findings with evidence and shortened texts.

    ``number`` counts the findings of a job from 1 in segment order; the newest-first
    view is the descending order of ``number``.
    """
    seg = segments.select(*KEYS, "page_number", "order_index", "source_text")
    known = seg.join(translations.select(*KEYS, "translated_text"), KEYS, "left")
    rows = skew_join(findings, known, KEYS, "left", spread_by=["pos"])

    def evidence(column: str, whole: str) -> Column:
        return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.col(whole))

    # Findings of earlier segments, plus the place among the findings of the own segment;
    # both are counted in chunks, so neither a long job nor a crowded segment is one task.
    placed = rows.withColumn("__at", F.coalesce("order_index", F.lit(-1)).cast("long"))
    inside = number_rows(placed, ["job_id", "__at"], F.col("pos"), ["pos", "segment_id"], "__in", chunk)
    sizes = placed.groupBy("job_id", "__at").agg(F.count(F.lit(1)).alias("__n"))
    earlier = running_offsets(sizes, ["job_id"], "__at", "__n", "__before", chunk).drop("__n")
    numbered = skew_join(inside, earlier, ["job_id", "__at"], "inner", spread_by=["pos"], counts=sizes.withColumnRenamed("__n", "n")) \
        .withColumn("number", F.col("__in") + F.col("__before"))
    return numbered.select(
        "job_id",
        (F.col("number") + 1).alias("number"),
        "segment_id",
        "page_number",
        "severity",
        "category",
        short_text(evidence("source_evidence", "source_text"), 220).alias("source"),
        short_text(evidence("translation_evidence", "translated_text"), 260).alias("translation"),
        short_text(F.col("explanation"), 320).alias("explanation"),
        short_text(F.col("proposed_translation"), 260).alias("proposal"),
        F.coalesce("confidence", F.lit("-")).alias("confidence"),
    )


def review_queue(
    unresolved: DataFrame, items: DataFrame, limit: int = 10, severities: list[str] | None = None
) -> DataFrame:
    """The first ``limit`` unresolved segments per job to look at, by segment id (R11); ``limit`` is taken as given.

    ``items`` are the rows of :func:`segment_issues`. A segment qualifies when it has no
    item or one of a selected severity. The default selection is critical, major and
    warning as far as present among the job's unresolved segments, or else everything.
    """
    if limit < 1:
        raise ValueError("a queue needs room for one segment")
    chosen = list(severities) if severities else list(QUEUE_DEFAULT)
    severity = F.lower("severity")
    # Only unresolved segments matter; one row per segment before anything is ranked.
    flags = items.groupBy(*KEYS).agg(F.bool_or(severity.isin(*chosen)).alias("hit"))
    rows = unresolved.select(*KEYS).join(flags, KEYS, "left")
    wanted = F.col("hit").isNull() | F.col("hit")
    if severities:
        candidates = rows.withColumn("first", wanted).where(wanted)
    else:
        candidates = rows.withColumn("first", wanted)
    # row_number with a limit is cut per task before the shuffle, so a job of any size
    # sends at most ``limit`` rows per task and group.
    by_id = W.partitionBy("job_id", "first").orderBy("segment_id")
    short = candidates.withColumn("__rn", F.row_number().over(by_id)).where(F.col("__rn") <= limit)
    if not severities:
        # At most 2 * limit rows per job are left here.
        present = rows.groupBy("job_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("any_hit"))
        short = short.join(present, "job_id").where(F.col("first") | ~F.col("any_hit"))
    ranked = W.partitionBy("job_id").orderBy("segment_id")
    return short.withColumn("queue_pos", F.row_number().over(ranked)).where(F.col("queue_pos") <= limit).select(
        *KEYS, "queue_pos"
    )


def no_findings() -> Column:
    return F.expr(f"cast(array() as array<{FINDING_TYPE}>)")
