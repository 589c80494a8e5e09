"""Corpus runs: translate, review, resolve, revise, decide, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.config import JobConfig
from segqa.functions.rules import USAGE_TYPE
from segqa.operators.decisions import apply_decisions
from segqa.operators.memory import cache_key, cache_rows, cache_scope, cache_touch, cache_upsert, scope_hash, translate_corpus
from segqa.operators.phrases import phrase_touch
from segqa.operators.reports import audit_report, job_routing, verify_output
from segqa.operators.review import explode_findings, resolve, review
from segqa.operators.segments import protect
from segqa.operators.translation import Reviewer, Translator, revise
from segqa.operators.validation import validate_pairs
from segqa.plans.scale import materialize
from segqa.sources.glossary import Term

KEYS = ["job_id", "segment_id"]


@dataclass(frozen=True)
class RunState:
    """The tables of a run. ``work`` holds one row per translated segment:
    job_id, segment_id, source_text, block_type, translation, findings, verdict, review_usage, applied, attempts."""

    work: DataFrame
    issues: DataFrame
    findings: DataFrame
    unresolved: DataFrame


@dataclass(frozen=True)
class _Protecting:
    """Shows a reviewer the protected tokens of the source; they follow from it and are not kept with the work."""

    reviewer: Reviewer

    def review(self, pairs: DataFrame) -> DataFrame:
        return self.reviewer.review(protect(pairs)).drop("protected_tokens")


def _pairs(work: DataFrame) -> DataFrame:
    return work.withColumn("translated_text", F.col("translation.translated_text"))


def _judge(
    work: DataFrame, terms: Sequence[Term], config: JobConfig, before: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues, findings and routes. With ``before``, the last issues of the same jobs and the keys of what has been
    revised since, only that is validated again: an issue depends on its pair alone."""
    if before is None:
        issues = validate_pairs(_pairs(work), terms, config.target_language)
    else:
        known, changed = before
        again = validate_pairs(_pairs(work.join(changed, KEYS, "left_semi")), terms, config.target_language)
        issues = known.join(changed, KEYS, "left_anti").unionByName(again)
    issues = materialize(issues)
    findings = explode_findings(work)
    attempts = work.where(F.col("attempts") > 0).select(*KEYS, F.col("attempts").alias("n"))
    return issues, findings, materialize(resolve(work, issues, findings, attempts, config))


def review_loop(
    work: DataFrame, terms: Sequence[Term], translator: Translator, reviewer: Reviewer, config: JobConfig,
    memory: DataFrame | None = None,
) -> RunState:
    """Validate, resolve and revise for at most ``max_revision_attempts + 1`` cycles.

    ``work`` comes reviewed. A job goes into the next cycle only if one of its segments
    was revised; there all its segments are reviewed and judged again, and those of all
    other jobs keep what the last cycle found. The tables of a cycle are written down, so
    the plan does not grow with the cycles.
    """
    if "review_usage" not in work.columns:
        work = work.withColumn("review_usage", F.lit(None).cast(USAGE_TYPE))
    cycles = config.max_revision_attempts + 1
    settled: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    before = None
    for cycle in range(1, cycles + 1):
        work = materialize(work)
        issues, findings, routes = _judge(work, terms, config, before)
        unresolved = routes.where("unresolved").select(*KEYS)
        to_revise = routes.where("revise").select(*KEYS)
        if to_revise.isEmpty():
            break
        flagged = work.join(to_revise, KEYS, "left_semi").select(*KEYS, "source_text", "translation", "attempts")
        revised = materialize(revise(flagged, findings, translator, config.target_language).select(
            *KEYS, F.col("translation").alias("__t"), F.col("attempts").alias("__a")
        ))

        def with_revised(rows: DataFrame, made: DataFrame = revised) -> DataFrame:
            return rows.join(made, KEYS, "left").withColumns({
                "translation": F.coalesce("__t", "translation"), "attempts": F.coalesce("__a", "attempts")
            }).drop("__t", "__a")

        if cycle == cycles:
            # No cycle is left to judge these revisions; the last judgement stands.
            work = with_revised(work)
            break
        active = materialize(to_revise.select("job_id").distinct())
        settled.append(tuple(t.join(active, "job_id", "left_anti") for t in (work, issues, unresolved)))
        again = with_revised(work.join(active, "job_id", "left_semi"))
        work = review(again.drop("findings", "verdict", "applied", "review_usage"), reviewer, config, memory)
        # A trusted phrase memory may change any text of the jobs anew; a reviewer changes none.
        rewritten = memory is not None and config.use_user_phrase_memory
        before = None if rewritten else (issues.join(active, "job_id", "left_semi"), revised.select(*KEYS))
    for rows, earlier_issues, earlier_unresolved in settled:
        work = work.unionByName(rows.select(*work.columns))
        issues = issues.unionByName(earlier_issues.select(*issues.columns))
        unresolved = unresolved.unionByName(earlier_unresolved.select(*KEYS))
    return RunState(work, issues, explode_findings(work), unresolved)


def run_corpus(
    segments: DataFrame, translations: DataFrame, cache: DataFrame, terms: Sequence[Term], translator: Translator,
    reviewer: Reviewer, config: JobConfig, memory: DataFrame | None = None,
) -> tuple[RunState, DataFrame]:
    """From segments to resolved findings, for all jobs at once; also returns the routed rows."""
    routed = materialize(translate_corpus(segments, translations, cache, translator, config))
    kinds = segments.select(*KEYS, "block_type")
    pairs = routed.select(*KEYS, "order_index", "source_text", "translation").join(kinds, KEYS)
    reviewer = _Protecting(reviewer)
    work = review(pairs, reviewer, config, memory).withColumn("attempts", F.lit(0))
    return review_loop(work, terms, translator, reviewer, config, memory), routed


def report(segments: DataFrame, state: RunState, routed: DataFrame) -> DataFrame:
    usages = state.work.select("job_id", F.explode(F.array("translation.token_usage", "review_usage")).alias("token_usage"))
    hits = state.work.where(F.size("applied") > 0).select("job_id", F.size("applied").alias("n"))
    return audit_report(segments, state.unresolved, state.issues, state.findings, routed, usages, hits)


def store_translations(routed: DataFrame, cache: DataFrame, config: JobConfig, now: Column) -> DataFrame:
    """The cache after a run: what it translated is stored, and every reuse between jobs counts as a hit."""
    scope = cache_scope(config)
    made = routed.where("route = 'miss'").select(*KEYS, "source_text", "translation")
    stored = cache_upsert(cache, cache_rows(made, scope, now))
    reused = routed.where("route = 'persistent' and norm <> ''")
    key = cache_key(F.col("norm"), F.lit(scope_hash(scope)))
    return cache_touch(stored, reused.select(key.alias("cache_key"), now.alias("used_at")))


def touch_phrases(state: RunState, memory: DataFrame, now: Column) -> DataFrame:
    """The phrase memory after a run: every phrase that changed a translation counts as used."""
    return phrase_touch(memory, state.work.select(F.explode("applied").alias("cache_key"), now.alias("used_at")))


def remaining(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments that an interrupted run has still to do, given the rows it has written."""
    return segments.join(done.select(*KEYS).distinct(), KEYS, "left_anti")


def finish(segments: DataFrame, state: RunState, routed: DataFrame, outputs: DataFrame) -> DataFrame:
    """The report of every job with the check of its output text and its next step.

    Jobs without an output text have null there. Run it on a finalized state.
    """
    texts = state.work.select(*KEYS, "translation.translated_text")
    checked = verify_output(outputs, texts).select("job_id", F.col("ok").alias("output_ok"), "missing_segments", "placeholder_leaks")
    open_now = state.unresolved.groupBy("job_id").agg(F.count(F.lit(1)).alias("unresolved"))
    joined = report(segments, state, routed).join(checked, "job_id", "left").join(open_now, "job_id", "left")
    counted = joined.withColumns({"unresolved": F.coalesce("unresolved", F.lit(0)), "revise": F.lit(0)})
    return counted.withColumn("next_step", job_routing(True)).drop("unresolved", "revise")


def finalize(state: RunState, decisions: DataFrame) -> RunState:
    """Apply operator decisions; jobs with nothing left unresolved are ready for output."""
    after, remaining = apply_decisions(state.work, state.work, state.unresolved, decisions)
    return RunState(after, state.issues, state.findings, remaining)
