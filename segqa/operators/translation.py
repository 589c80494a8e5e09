"""Translator and reviewer plugs, revision and prompt payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segqa.config import JobConfig
from segqa.functions.glossary import prompt_block, strings
from segqa.functions.rules import (
    FINDING_TYPE,
    PROPOSAL_NOTE,
    TRANSLATION_TYPE,
    USAGE_TYPE,
    relocale,
    rule_findings,
    rule_translate,
    translation,
    verdict,
)
from segqa.functions.text import let
from segqa.operators.answers import RETRIES, TIMEOUT, AnswerLog, Batch, patient
from segqa.sources.glossary import Term

# Fixed value: what a translator is told to do with a segment under revision.
REVISE_INSTRUCTION = "Revise only the material issues. Preserve protected tokens."


class Translator(Protocol):
    """Adds a ``translation`` struct to rows that have ``segment_id`` and ``source_text``."""

    def translate(self, rows: DataFrame) -> DataFrame: ...


class Reviewer(Protocol):
    """Adds ``findings``, ``verdict`` and ``review_usage`` to pairs with ``translated_text`` and ``confidence``."""

    def review(self, pairs: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RuleTranslator:
    terms: Sequence[Term] = ()
    target_language: str = "Polish"

    def translate(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("translation", rule_translate(F.col("source_text"), self.terms, self.target_language))


@dataclass(frozen=True)
class RuleReviewer:
    def review(self, pairs: DataFrame) -> DataFrame:
        found = rule_findings(F.col("source_text"), F.col("translated_text"), F.col("confidence"))
        usage = F.lit(None).cast(USAGE_TYPE)
        return pairs.withColumn("findings", found).withColumn("verdict", verdict(F.col("findings"))).withColumn("review_usage", usage)


def _call_in_batches(
    rows: DataFrame, open_client: Callable[[], Batch], schema: str, optional: str, calls: int | None,
    timeout: float, retries: int, answers: AnswerLog | None,
) -> DataFrame:
    """Send rows through an external client, one client per task, opened on the first row.

    The client returns one row per input row, in order; input columns, the segment id
    among them, are always taken from the input. Columns of ``optional`` that it leaves out
    are null. ``calls`` limits how many tasks call the service at once; without it the
    current partitioning is kept. A call that fails or takes longer than ``timeout`` seconds is made
    again ``retries`` times. With ``answers``, requests that have an answer there are not sent.
    """
    may_lack = T.StructType.fromDDL(optional).fieldNames()
    added = T.StructType.fromDDL(f"{schema}, {optional}")
    names = added.fieldNames()
    out = T.StructType([f for f in rows.schema.fields if f.name not in names] + added.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            if batch.empty:
                continue
            if client is None:
                client = patient(open_client(), timeout, retries)
                client = answers.keep(client) if answers else client
            result = client(batch)
            if len(result) != len(batch):
                raise ValueError("a client must return one row per input row")
            result = result.assign(**{n: None for n in may_lack if n not in result.columns})
            kept = batch.drop(columns=[n for n in names if n in batch.columns])
            yield pd.concat([kept.reset_index(drop=True), result[names].reset_index(drop=True)], axis=1)

    if answers:
        def send(asked: DataFrame) -> DataFrame:
            extra = [f for f in asked.schema.fields if f.name not in rows.columns]
            return asked.mapInPandas(run, T.StructType([f for f in rows.schema.fields if f.name not in names] + extra + added.fields))

        return answers.send_once(rows, send, calls)
    return (rows.repartition(calls) if calls else rows).mapInPandas(run, out)


@dataclass(frozen=True)
class ClientTranslator:
    """Batch translator client: returns translated_text, translator_notes and confidence, and where it
    has them uncertain_terms, source_terms_retained and token_usage (a dict or struct).

    Rows to be revised come with current_translation, review_findings and instruction.
    """

    open_client: Callable[[], Batch]
    target_language: str = "Polish"
    calls: int | None = None
    timeout: float = TIMEOUT
    retries: int = RETRIES
    answers: AnswerLog | None = None

    def translate(self, rows: DataFrame) -> DataFrame:
        schema = "translated_text string, translator_notes array<string>, confidence string"
        optional = f"uncertain_terms array<string>, source_terms_retained array<string>, token_usage {USAGE_TYPE}"
        done = _call_in_batches(rows, self.open_client, schema, optional, self.calls, self.timeout, self.retries, self.answers)
        raw = translation(
            F.col("translated_text"), F.col("translator_notes"), F.col("confidence"),
            F.coalesce("uncertain_terms", strings([])), F.coalesce("source_terms_retained", strings([])), F.col("token_usage"),
        )
        return done.withColumn("translation", relocale(raw, self.target_language)).drop(
            "translated_text", "translator_notes", "confidence", "uncertain_terms", "source_terms_retained", "token_usage"
        )


@dataclass(frozen=True)
class ClientReviewer:
    """Batch reviewer client: returns findings as an array of finding structs, and token_usage if it has it."""

    open_client: Callable[[], Batch]
    calls: int | None = None
    timeout: float = TIMEOUT
    retries: int = RETRIES
    answers: AnswerLog | None = None

    def review(self, pairs: DataFrame) -> DataFrame:
        done = _call_in_batches(
            pairs, self.open_client, f"findings array<{FINDING_TYPE}>", f"token_usage {USAGE_TYPE}", self.calls,
            self.timeout, self.retries, self.answers,
        )
        return done.withColumnRenamed("token_usage", "review_usage").withColumn("verdict", verdict(F.col("findings")))


def first_proposals(findings: DataFrame) -> DataFrame:
    """First non-empty proposal per segment, in finding order."""
    given = F.col("proposed_translation") != ""
    return findings.where(given).groupBy("job_id", "segment_id").agg(
        F.min_by("proposed_translation", "pos").alias("proposal")
    )


def revise(
    flagged: DataFrame, findings: DataFrame, translator: Translator, target_language: str = "Polish"
) -> DataFrame:
    """Revise ``flagged(job_id, segment_id, source_text, translation, attempts)``.

    A reviewer proposal replaces the text; segments without one are translated again, and
    the translator sees their current translation, their findings in order and an instruction.
    """
    keys = ["job_id", "segment_id"]
    rows = flagged.withColumnRenamed("translation", "current").join(first_proposals(findings), keys, "left")
    cur = F.col("current")
    proposed = translation(
        F.col("proposal"), F.array_append(cur["translator_notes"], F.lit(PROPOSAL_NOTE)), F.lit("medium"),
        cur["uncertain_terms"], cur["source_terms_retained"], cur["token_usage"],
    )
    with_proposal = rows.where(F.col("proposal").isNotNull()).withColumn(
        "translation", relocale(proposed, target_language)
    )
    fields = T.StructType.fromDDL(f"f {FINDING_TYPE}")["f"].dataType.fieldNames()
    in_order = F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("f"))))
    told = findings.groupBy(*keys).agg(F.transform(in_order, lambda x: x["f"]).alias("review_findings"))
    none = F.expr(f"cast(array() as array<{FINDING_TYPE}>)")
    asked = rows.where(F.col("proposal").isNull()).join(told, keys, "left").withColumns({
        "current_translation": F.col("current"), "review_findings": F.coalesce("review_findings", none),
        "instruction": F.lit(REVISE_INSTRUCTION),
    })
    again = translator.translate(asked).drop("current_translation", "review_findings", "instruction").withColumn(
        "translation", let(F.col("translation"), lambda t: relocale(t, target_language))
    )
    both = with_proposal.unionByName(again)
    return both.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).drop("current", "proposal")


def prompt_payload(segments: DataFrame, terms: Sequence[Term], config: JobConfig, instruction: str | None = None) -> DataFrame:
    """JSON request body per segment (X7); optional translation and findings columns join in."""
    parts = [
        F.lit(config.source_language).alias("source_language"),
        F.lit(config.target_language).alias("target_language"),
        F.lit(config.domain).alias("domain"),
        F.lit(config.mode).alias("mode"),
        F.struct(*[c for c in segments.columns if c not in ("translation", "findings", "job_id")]).alias("segment"),
        prompt_block(terms, config.target_language).alias("glossary"),
    ]
    if "translation" in segments.columns:
        parts.append(F.col("translation").alias("current_translation" if instruction else "translation"))
    if "findings" in segments.columns:
        parts.append(F.col("findings").alias("review_findings"))
    if instruction:
        parts.append(F.lit(instruction).alias("instruction"))
    return segments.select("job_id", "segment_id", F.to_json(F.struct(*parts)).alias("payload"))


def empty_translation() -> Column:
    return F.lit(None).cast(TRANSLATION_TYPE)
