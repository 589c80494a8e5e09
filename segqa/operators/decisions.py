"""Operator decisions: build, apply, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.functions.rules import translation
from segqa.functions.text import normalize_ws, strip_ws

KEYS = ["job_id", "segment_id"]
# Actions that can be saved and the notes they leave.
ACTIONS = ("accept", "edit", "keep_source")
ACTION_NOTES = {
    "keep_source": "Operator kept source text.",
    "edit": "Operator edited translation.",
    "accept": "Operator accepted translation.",
}
REFINED_PREFIXES = ("Fragment poprawiony przez użytkownika:", "User-refined fragment:")


def build_decisions(raw: DataFrame) -> DataFrame:
    """Decisions from ``raw(job_id, segment_id, action, edited_text, original_text, note)``.

    Rows the operator did not touch drop out: no savable action, no change beyond
    whitespace and no note. A changed text is an edit unless the source is kept.
    """
    text = F.coalesce("edited_text", F.lit(""))
    note = strip_ws(F.coalesce("note", F.lit("")))
    changed = normalize_ws(F.col("edited_text")) != normalize_ws(F.col("original_text"))
    saved = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    action = (
        F.when(changed & ~F.coalesce(F.col("action") == "keep_source", F.lit(False)), F.lit("edit"))
        .when(saved, F.col("action"))
        .otherwise(F.lit("edit"))
    )
    return raw.where(saved | changed | (note != "")).select(
        *KEYS, action.alias("action"), text.alias("text"), F.when(note != "", note).alias("note")
    )


def auto_accept(unresolved: DataFrame) -> DataFrame:
    """An accept decision for every unresolved segment."""
    none = F.lit(None).cast("string")
    return unresolved.select(*KEYS, F.lit("accept").alias("action"), none.alias("text"), none.alias("note"))


def _decided(decisions: DataFrame, translations: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Decisions that count: on translated and unresolved segments."""
    return decisions.join(translations.select(*KEYS), KEYS, "left_semi").join(unresolved.select(*KEYS), KEYS, "left_semi")


def apply_decisions(
    segments: DataFrame, translations: DataFrame, unresolved: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Translations after the decisions, and the segments still unresolved."""
    decided = _decided(decisions, translations, unresolved)
    rows = (
        translations.join(decided, KEYS, "left")
        .join(segments.select(*KEYS, F.col("source_text").alias("__source")), KEYS, "left")
    )
    value, action = F.col("translation"), F.col("action")
    effective = (action != "edit") | F.col("text").isNotNull()
    text = (
        F.when(action == "keep_source", F.col("__source"))
        .when(action == "edit", F.col("text"))
        .otherwise(value["translated_text"])
    )
    label: Column = F.lit(None).cast("string")
    for name, words in ACTION_NOTES.items():
        label = F.when(action == name, F.lit(words)).otherwise(label)
    extra = F.array_compact(F.array(label, F.when(F.col("note") != "", F.col("note"))))
    confidence = F.when(action == "keep_source", F.lit("medium")).otherwise(F.lit("high"))
    decided_value = translation(
        text, F.concat(value["translator_notes"], extra), confidence, value["uncertain_terms"],
        value["source_terms_retained"], value["token_usage"],
    )
    after = rows.withColumn(
        "translation", F.when(action.isNotNull() & effective, decided_value).otherwise(value)
    ).select(*translations.columns)
    remaining = unresolved.join(decided.select(*KEYS), KEYS, "left_anti")
    return after, remaining


def is_reversible_note(note: Column) -> Column:
    known = note.isin(*ACTION_NOTES.values())
    for prefix in REFINED_PREFIXES:
        known = known | note.startswith(prefix)
    return known


def undo_decisions(
    segments: DataFrame, translations: DataFrame, unresolved: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Take decisions back (R8): notes removed, confidence medium, segments unresolved again.

    Edited texts stay as they are. The unresolved list carries ``order_index`` for its
    order, nulls last: ids without a segment have none. The caller clears outputs and sets
    the job to needs_human_review.
    """
    undone = decisions.select(*KEYS).distinct().withColumn("__undo", F.lit(True))
    rows = translations.join(undone, KEYS, "left")
    value = F.col("translation")
    kept = F.filter(value["translator_notes"], lambda n: ~is_reversible_note(n))
    reopened = translation(
        value["translated_text"], kept, F.lit("medium"), value["uncertain_terms"],
        value["source_terms_retained"], value["token_usage"],
    )
    after = rows.withColumn("translation", F.when(F.col("__undo"), reopened).otherwise(value)).select(
        *translations.columns
    )
    known = segments.select(*KEYS, "order_index")
    back = undone.select(*KEYS).join(known, KEYS)
    return after, unresolved.select(*KEYS).join(known, KEYS, "left").unionByName(back).distinct()
