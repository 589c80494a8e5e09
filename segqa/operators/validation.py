"""Source/translation pair validation (V1-V7).

Every rule reads one pair and nothing else, so the issues of a pair are one array
expression, and equal pairs are validated once (:mod:`segqa.operators.pairs`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.functions.glossary import relevant_terms
from segqa.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, is_polish_name, let
from segqa.functions.tokens import extract_tokens, key_count, token_key
from segqa.operators.pairs import KEY, TEXTS, back_to_rows, distinct_pairs, keyed
from segqa.plans.scale import materialize
from segqa.sources.glossary import Term

ISSUE = "struct<severity:string,issue_type:string,source_value:string,translated_value:string,message:string>"
NO_ISSUES = f"cast(array() as array<{ISSUE}>)"

# How a lost token of each kind is reported.
ISSUE_TYPE = {"number": "missing_number", "unit": "missing_unit", "comparator": "changed_comparator"}
OTHER_ISSUE_TYPE = "missing_reference"
WARNING_KINDS = ("abbreviation", "formula")
ADDITION_KINDS = ("number", "unit", "comparator")

# Negating words looked for in the source and in the translation.
_SOURCE_NEGATION = (
    rf"{NOT_AFTER_WORD}(?:no|not|none|without|does{WS}+not|did{WS}+not|was{WS}+not|were{WS}+not){NOT_BEFORE_WORD}"
)
_TARGET_NEGATION = (
    rf"{NOT_AFTER_WORD}(?:nie|brak|bez|żaden|zadna|żadna|niewykryto|nie{WS}+wykryto){NOT_BEFORE_WORD}"
)


def issue(severity: Column, issue_type: Column, source: Column, target: Column, message: Column) -> Column:
    return F.struct(
        severity.alias("severity"),
        issue_type.alias("issue_type"),
        source.cast("string").alias("source_value"),
        target.cast("string").alias("translated_value"),
        message.alias("message"),
    )


def _keys(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: token_key(t["kind"], t["normalized"]))


def _surplus(tokens: Column, keys: Column, other_keys: Column, build) -> Column:
    """One issue per distinct key that is more frequent in ``keys`` than in ``other_keys``.

    The issue shows the first token with that key.
    """
    more = F.filter(F.array_distinct(keys), lambda k: key_count(keys, k) > key_count(other_keys, k))
    return F.transform(more, lambda k: build(F.get(tokens, F.array_position(keys, k).cast("int") - 1)))


def _missing(token: Column) -> Column:
    kind = token["kind"]
    issue_type = F.lit(OTHER_ISSUE_TYPE)
    for name, value in ISSUE_TYPE.items():
        issue_type = F.when(kind == name, F.lit(value)).otherwise(issue_type)
    severity = F.when(kind.isin(*WARNING_KINDS), F.lit("warning")).otherwise(F.lit("critical"))
    message = F.format_string("Chroniony element '%s' (%s) nie występuje w tłumaczeniu.", token["text"], kind)
    return issue(severity, issue_type, token["text"], F.lit(None), message)


def _added(token: Column) -> Column:
    message = F.format_string(
        "Tłumaczenie dodało chroniony element '%s' (%s), którego nie było w źródle.", token["text"], token["kind"]
    )
    return issue(F.lit("critical"), F.lit("unexpected_addition"), F.lit(None), token["text"], message)


def token_issues(source_tokens: Column, target_tokens: Column) -> Column:
    """Lost tokens (V1) followed by added ones (V2)."""
    def compare(pair: Column) -> Column:
        def build(keys: Column) -> Column:
            lost = _surplus(pair["s"], keys["s"], keys["t"], _missing)
            countable = F.filter(pair["t"], lambda t: t["kind"].isin(*ADDITION_KINDS))
            added = let(countable, lambda c: _surplus(c, _keys(c), keys["s"], _added))
            return F.concat(lost, added)

        return let(F.struct(_keys(pair["s"]).alias("s"), _keys(pair["t"]).alias("t")), build)

    return let(F.struct(source_tokens.alias("s"), target_tokens.alias("t")), compare)


def has_source_negation(text: Column) -> Column:
    return F.lower(text).rlike(_SOURCE_NEGATION)


def has_target_negation(text: Column) -> Column:
    return F.lower(text).rlike(_TARGET_NEGATION)


def negation_issues(source: Column, target: Column) -> Column:
    """A negated source whose translation negates nothing (V3), whatever the target language."""
    message = F.lit("Źródło zawiera negację, której nie widać w tłumaczeniu.")
    found = issue(F.lit("critical"), F.lit("missing_negation"), source, target, message)
    return F.when(has_source_negation(source) & ~has_target_negation(target), F.array(found)).otherwise(F.expr(NO_ISSUES))


def glossary_issues(source: Column, target: Column, terms: Sequence[Term], target_language: str = "Polish") -> Column:
    """Unapproved (V5) and forbidden (V6) wordings of the terms in the source; Polish targets only."""
    if not is_polish_name(target_language) or not terms:
        return F.expr(NO_ISSUES)

    def per_term(term: Column, low: Column) -> Column:
        approved = F.exists(term["accepted"], lambda a: F.contains(low, a))
        unapproved = issue(
            F.lit("warning"), F.lit("untranslated_fragment"), term["source"], target,
            F.format_string("Termin '%s' nie używa zatwierdzonego odpowiednika '%s'.", term["source"], term["preferred"]),
        )
        used = F.filter(term["forbidden"], lambda f: F.contains(low, f["low"]))
        forbidden = F.transform(used, lambda f: issue(
            F.lit("warning"), F.lit("forbidden_term"), term["source"], f["text"],
            F.format_string("Termin '%s' jest zabroniony dla '%s'.", f["text"], term["source"]),
        ))
        return F.concat(F.when(approved, F.expr(NO_ISSUES)).otherwise(F.array(unapproved)), forbidden)

    def build(found: Column) -> Column:
        issues = let(F.lower(target), lambda low: F.flatten(F.transform(found, lambda t: per_term(t, low))))
        return F.when(F.size(found) > 0, issues).otherwise(F.expr(NO_ISSUES))

    return let(relevant_terms(source, terms), build)


def pair_issues(
    source: Column, target: Column, terms: Sequence[Term] = (), target_language: str = "Polish",
    source_tokens: Column | None = None,
) -> Column:
    """All issues of one pair, in rule order (V1, V2, V3, V5, V6)."""
    tokens = extract_tokens(source) if source_tokens is None else source_tokens
    return F.concat(
        token_issues(tokens, extract_tokens(target)),
        negation_issues(source, target),
        glossary_issues(source, target, terms, target_language),
    )


def explode_issues(pairs: DataFrame, issues: Column, *keys: str) -> DataFrame:
    # The outer form keeps the planner from computing the array a second time to test it.
    rows = pairs.select(*(keys or ("job_id", "segment_id")), F.inline_outer(issues))
    return rows.where(F.col("severity").isNotNull())


def missing_tokens(pairs: DataFrame) -> DataFrame:
    issues = token_issues(extract_tokens(F.col("source_text")), extract_tokens(F.col("translated_text")))
    lost = F.filter(issues, lambda i: i["issue_type"] != "unexpected_addition")
    return explode_issues(pairs, lost)


def unexpected_additions(pairs: DataFrame) -> DataFrame:
    issues = token_issues(extract_tokens(F.col("source_text")), extract_tokens(F.col("translated_text")))
    added = F.filter(issues, lambda i: i["issue_type"] == "unexpected_addition")
    return explode_issues(pairs, added)


def validate_pairs(pairs: DataFrame, terms: Sequence[Term], target_language: str = "Polish") -> DataFrame:
    """Issues of ``pairs(job_id, segment_id, source_text, translated_text)``, one row each (V7).

    Equal pairs are validated once. Pairs that come with ``protected_tokens`` may differ in these
    and are validated row by row.
    """
    if "protected_tokens" in pairs.columns:
        source, given = F.col("source_text"), F.col("protected_tokens")
        tokens = F.when(F.size(given) > 0, given).otherwise(extract_tokens(source))
        return explode_issues(pairs, pair_issues(source, F.col("translated_text"), terms, target_language, tokens))
    rows = keyed(pairs.select("job_id", "segment_id", *TEXTS))
    issues = pair_issues(*map(F.col, TEXTS), terms, target_language)
    # Pairs without issues are kept for their counts.
    judged = materialize(distinct_pairs(rows).select(KEY, "n", issues.alias("issues")))
    found = judged.where(F.size("issues") > 0).select(KEY, "issues")
    return explode_issues(back_to_rows(rows.select("job_id", "segment_id", KEY), found, judged, "inner"), F.col("issues"))


def validate(
    segments: DataFrame, translations: DataFrame, terms: Sequence[Term], target_language: str = "Polish"
) -> DataFrame:
    """Issues of the segments that have a translation."""
    pairs = segments.join(
        translations.select("job_id", "segment_id", "translated_text"), ["job_id", "segment_id"]
    )
    return validate_pairs(pairs, terms, target_language)
