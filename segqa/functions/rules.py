"""Rule-based translation and review columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from segqa.functions.glossary import glossary_replace, strings
from segqa.functions.locale import apply_locale
from segqa.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, let, strip_ws
from segqa.sources.glossary import Term

USAGE_TYPE = (
    "struct<provider:string,model:string,operation:string,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>"
)
TRANSLATION_TYPE = (
    "struct<translated_text:string,uncertain_terms:array<string>,source_terms_retained:array<string>,"
    f"translator_notes:array<string>,confidence:string,token_usage:{USAGE_TYPE}>"
)
FINDING_TYPE = (
    "struct<severity:string,category:string,source_evidence:string,translation_evidence:string,"
    "explanation:string,proposed_translation:string,confidence:string>"
)

# Ordered whole-word rewrites of the rule translator.
PHRASE_RULES = (
    ("No specific migration was detected", "Nie wykryto migracji specyficznej"),
    ("No migration was detected", "Nie wykryto migracji"),
    ("was below", "była poniżej"),
    ("were below", "były poniżej"),
    ("at", "w temperaturze"),
    ("for", "przez"),
    ("days", "dni"),
    ("day", "dzień"),
    ("hours", "godzin"),
    ("hour", "godzinę"),
    ("Result", "Wynik"),
    ("Limit", "Limit"),
    ("Method", "Metoda"),
    ("Substance", "Substancja"),
    ("Test conditions", "Warunki badania"),
    ("Declaration of compliance", "Deklaracja zgodności"),
    ("Compliant", "Zgodny"),
    ("Not detected", "Nie wykryto"),
)
# Words that make a text look English, and texts the rules write.
_ENGLISH = rf"(?iu){NOT_AFTER_WORD}(?:the|and|of|was|were|for|with|migration|detected|compliance){NOT_BEFORE_WORD}"
RULE_NOTE = "mock translator - use real provider for production documents"
UNKNOWN_TERM = "untranslated_or_unknown_segment"
PROPOSAL_NOTE = "Applied reviewer proposal."


def _whole_word(phrase: str) -> str:
    return rf"(?iu){NOT_AFTER_WORD}{phrase}{NOT_BEFORE_WORD}"


def phrase_rules(text: Column) -> Column:
    """The ordered rewrites (X2); texts that hold none of the phrases skip the chain."""
    result = text
    for phrase, replacement in PHRASE_RULES:
        result = F.regexp_replace(result, _whole_word(phrase), replacement)
    any_phrase = _whole_word("(?:" + "|".join(p for p, _ in PHRASE_RULES) + ")")
    return F.when(text.rlike(any_phrase), result).otherwise(text)


def looks_english(text: Column) -> Column:
    return text.rlike(_ENGLISH)


def same_text(left: Column, right: Column) -> Column:
    return F.lower(strip_ws(left)) == F.lower(strip_ws(right))


def untranslated(source: Column, translated: Column) -> Column:
    """Looks English and left as it was."""
    return looks_english(translated) & same_text(translated, source)


def translation(
    text: Column, notes: Column, confidence: Column, uncertain: Column | None = None,
    retained: Column | None = None, usage: Column | None = None,
) -> Column:
    return F.struct(
        text.alias("translated_text"),
        (strings([]) if uncertain is None else uncertain).alias("uncertain_terms"),
        (strings([]) if retained is None else retained).alias("source_terms_retained"),
        notes.alias("translator_notes"),
        confidence.alias("confidence"),
        (F.lit(None).cast(USAGE_TYPE) if usage is None else usage).alias("token_usage"),
    )


def relocale(value: Column, target_language: str) -> Column:
    """A translation struct after target-locale formatting."""
    done = apply_locale(value["translated_text"], value["translator_notes"], target_language)
    return let(
        done,
        lambda d: translation(
            d["translated_text"], d["translator_notes"], value["confidence"], value["uncertain_terms"],
            value["source_terms_retained"], value["token_usage"],
        ),
    )


def rule_translate(source: Column, terms: Sequence[Term], target_language: str = "Polish") -> Column:
    """Deterministic translation struct: glossary, phrase rules, flag, locale."""
    def flagged(text: Column) -> Column:
        unknown = untranslated(source, text)
        return translation(
            text,
            strings([RULE_NOTE]),
            F.when(unknown, F.lit("low")).otherwise(F.lit("high")),
            F.when(unknown, strings([UNKNOWN_TERM])).otherwise(strings([])),
        )

    rules = let(glossary_replace(source, terms), phrase_rules)
    return let(let(rules, flagged), lambda t: relocale(t, target_language))


def finding(
    severity: Column, category: Column, source: Column, target: Column, explanation: Column,
    proposal: Column | None = None, confidence: str = "high",
) -> Column:
    return F.struct(
        severity.alias("severity"),
        category.alias("category"),
        source.alias("source_evidence"),
        target.alias("translation_evidence"),
        explanation.alias("explanation"),
        (F.lit(None).cast("string") if proposal is None else proposal).alias("proposed_translation"),
        F.lit(confidence).alias("confidence"),
    )


def rule_findings(source: Column, target: Column, confidence: Column) -> Column:
    """Findings of the rule reviewer (R1): doubtful translations and unchanged English."""
    low = finding(
        F.lit("major"), F.lit("untranslated_fragment"), source, target,
        F.lit("Tłumaczenie wygląda jak nieprzetłumaczony fragment źródłowy."),
    )
    unchanged = finding(
        F.lit("major"), F.lit("unchanged_source"), source, target,
        F.lit("Fragment angielski został pozostawiony bez tłumaczenia."),
    )
    return F.array_compact(F.array(
        F.when(confidence == "low", low),
        F.when(same_text(source, target) & looks_english(source), unchanged),
    ))


def is_blocking(severity: Column) -> Column:
    return severity.isin("critical", "major")


def verdict(findings: Column) -> Column:
    """human_review on any critical or major finding, revise on any other, else accept (R2)."""
    blocking = F.exists(findings, lambda f: is_blocking(f["severity"]))
    return (
        F.when(blocking, F.lit("human_review"))
        .when(F.size(findings) > 0, F.lit("revise"))
        .otherwise(F.lit("accept"))
    )


def merge_verdict(findings: Column, fallback: Column) -> Column:
    """Verdict after adding findings to a review that already has one (H5)."""
    blocking = F.exists(findings, lambda f: is_blocking(f["severity"]))
    return (
        F.when(blocking, F.lit("human_review"))
        .when((F.size(findings) > 0) & (fallback == "accept"), F.lit("revise"))
        .otherwise(fallback)
    )
