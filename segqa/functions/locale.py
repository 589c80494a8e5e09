"""Locale rewriting columns (L1-L3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segqa.functions.text import NOT_AFTER_WORD, WS, is_decimal_comma_name, let

# The note added by the rewrite, the decimal-dot number pattern and
# the words after which a number is a structural reference.
LOCALE_NOTE = "Localized decimal separator for target locale."
_NUMBER = r"(?=\p{Nd})(?<![\p{L}\p{N}_./-])(?:\p{Nd}{1,3}(?:[ ,]\p{Nd}{3})+|\p{Nd}+)\.\p{Nd}+(?![\p{L}\p{N}_./-])"
_STRUCTURAL = (
    rf"(?iu){NOT_AFTER_WORD}(?:section|sec\.|chapter|clause|table|figure|fig\.|appendix|annex|"
    rf"sekcja|rozdział|tabela|rys\.|rysunek|punkt|pkt\.|ust\.|art\.){WS}*$"
)
_LOOK_BACK = 32


def structural_guard(before: Column) -> Column:
    """True when the text before a number ends in a structural word such as 'section' (L2)."""
    return F.right(before, F.lit(_LOOK_BACK)).rlike(_STRUCTURAL)


def localize_decimals(text: Column) -> Column:
    """Rewrite decimal dots as decimal commas, leaving structural references alone (L1)."""
    t = F.coalesce(text, F.lit(""))

    def rewrite(parts: Column) -> Column:
        """``gaps`` is the text around the numbers found: one more than there are numbers."""
        gaps, found = parts["gaps"], parts["found"]

        def piece(number: Column, index: Column) -> Column:
            before = F.get(gaps, index)
            # ',' groups thousands and '.' is the decimal point in the matched form.
            local = F.translate(number, ",.", " ,")
            return F.concat(before, F.when(structural_guard(before), number).otherwise(local))

        return F.concat(F.array_join(F.transform(found, piece), ""), F.element_at(gaps, -1))

    parts = F.struct(F.split(t, _NUMBER, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(0)).alias("found"))
    return F.when(t.rlike(r"\p{Nd}\.\p{Nd}"), let(parts, rewrite)).otherwise(t)


def with_note(notes: Column, note: Column) -> Column:
    """Append a note once."""
    base = F.coalesce(notes, F.expr("cast(array() as array<string>)"))
    return F.when(F.array_contains(base, note), base).otherwise(F.array_append(base, note))


def apply_locale(text: Column, notes: Column, target_language: str) -> Column:
    """Struct (translated_text, translator_notes) after target-locale formatting (L3)."""
    if not is_decimal_comma_name(target_language):
        return F.struct(text.alias("translated_text"), notes.alias("translator_notes"))

    def build(new: Column) -> Column:
        return F.struct(
            F.when(text.isNull(), text).otherwise(new).alias("translated_text"),
            F.when(new == text, notes).otherwise(with_note(notes, F.lit(LOCALE_NOTE))).alias("translator_notes"),
        )

    return let(localize_decimals(text), build)
