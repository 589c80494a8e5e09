"""Text normalization columns."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as one Java character class body (Java's \s alone is ASCII).
WS_CHARS = r"\s\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_CHARS}]"
# Unicode word characters; Java's \b and \w would miss '²' and friends.
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"

# Only runs that are not already a single plain space need rewriting, so clean
# text is scanned but never rebuilt.
_WS_RUN = f"(?:[{WS_CHARS}&&[^ ]]{WS}*| {WS}+)"
# Texts without these characters have no whitespace but the plain space. Java tests a list of Latin-1 characters with one
# look-up and a single range with one call; the range holds all further whitespace, and other characters too.
_NARROW_WS = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0]"
_WIDE_WS = r"[\u1680-\u3000]"

# Names under which Polish is recognised as a target language,
# and the narrower set that selects the decimal comma.
POLISH_NAMES = ("pl", "polish", "polski", "język polski", "jezyk polski")
DECIMAL_COMMA_NAMES = ("polish", "polski", "pl")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (an expression-level binding)."""
    return F.transform(F.array(value), body)[0]


def normalize_ws(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim; null becomes ''."""
    def clean(known: Column) -> Column:
        wide = (F.octet_length(known) > F.length(known)) & known.rlike(_WIDE_WS)
        rough = F.contains(known, F.lit("  ")) | known.rlike(_NARROW_WS) | wide
        return F.trim(F.when(rough, F.regexp_replace(known, _WS_RUN, " ")).otherwise(known))

    return let(F.coalesce(text, F.lit("")), clean)


@lru_cache(maxsize=1)
def _fold_table() -> dict[str, str]:
    """Characters whose full case folding differs from lower-casing them."""
    chars = (chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code <= 0xDFFF)
    return {c: c.casefold() for c in chars if c == c.lower() and c.casefold() != c}


def casefold(text: Column) -> Column:
    """Full Unicode case folding: ``lower`` plus the few characters it leaves."""
    table = _fold_table()
    special = "".join(table)

    def fold(low: Column) -> Column:
        pairs = F.expr("map(" + ",".join(f"'{part}'" for item in table.items() for part in item) + ")")
        folded = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(pairs[c], c)), "")
        ascii_only = F.octet_length(low) == F.length(low)
        return F.when(ascii_only | (F.translate(low, special, "") == low), low).otherwise(folded)

    return let(F.lower(text), fold)


def normalize_phrase(text: Column) -> Column:
    return casefold(normalize_ws(text))


def clean_phrase(text: Column, limit: int = 400) -> Column:
    """Whitespace-normalized text, or '' when it is longer than ``limit``."""
    return let(normalize_ws(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.lit("")))


def short_text(text: Column, limit: int) -> Column:
    return let(
        normalize_ws(text),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("…"))),
    )


def strip_ws(text: Column) -> Column:
    """Trim Unicode whitespace at both ends, keeping inner whitespace; texts without any there are not searched."""
    def strip(t: Column) -> Column:
        ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
        return F.when(ends.rlike(WS), F.regexp_replace(t, f"^{WS}+|{WS}+$", "")).otherwise(t)

    return let(text, strip)


def language_name(language: Column) -> Column:
    return F.lower(normalize_ws(language))


def is_polish(language: Column) -> Column:
    return language_name(language).isin(*POLISH_NAMES)


def uses_decimal_comma(language: Column) -> Column:
    return language_name(language).isin(*DECIMAL_COMMA_NAMES)


def is_polish_name(language: str | None) -> bool:
    return " ".join((language or "").lower().split()) in POLISH_NAMES


def is_decimal_comma_name(language: str | None) -> bool:
    return " ".join((language or "").lower().split()) in DECIMAL_COMMA_NAMES


def is_secret_key(key: Column) -> Column:
    """True for field names that look like credentials, bar three known harmless ones."""
    low = F.lower(key)
    named = low.rlike("api_key|apikey|secret|password")
    exact = low.isin("token", "access_token", "refresh_token", "authorization")
    harmless = low.isin("protected_tokens", "source_terms_retained", "uncertain_terms")
    return (named | exact) & ~harmless


def redact(fields: Column, longest: int | None = 4000) -> Column:
    """Mask credentials in a ``map<string,string>``; values over ``longest`` characters are cut, unless that is None."""
    def clean(key: Column, value: Column) -> Column:
        masked = F.when(is_secret_key(key) | value.startswith("sk-"), F.lit("[redacted]"))
        if longest is not None:
            masked = masked.when(F.length(value) > longest, F.concat(F.left(value, F.lit(longest)), F.lit("…")))
        return masked.otherwise(value)

    return F.transform_values(fields, clean)
