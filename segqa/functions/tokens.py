"""Protected-token extraction over text columns.

Ten patterns are tried in priority order. A match is kept when it overlaps no
span kept before it, and the kept spans are returned in text order. All of it is
one row-local expression, so extraction never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segqa.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, let, strip_ws

_D = r"\p{Nd}"

# Kinds that can occur in a text without any digit.
DIGITLESS_KINDS = ("abbreviation", "comparator", "unit")

# Fixed values: (kind, a character every match holds or None, pattern),
# in priority order. Word boundaries are written as look-arounds because every
# pattern starts and ends with a word character. The leading look-ahead on the
# first character lets the regex engine skip most positions cheaply.
PATTERNS = (
    ("cas", "-", rf"(?={_D}){NOT_AFTER_WORD}{_D}{{2,7}}-{_D}{{2}}-{_D}{NOT_BEFORE_WORD}"),
    ("regulation", "/", rf"(?=[rR])(?iu){NOT_AFTER_WORD}Regulation{WS}*\((?:EU|EC)\){WS}*No\.?{WS}*{_D}+/{_D}+{NOT_BEFORE_WORD}"),
    (
        "standard",
        None,
        rf"(?=[eEiIdDaAİı])(?iu){NOT_AFTER_WORD}(?:EN|ISO|DIN|ASTM){WS}*{_D}+(?:[-:/]{_D}+)*(?:{WS}*[:/]{WS}*{_D}+)?{NOT_BEFORE_WORD}",
    ),
    ("regulation", "/", rf"(?=[eE])(?iu){NOT_AFTER_WORD}(?:EU|EC){WS}*No\.?{WS}*{_D}+/{_D}+{NOT_BEFORE_WORD}"),
    ("date", "-", rf"(?={_D}){NOT_AFTER_WORD}{_D}{{4}}-{_D}{{2}}-{_D}{{2}}{NOT_BEFORE_WORD}"),
    ("abbreviation", None, rf"(?=[nNlLsSoOſ])(?iu){NOT_AFTER_WORD}(?:ND|N/A|NA|LOQ|LOD|SML|OML){NOT_BEFORE_WORD}"),
    (
        "formula",
        None,
        rf"(?=[A-Z]){NOT_AFTER_WORD}(?=[A-Z0-9]*{_D})(?:[A-Z][a-z]?{_D}*){{2,}}{NOT_BEFORE_WORD}",
    ),
    ("comparator", None, r"[≤≥<>=±]"),
    (
        "unit",
        None,
        rf"(?=[mMµμΜuUgGkK\u212apPdDhHsSſ°%])(?iu)(?:{NOT_AFTER_WORD}(?:mg/dm[2²]|mg/kg|µg/kg|ug/kg|g/m[2²]|kg|mg|µg|ug|ppm|ppb|days?|hours?|hrs?|min|s)"
        rf"{NOT_BEFORE_WORD}|°C|%)",
    ),
    (
        "number",
        None,
        rf"(?={_D})(?<![A-Za-z0-9/-])(?:{_D}{{1,3}}(?:[ ,]{_D}{{3}})+|{_D}+)(?:[.,]{_D}+)?(?![A-Za-z0-9/-])",
    ),
)

# What any text with a token holds: a digit, one of these signs, or a whole word of the kinds that do without digits.
# Characters beyond Latin-1 that such a token may start with are looked for where a character of their range is.
_SIGNS = "[<>=±°%]"
_LATIN = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B))))
_WORDS = (
    rf"(?=[mMµuUgGkKpPdDhHsSnNlLoO])(?<![{_LATIN}]){NOT_AFTER_WORD}(?iu)(?:mg/dm[2²]|mg/kg|µg/kg|ug/kg|g/m[2²]|kg|mg|µg|ug|ppm|ppb|days?|hours?|hrs?|min|s"
    rf"|ND|N/A|NA|LOQ|LOD|SML|OML){NOT_BEFORE_WORD}"
)
_WIDE_RANGE = r"[\u017f-\u2265]"
_WIDE_STARTS = "[≤≥μΜ\u212aſ]"

_MARK = "\x1f"
_SPAN = "struct<start:int,end:int,kind:string>"
TOKEN_TYPE = "struct<token_id:string,kind:string,text:string,normalized:string,start:int,end:int>"


def marked_parts(text: Column, pattern: str) -> Column:
    """Split text into [outside, match, outside, match, ...] with one regex pass.

    The mark is an ASCII separator; a mark already in the text is first turned into
    its neighbour, which every pattern treats alike, so offsets stay valid.
    """
    return _split_marked(_safe(text), pattern)


def _safe(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, "\x1e")).otherwise(text)


def _split_marked(safe: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(safe, f"(?:{pattern})", f"{_MARK}$0{_MARK}"), _MARK)


def may_hold_tokens(text: Column) -> Column:
    """False only for texts without any token; most prose is settled by it."""
    wide = (F.octet_length(text) > F.length(text)) & text.rlike(_WIDE_RANGE) & text.rlike(_WIDE_STARTS)
    return text.rlike(_D) | text.rlike(_SIGNS) | text.rlike(_WORDS) | wide


def _candidates(text: Column) -> Column:
    """Per pattern its kind and the marked parts of the text; no parts where it cannot match."""
    nothing = F.expr("cast(array() as array<string>)")

    def build(x: Column) -> Column:
        t, digits = x["t"], x["digits"]
        groups = []
        for kind, need, pattern in PATTERNS:
            # Cheap tests first: parts are built only where the pattern occurs.
            found = t.rlike(pattern)
            if need is not None:
                found = t.contains(need) & found
            if kind not in DIGITLESS_KINDS:
                found = digits & found
            parts = F.when(found, _split_marked(t, pattern)).otherwise(nothing)
            groups.append(F.struct(F.lit(kind).alias("kind"), parts.alias("parts")))
        return F.array(*groups)

    return let(F.struct(_safe(text).alias("t"), text.rlike(_D).alias("digits")), build)


def _spans(candidate: Column) -> Column:
    """Spans of one pattern: walk the parts, adding up lengths, keeping every second one."""
    start = F.expr(f"struct(0 as pos, false as hit, cast(array() as array<{_SPAN}>) as out)")

    def step(acc: Column, part: Column) -> Column:
        def build(end: Column) -> Column:
            span = F.struct(acc["pos"].alias("start"), end.alias("end"), candidate["kind"].alias("kind"))
            return F.struct(
                end.alias("pos"),
                (~acc["hit"]).alias("hit"),
                F.when(acc["hit"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
            )

        return build(acc["pos"] + F.length(part))

    return F.aggregate(candidate["parts"], start, step, lambda acc: acc["out"])


def token_spans(text: Column) -> Column:
    """Kept spans ``array<struct<start,end,kind>>`` in text order; offsets are 0-based code points."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def keep(acc: Column, candidate: Column) -> Column:
        def free(s: Column) -> Column:
            return ~F.exists(acc, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"]))

        return F.when(F.size(candidate["parts"]) == 0, acc).otherwise(F.concat(acc, F.filter(_spans(candidate), free)))

    def build(t: Column) -> Column:
        return F.when(may_hold_tokens(t), F.sort_array(F.aggregate(_candidates(t), none, keep))).otherwise(none)

    return let(F.coalesce(text, F.lit("")), build)


def normalize_token(kind: Column, value: Column) -> Column:
    """Comparable form of a token text."""
    return let(strip_ws(value), lambda clean: _normal_form(kind, clean))


def _normal_form(kind: Column, clean: Column) -> Column:
    unit = F.lower(F.translate(clean, "µ²", "u2"))
    code = F.upper(F.regexp_replace(clean, f"{WS}+", ""))
    comparator = F.when(clean == "≤", F.lit("<=")).when(clean == "≥", F.lit(">=")).otherwise(clean)
    return (
        F.when(kind == "number", F.translate(clean, ", ", "."))
        .when(kind == "unit", unit)
        .when(kind.isin("standard", "regulation", "abbreviation", "formula"), code)
        .when(kind == "comparator", comparator)
        .otherwise(clean)
    )


def token_prefix(segment_id: Column) -> Column:
    return F.upper(F.translate(segment_id, "-", "_"))


def extract_tokens(text: Column, prefix: Column | str = "TOKEN") -> Column:
    """Protected tokens of a text as ``array<struct>`` with ids ``PREFIX_1..n``."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix

    def to_token(span: Column, index: Column) -> Column:
        def build(value: Column) -> Column:
            return F.struct(
                F.concat(head, F.lit("_"), (index + 1).cast("string")).alias("token_id"),
                span["kind"].alias("kind"),
                value.alias("text"),
                # Matches neither start nor end with whitespace, so there is nothing to strip.
                _normal_form(span["kind"], value).alias("normalized"),
                span["start"].alias("start"),
                span["end"].alias("end"),
            )

        return let(F.substring(text, span["start"] + 1, span["end"] - span["start"]), build)

    return F.transform(token_spans(text), to_token)


# Joins kind and normalized value into one comparable key; no kind contains it.
TOKEN_KEY_MARK = "\x1f"


def token_key(kind: Column, normalized: Column) -> Column:
    return F.concat(kind, F.lit(TOKEN_KEY_MARK), normalized)


def key_count(keys: Column, key: Column) -> Column:
    """How often ``key`` occurs in the array ``keys``."""
    return F.size(keys) - F.size(F.array_remove(keys, key))
