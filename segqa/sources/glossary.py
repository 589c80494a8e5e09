"""Domain glossary file."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TERM_SCHEMA = (
    "key string, source string, preferred string, alternatives array<string>, forbidden array<string>, "
    "retain_english boolean, retain_english_on_first_use boolean, preserve_abbreviation string, short_form string"
)


# What the columns are called in the glossary file.
FILE_KEYS = {
    "source": "source",
    "preferred": "preferred_pl",
    "alternatives": "alternatives",
    "forbidden": "forbidden",
    "retain_english": "retain_english",
    "retain_english_on_first_use": "retain_english_on_first_use",
    "preserve_abbreviation": "preserve_abbreviation",
    "short_form": "short_pl",
}


@dataclass(frozen=True)
class Term:
    """A row of the glossary. What a file leaves out keeps its default; without a source wording the
    key is spelled out, and without a preferred wording the source stays."""

    key: str
    source: str = ""
    preferred: str = ""
    alternatives: tuple[str, ...] = field(default=())
    forbidden: tuple[str, ...] = field(default=())
    retain_english: bool = False
    retain_english_on_first_use: bool = False
    preserve_abbreviation: str | None = None
    short_form: str | None = None

    def __post_init__(self) -> None:
        spelled = self.source or self.key.replace("_", " ")
        object.__setattr__(self, "source", spelled)
        object.__setattr__(self, "preferred", self.preferred or spelled)

    @property
    def accepted(self) -> tuple[str, ...]:
        """Wordings that satisfy the term in a Polish translation."""
        english = self.source * (self.retain_english or self.retain_english_on_first_use)
        return tuple(filter(None, chain([self.preferred], self.alternatives, [self.short_form, english])))


def load_terms(path: str) -> list[Term]:
    """Terms of a YAML glossary; a missing file is an empty glossary, non-map entries are skipped.

    The glossary is a hand-written settings file of tens of terms, so operators take it
    as a plain list and put it into the plan as literals.
    """
    import yaml

    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return []
    document = yaml.safe_load(text)
    entries = document.get("terms") if isinstance(document, dict) else None
    terms = []
    for key, entry in (entries or {}).items():
        if isinstance(entry, dict):
            given = {column: entry[name] for column, name in FILE_KEYS.items() if entry.get(name)}
            terms.append(Term(key, **{c: tuple(v) if isinstance(v, list) else v for c, v in given.items()}))
    return terms


def terms_table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    rows = [
        (t.key, t.source, t.preferred, list(t.alternatives), list(t.forbidden), t.retain_english,
         t.retain_english_on_first_use, t.preserve_abbreviation, t.short_form)
        for t in terms
    ]
    return spark.createDataFrame(rows, TERM_SCHEMA)
