"""Quality rules by distribution divergence.

Each language has two references, counted over all its documents: how often the classes of
characters occur, and how often its most common words do. A document whose own histograms
are far from the references of its language, in Jensen-Shannon distance, is rejected. Short
documents say too little about a distribution, so they are only judged by the base rules.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segqa.llm.arrow import with_fields
from segqa.plans.scale import materialize

# Base rules: fewest words, and the share of repeated words in percent.
MIN_WORDS = 50
MAX_REPEATED = 50
# Words of a document from which on its words, and characters from which on its classes are judged.
WORDS_JUDGED = 50
CHARS_JUDGED = 200
# Largest Jensen-Shannon distances (0 to 1) that a document may have to its language; in words it is
# this part of the distance of a text without one common word, if that is less.
WORDS_APART = 0.55
CLASSES_APART = 0.3
WORDLESS = 0.95
# A reference has the most common words of at most so many characters.
COMMON_WORDS = 100
COMMON_LENGTH = 6
# References of languages that hold this share of all words, at most 1000, are sent to all tasks; those of
# other languages are joined to their documents.
LEAST_SHARE = 0.001

CLASSES = ["lower", "upper", "other_letter", "digit", "space", "punctuation", "symbol", "other"]
SYMBOLS = "#*$%&|<>"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, word_distance double, class_distance double, kept boolean"


def _class_of(c: str) -> int:
    if c in SYMBOLS:
        return CLASSES.index("symbol")
    kind = unicodedata.category(c)
    if c.isspace() or kind[0] == "Z":
        return CLASSES.index("space")
    named = {"Ll": "lower", "Lu": "upper", "Nd": "digit"}.get(kind)
    named = named or {"L": "other_letter", "P": "punctuation", "S": "symbol"}.get(kind[0], "other")
    return CLASSES.index(named)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of each code point of the first plane; letters beyond it are few and count as other letters."""
    return np.array([_class_of(chr(c)) for c in range(0x10000)], np.uint8)


def class_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    points = np.frombuffer(text.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    plane = points < 0x10000
    counts = np.bincount(_class_table()[points[plane]], minlength=len(CLASSES))
    beyond = points[~plane]
    if len(beyond):
        counts = counts + np.bincount([_class_of(chr(c)) for c in beyond], minlength=len(CLASSES))
    return counts


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, in UTF-8."""
    return text.encode("utf-8").split()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: 0 if alike, 1 if they have nothing in common."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def apart(x: np.ndarray) -> float:
        hit = x > 0
        return float((x[hit] * np.log2(x[hit] / m[hit])).sum())

    return float(np.sqrt(max(0.0, (apart(p) + apart(q)) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    # Windows as numbers in two steps, so that they stay small.
    _, pairs = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)
    _, triples, times = np.unique(pairs[:-1] * len(numbers) + at[2:], return_inverse=True, return_counts=True)
    twice = times[triples] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split("\n") if line.strip("\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines))


@dataclass(frozen=True)
class Reference:
    """Of one language: characters by class, occurrences of its common words and of all other words."""

    classes: np.ndarray
    words: dict[bytes, int]
    other: int

    @cached_property
    def words_apart(self) -> float:
        """Largest distance in words for this language: texts as far as one that has none of its common words are beyond it."""
        usual = np.array([*self.words.values(), self.other], float)
        return min(WORDS_APART, WORDLESS * distance(np.array([*[0] * len(self.words), 1.0]), usual))


def reference_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, total, entries)`` of every language with a word: its words in all, and its histograms over all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            classes: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            rows: list[tuple] = []
            for lang, counts in words.items():
                decoded = ((w.decode("utf-8"), n) for w, n in counts.items() if len(w) <= 4 * COMMON_LENGTH)
                rows += [(lang, "word", w, n) for w, n in decoded if len(w) <= COMMON_LENGTH]
                rows.append((lang, "words", "", sum(counts.values())))
                rows += [(lang, "class", c, n) for c, n in zip(CLASSES, classes[lang].tolist(), strict=True)]
            if rows:
                types = [pa.string(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "key", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "lang string, kind string, key string, n long")
    counts = materialize(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("place", place).where(F.col("place") <= COMMON_WORDS)
    sizes = counts.where("kind = 'words' and n > 0").select("lang", F.col("n").alias("total"))
    # At most COMMON_WORDS words, one sum and the classes of a language.
    entries = top.groupBy("lang").agg(F.collect_list(F.struct("kind", "key", "n")).alias("entries"))
    return materialize(sizes.join(entries, "lang"))


def reference(entries: list[dict]) -> Reference:
    kinds: dict[str, dict[str, int]] = {}
    for e in entries:
        kinds.setdefault(e["kind"], {})[e["key"]] = e["n"]
    common = {k.encode("utf-8"): n for k, n in sorted(kinds.get("word", {}).items())}
    classes = np.array([kinds["class"].get(c, 0) for c in CLASSES], float)
    return Reference(classes, common, kinds["words"][""] - sum(common.values()))


def split_references(rows: DataFrame) -> tuple[dict[str, Reference], DataFrame | None]:
    """References of the languages with a share of ``LEAST_SHARE`` of the words, and the rows of the others, if any."""
    share = LEAST_SHARE * (rows.agg(F.sum("total")).first()[0] or 0)
    known = {r["lang"]: reference(r["entries"]) for r in rows.where(F.col("total") >= share).collect()}
    rare = rows.where(F.col("total") < share)
    return known, None if rare.isEmpty() else rare


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, Reference]:
    """Histograms of every language with a share of ``LEAST_SHARE`` of the words, over all its documents."""
    return split_references(reference_rows(docs, text_col, lang_col))[0]


def judge(text: str | None, reference: Reference | None) -> tuple:
    """The values of ``METRICS`` for one text."""
    text = text or ""
    words = words_of(text)
    repeated = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    word_distance = class_distance = None
    if reference is not None:
        if len(words) >= WORDS_JUDGED and reference.words:
            common = Counter(w for w in words_of(text.lower()) if w in reference.words)
            own = np.array([*(common[w] for w in reference.words), len(words) - sum(common.values())], float)
            usual = np.array([*reference.words.values(), reference.other], float)
            word_distance = distance(own, usual)
        if len(text) >= CHARS_JUDGED:
            class_distance = distance(class_counts(text).astype(float), reference.classes)
    far = (word_distance is not None and word_distance > reference.words_apart) or (class_distance or 0) > CLASSES_APART
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    # Characters, not bytes, of the words.
    chars = len(text) - sum(text.count(c) for c in "\t\n\x0b\x0c\r ")
    return len(words), chars, n_symbols, duplicate_lines(text), repeated, base_failed, word_distance, class_distance, not base_failed and not far


def score(
    docs: DataFrame, known: dict[str, Reference], text_col: str = "text", lang_col: str = "lang", rare: DataFrame | None = None
) -> DataFrame:
    """Add the columns of ``METRICS`` to every row, from its whole text.

    ``rare`` has the references of languages that are not in ``known``, as ``reference_rows`` gives them.
    Null texts count as empty. Documents without a language, or of one without a reference, have
    null distances and the base rules alone decide, as they do for short texts. Columns
    named like the new ones are replaced; all others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    base = docs.drop(*(f.split()[0] for f in METRICS.split(", ")))
    schema = with_fields(base.schema, METRICS)
    n_columns, text_at, lang_at = len(base.columns), base.columns.index(text_col), base.columns.index(lang_col)
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(text_at), batch.column(lang_at).to_pylist()
            found = sent.value
            if batch.num_columns > n_columns:
                first = {lang: n for n, lang in enumerate(langs)}
                joined = {lang: batch.column(n_columns)[n].as_py() for lang, n in first.items()}
                found = {lang: reference(entries) for lang, entries in joined.items() if entries}
            made = [judge(t.as_py(), found.get(lang)) for t, lang in zip(texts, langs, strict=True)]
            if made:
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *columns], names=schema.names)

    if rare is None:
        return base.mapInArrow(run, schema)
    other = F.col(lang_col).isNotNull() & ~F.col(lang_col).isin(list(known))
    free = "_" * (1 + max(len(c) for c in base.columns))
    lookup = rare.select(F.col("lang").alias(f"{free}lang"), F.col("entries").alias(f"{free}entries"))
    joined = base.where(other).join(lookup, F.col(lang_col) == F.col(f"{free}lang"), "left").drop(f"{free}lang")
    return base.where(~other).mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))


def scored(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the columns of ``METRICS``, every language judged by its own documents."""
    known, rare = split_references(reference_rows(docs, text_col, lang_col))
    return score(docs, known, text_col, lang_col, rare)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept by the limits of their language, with the columns they had."""
    return scored(docs, text_col, lang_col).where("kept").select(*docs.columns)
