"""Language identification, words first, with backoff to shorter and shorter character n-grams.

A model holds, for each language, log frequencies of its most frequent words and character
n-grams. A known word is scored by its log frequencies; an unseen one by its longest
n-grams that are known, and so on down to single letters. The language with the highest sum
wins. Models are fitted on a bounded sample of labelled rows, so they are of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segqa.llm.arrow import with_fields

# Bounds of a fitted model: languages (the most frequent), rows of each language that are
# read, words and n-grams of each order that each language keeps.
LANGUAGES = 256
SAMPLE_ROWS = 5_000
WORDS = 20_000
GRAMS = 5_000
ORDERS = (5, 4, 3, 2, 1)
# Words of a text that are summed at once; unseen words that a worker remembers the scores of, and
# the bytes that these scores may take, as many languages make them longer.
PART = 8_192
REMEMBERED = 600_000
REMEMBERED_BYTES = 64_000_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall((text or "").lower())


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word with its borders marked; single letters without."""
    marked = word if order == 1 else f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """``tables[0]`` holds words, ``tables[n]`` n-grams of order n: key -> log frequency by language."""

    languages: list[str]
    tables: dict[int, dict[str, np.ndarray]]

    @cached_property
    def scorer(self) -> Scorer:
        """Kept with the model, so that the tasks of a worker share what it has learned."""
        return Scorer(self)


class Scorer(dict):
    """Word -> row of ``scores``; unseen words are scored when they are first asked for."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = {w: i for i, w in enumerate(model.tables.get(0, {}))}
        super().__init__(self.words)
        known = [*model.tables.get(0, {}).values()]
        languages = max(1, len(model.languages))
        rows = max(PART, min(REMEMBERED, REMEMBERED_BYTES // (8 * languages)))
        self.scores = np.zeros((len(known) + rows, languages))
        if known:
            self.scores[: len(known)] = known

    def __missing__(self, word: str) -> int:
        row = len(self)
        self.scores[row] = self.backoff(word)
        self[word] = row
        return row

    def backoff(self, word: str) -> np.ndarray | float:
        """Mean score of the longest n-grams that are known; nothing at all counts for no language."""
        for order in ORDERS:
            table = self.model.tables.get(order, {})
            found = [table[g] for g in grams(word, order) if g in table]
            if found:
                return sum(found) / len(found)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the score, per word; ``und`` without a letter or a model."""
        words = words_of(text)
        if not self.model.languages or not any(w.isalpha() for w in words):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), PART):
            total += self.part(words[at : at + PART])
        best = int(total.argmax())
        # Of the mean score of a word, so that long texts do not all end up at 1.
        return self.model.languages[best], float(1 / np.exp((total - total[best]) / len(words)).sum())

    def part(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores; makes room before it starts, so that rows stay theirs meanwhile."""
        if len(self) + len(words) > len(self.scores):
            self.clear()
            self.update(self.words)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.scores[rows].sum(axis=0)


def _counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, kind, key, n)``: occurrences of words (kind 0) and of n-grams (their order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(w for w in words_of(text) if w.isalpha())
            for lang, counts in words.items():
                for kind in (0, *ORDERS):
                    found: Counter = Counter()
                    if kind:
                        for word, n in counts.items():
                            for gram in grams(word, kind):
                                found[gram] += n
                    found = found or counts if not kind else found
                    keys = list(found)
                    columns = [[lang] * len(keys), [kind] * len(keys), keys, list(found.values())]
                    types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "kind", "key", "n"])

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "lang string, kind int, key string, n long")
    return counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str, lang_col: str, key: Column) -> Model:
    """A model from rows with a language; rows with a null text or language teach nothing.

    Of each of the ``LANGUAGES`` most frequent languages, ``SAMPLE_ROWS`` rows are read on
    average: those whose ``key``, any column that tells rows apart, hashes below the share that takes.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], {})
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, SAMPLE_ROWS / r["count"])) for r in sizes], "__lang string, __share double")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(shares), rows[lang_col] == F.col("__lang")).where(place < F.col("__share"))
    counts = _counts(sample, text_col, lang_col)

    whole = Window.partitionBy("lang", "kind")
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    kept = counts.withColumn("total", F.sum("n").over(whole)).withColumn("place", F.row_number().over(order))
    kept = kept.where(F.col("place") <= F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS))
    languages = sorted(r["lang"] for r in sizes)
    at = {lang: i for i, lang in enumerate(languages)}
    # At most LANGUAGES * (WORDS + GRAMS * orders) rows, by the bounds above.
    found = kept.select("lang", "kind", "key", "n", "total").collect()
    totals = {(r["lang"], r["kind"]): r["total"] for r in found}
    tables: dict[int, dict[str, np.ndarray]] = {}
    for kind in (0, *ORDERS):
        # What a language does not have counts as half an occurrence.
        floor = np.log([0.5 / max(1, totals.get((lang, kind), 1)) for lang in languages])
        table = tables.setdefault(kind, {})
        for r in found:
            if r["kind"] == kind:
                if r["key"] not in table:
                    table[r["key"]] = floor.copy()
                table[r["key"]][at[r["lang"]]] = np.log(r["n"] / r["total"])
    return Model(languages, tables)


def predict(df: DataFrame, model: Model, text_col: str, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) from the whole text.

    All rows and columns stay; columns named like the new ones are replaced. Texts that are null
    or have no letter get ``und`` and 0, as does every text if nothing was learned. Of equally
    likely languages the first by name wins.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop(lang_col, score_col)
    at = base.columns.index(text_col)
    schema = with_fields(base.schema, f"`{lang_col}` string, `{score_col}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(at)]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return base.mapInArrow(run, schema)
