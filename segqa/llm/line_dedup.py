"""Line dedup by pairwise alignment.

Documents overlap if they share a run of lines with enough words to be no chance hit: mostly one
line, or as many short ones as it takes. Each run links a later document to the first one that
has it, however many others do and how often, so there are never more pairs than lines. The line
hashes of a pair are aligned by patience diff, and blocks of aligned lines go from the
later document. Alignment is increasing, so passages in another order cross; a run of lines of
the later document that the earlier one holds anywhere goes as well. The first document with a line keeps it, so no line is lost altogether.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.llm.arrow import with_fields
from segqa.plans.scale import materialize

# Words that a run of lines needs to link documents, and a block to be deleted.
MIN_WORDS = 5
# Scripts without blanks between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese), and characters of theirs that count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNSPACED_WORD = 2


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """Signed 64-bit hash and number of words of each line, without white space around it."""
    lines = (text or "").split("\n")
    digests = (xxhash.xxh64_intdigest(line.strip()) for line in lines)
    return [_signed(d) for d in digests], [_words(line) for line in lines]


def _words(line: str) -> int:
    found = len(line.split())
    return found if line.isascii() else max(found, len(UNSPACED.findall(line)) // UNSPACED_WORD)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that occur once in both ranges, in the longest order they have in common."""
    once_a = {h: i for i, h in enumerate(a[a0:a1], a0)}
    count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    common = [(once_a[h], j) for j, h in enumerate(b[b0:b1], b0) if count_b[h] == 1 and count_a[h] == 1]
    # Patience sorting: the smallest end of an increasing run of each length, and what came before.
    ends: list[int] = []
    tops: list[int] = []
    came: list[int] = []
    for n, (i, _) in enumerate(common):
        pile = bisect_left(ends, i)
        came.append(tops[pile - 1] if pile else -1)
        ends[pile : pile + 1] = [i]
        tops[pile : pile + 1] = [n]
    found: list[tuple[int, int]] = []
    at = tops[-1] if tops else -1
    while at >= 0:
        found.append(common[at])
        at = came[at]
    return found[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of places with equal lines, increasing in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if not anchors:
            continue
        matched += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(ends, ends[1:], strict=False) if i + 1 < k and j + 1 < n]
    return sorted(matched)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of aligned blocks with ``min_words`` words or more."""
    found: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*aligned(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= min_words:
                found += block
            block = []
        block.append(j)
        last = (i, j)
    return found


def runs(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """``(start, end, hash)``: from each line with a word, the shortest run of lines that has ``min_words`` words."""
    found: list[tuple[int, int, int]] = []
    end = have = 0
    for start, own in enumerate(words):
        while end < len(words) and have < min_words:
            have += words[end]
            end += 1
        if have < min_words:
            break
        if own:
            one = end == start + 1
            found.append((start, end, hashes[start] if one else _signed(xxhash.xxh64_intdigest(struct.pack(f"<{end - start}q", *hashes[start:end])))))
        have -= own
    return found


def held_runs(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of the runs that ``a`` has anywhere, and of the lines that go on alike after them."""
    known = dict(zip(b, words, strict=True))
    # A line that only a has ends a run, which b then does not have.
    places: dict[int, int] = {}
    for start, _, h in runs(a, [known.get(x, min_words) for x in a], min_words):
        places.setdefault(h, start)
    found: list[int] = []
    done = 0
    for start, end, h in runs(b, words, min_words):
        if end <= done or h not in places:
            continue
        ahead = places[h] + end - start
        while end < len(b) and ahead < len(a) and a[ahead] == b[end]:
            ahead, end = ahead + 1, end + 1
        found += range(max(start, done), end)
        done = end
    return found


def _key(id_col: str, text_col: str) -> Column:
    """Orders documents: by id, null last, then by text; rows alike in both are one document."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def _scan(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words, linking = [], [], []
            for text in batch.column(1):
                h, w = line_hashes(text.as_py())
                hashes.append(h)
                words.append(w)
                linking.append(list({x[2] for x in runs(h, w, min_words)}))
            made = [pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(linking, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", "lines", "words", "runs"])

    return run


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(key, places)``: for each document that loses lines, their places from 0 in ascending order."""
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col))
    schema = with_fields(keyed.select("key").schema, "lines array<long>, words array<int>, runs array<long>")
    scanned = keyed.mapInArrow(_scan(min_words), schema).groupBy("key")
    lines = materialize(scanned.agg(*[F.first(c).alias(c) for c in ("lines", "words", "runs")]))

    # A run that a document repeats links it once.
    each = lines.select("key", F.explode("runs").alias("run"))
    shared = each.groupBy("run").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # From tables on both sides, so that the rows of a frequent run can be split.
    shared = materialize(shared.select("run", "first"))
    pairs = materialize(each.join(shared, "run").where("key <> first").select("key", "first").distinct())

    later = pairs.join(lines.drop("runs"), "key")
    earlier = lines.select(F.col("key").alias("first"), F.col("lines").alias("before"))
    both = later.join(earlier, "first").select("key", "before", "lines", "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (1, 2, 3)]
            places = [sorted({*common_blocks(*x, min_words), *held_runs(*x, min_words)}) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], names=["key", "places"])

    found = both.mapInArrow(align, with_fields(both.select("key").schema, "places array<int>"))
    # A document has few partners, and no more places than lines.
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("places"))))
    return found.where("size(places) > 0").groupBy("key").agg(union.alias("places"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the blocks of lines that an earlier document has; same rows and columns.

    Documents are in the order of their id (null ids last), then of a hash of their text; rows
    alike in both are one document and keep or lose the same lines. A text that loses all its
    lines becomes empty; null and empty texts stay as they are. Blank and short lines go only
    within a block that has ``min_words`` words.
    """
    places = materialize(duplicate_lines(docs, id_col, text_col, min_words))
    rows = docs.withColumn("__key", _key(id_col, text_col))
    # By key at any size: places grow with the documents, so a broadcast of them would do for small tables only.
    joined = rows.join(places.withColumnRenamed("key", "__key").withColumnRenamed("places", "__places").hint("merge"), "__key", "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(F.col("__places"), i))
    text = F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
