"""Spelling variants: words one edit apart, found by walking a trie level by level.

The trie of all words is a table of edges (node, skip, label, child). A node stands for a prefix and is
its hash; plain edges go down by the letters of their label, skip edges by any one letter and
the label after it. Labels have ``STEP`` letters, with longer ones beside them for long words; the last
letters of a word are an edge of their own, which ends at the word.

A state (word, position, node, edits) says that a word's first letters lead to a node. Without an
edit they lead to the word's own prefixes, so all these states are there from the start, and
the first level makes the edit: a skip edge stands for a letter replaced, or for one inserted
into the other word, and the label behind it must match the word's next letters, so that few
states leave it. Each further level joins the states that are left with the plain edges.
States that reach the end of a word are neighbours. As replacing goes both ways and
inserting one way is deleting the other, each pair is found from one side: from the word with
the smaller letter, or from the shorter word. The hashes only guide the walk; the words found
are compared in the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.plans.scale import materialize

RUN = re.compile(r"[a-zÀ-ÿ]+")
# Distinct words that a task counts before it hands them on.
COUNTED = 1 << 17
# Letters of a label, of the longest first; all but the last serve long words only.
STEPS = (256, 32, 4)
STEP = STEPS[-1]
# Nodes are numbers below this prime, so sums of products stay exact in Python.
PRIME = (1 << 61) - 1
FACTOR = 0x1F0A3B5C7D9E2461
# Rows that a task gathers before it hands them on.
GATHERED = 1 << 14
# States of a level that are sent to all tasks, in bytes; more are shuffled.
SENT = 1 << 20
# Bytes of a state besides the letters that are left.
STATE = 64


def perturbed(prefix: int | None, run: str) -> str:
    """The run, without one letter if 97 divides its checksum; ``prefix`` is that of what precedes it."""
    if prefix is not None:
        h = zlib.crc32(run.encode("utf-8"), prefix)
        if h % 97 == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, n)``: all words of the texts with their occurrences.

    A word is a run of letters with A-Z in lower case, without one letter where 97 divides the checksum of
    ``<id>:<run>``; a row without an id has no checksum. Null texts have no words.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            columns = [pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())]
            counted.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = None if id_ is None else zlib.crc32(f"{id_}:".encode())
                runs = Counter(RUN.findall((text.as_py() or "").encode("utf-8").lower().decode("utf-8")))
                for run, n in runs.items():
                    counted[perturbed(prefix, run)] += n
                if len(counted) >= COUNTED:
                    yield hand_on()
        yield hand_on()

    return rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(word: str, known: list[int], common: int) -> list[int]:
    """Nodes of all prefixes of a word, the empty one first; the first ``common`` letters are as in ``known``."""
    nodes = known[: common + 1]
    for c in word[common:]:
        nodes.append((nodes[-1] * FACTOR + ord(c) + 1) % PRIME)
    return nodes


def word_edges(word: str, nodes: list[int], common: int) -> Iterator[tuple[int, int | None, str, int]]:
    """Edges ``(node, skipped letter or None, label, child)`` on the way to a word, beyond its first ``common`` letters."""
    for end in range(common + 1, len(word) + 1):
        for step in STEPS:
            if end >= step:
                yield nodes[end - step], None, word[end - step : end], nodes[end]
        if end > STEP:
            yield nodes[end - STEP - 1], ord(word[end - STEP - 1]), word[end - STEP : end], nodes[end]
    for tail in range(min(STEP, len(word) + 1)):
        at = len(word) - tail
        yield nodes[at], None, word[at:], nodes[-1]
        if at:
            yield nodes[at - 1], ord(word[at - 1]), word[at:], nodes[-1]


def word_states(word: str, nodes: list[int], common: int) -> Iterator[tuple[int, int, int, str, int, bool]]:
    """States ``(node, word's key, its next letter, label, position, inserts)`` of a word before its edit, at each of its prefixes.

    The edit inserts a letter before the next one or replaces that; the label follows, from ``position`` on.
    Beyond the last letter there is none, and only inserting.
    """
    for at, node in enumerate(nodes):
        letter = ord(word[at]) if at < len(word) else -1
        yield node, nodes[-1], letter, word[at : at + STEP], at, True
        if at < len(word):
            yield node, nodes[-1], letter, word[at + 1 : at + 1 + STEP], at + 1, False


def _by_word(words: DataFrame, make: Callable[[str, list[int], int], Iterator[tuple]], fields: list[tuple[str, str]]) -> DataFrame:
    """Rows that ``make(word, nodes, common)`` yields for each word; ``common`` letters are as in the word before."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, nodes = "", [0]
        for batch in batches:
            for word in batch.column(0).to_pylist():
                common, shortest = 0, min(len(word), len(last))
                while common < shortest and word[common] == last[common]:
                    common += 1
                nodes, last = prefixes(word, nodes, common), word
                yield from make(word, nodes, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = rows(batches)
        while held := list(islice(made, GATHERED)):
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return words.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent to all tasks: Spark goes by the size of files, and of what their rows are made into, which is far too low."""
    return df.hint("merge")


def _step(rest: Column) -> Column:
    """Letters of the next label, of those that are left."""
    step = F.lit(STEP)
    for longer in reversed(STEPS[:-1]):
        step = F.when(F.length(rest) >= longer, longer).otherwise(step)
    return step


def neighbours(words: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of ``words(word)``, distinct, that one inserted, deleted or replaced code point makes equal, each pair once.

    ``a`` is the shorter one, or of two of one length the one that comes first.
    """
    # In order, so that words share the letters of the word before and a task repeats no edge.
    ranged = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    keyed = materialize(_by_word(ranged, lambda word, nodes, common: iter([(word, nodes[-1])]), [("word", "string"), ("key", "long")]))
    trie = materialize(_by_word(keyed.select("word"), word_edges, [("node", "long"), ("skipped", "int"), ("label", "string"), ("child", "long")]))
    fields = [("node", "long"), ("key", "long"), ("letter", "int"), ("label", "string"), ("position", "int"), ("inserts", "boolean")]
    states = _by_word(keyed.select("word"), word_states, fields)
    skip = trie.where("skipped is not null").select("node", "skipped", "label", "child")
    down = trie.where("skipped is null").select("node", "label", "child")
    # Inserting a letter before the same one is inserting it behind. Both sides are shuffled, so hot nodes can be split.
    other = F.when(F.col("inserts"), F.col("skipped") != F.col("letter")).otherwise(F.col("skipped") > F.col("letter"))
    met = states.join(_shuffled(skip), ["node", "label"]).where(other)
    met = materialize(met.select("key", F.col("child").alias("node"), (F.col("position") + F.length("label")).alias("position"), (F.length("label") < STEP).alias("ended")))
    found = met.where("ended").select("key", "node")
    open_ = met.where("not ended").join(_shuffled(keyed), "key")
    # Where two words share a key, this follows both.
    open_ = materialize(open_.select("key", "node", F.expr("substring(word, position + 1)").alias("rest")))
    while (left := open_.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("rest")).alias("bytes")).first()).n:
        cut = open_.withColumn("step", _step(F.col("rest"))).withColumn("label", F.left("rest", "step"))
        cut = F.broadcast(cut) if STATE * left.n + left.bytes <= SENT else _shuffled(cut)
        moved = materialize(cut.join(down, ["node", "label"]).select("key", F.col("child").alias("node"), "rest", "step"))
        ended = F.length("rest") < F.col("step")
        found = found.unionByName(moved.where(ended).select("key", "node"))
        open_ = moved.where(~ended).select("key", "node", F.expr("substring(rest, step + 1)").alias("rest"))
    pairs = found.where("key <> node").distinct()
    a = keyed.select("key", F.col("word").alias("a"))
    b = keyed.select(F.col("key").alias("node"), F.col("word").alias("b"))
    return pairs.join(_shuffled(a), "key").join(_shuffled(b), "node").where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, form)`` -> ``(word, root)``: the last word that following forms leads to; each round doubles the way."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = materialize(ways.join(_shuffled(further), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("moved")


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each of ``words(word, n)``, distinct.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form of a word
    is its near word of largest n, of these the first by code points, if that n is ``times`` the word's or more;
    else null. root is the end of the chain of forms, the word itself if it has none.
    """
    pairs = materialize(neighbours(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), "n")
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("b").alias("word"))).alias("best")
    near = both.join(_shuffled(counts), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(_shuffled(near.withColumnRenamed("a", "word")), "word", "left")
    frequent = -F.col("best.minus") >= times * F.col("n")
    judged = materialize(joined.select(
        "word", F.when(frequent, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, -F.col("best.minus")).alias("form_n"),
    ))
    roots = _roots(judged.where("form is not null").select("word", "form"))
    return judged.join(_shuffled(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """:func:`group_variants` of the words of the texts that have ``letters`` code points and ``least`` occurrences or more.

    Null and empty texts have no words; rows that repeat count as often as they occur; no words, no rows. Other
    columns play no part, whatever their names.
    """
    words = word_counts(docs, id_col, text_col).where((F.length("word") >= letters) & (F.col("n") >= least))
    return group_variants(materialize(words), times)
