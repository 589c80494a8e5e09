"""Ranked lexical search: exact inner products through ball trees over sparse vectors.

An item's score for a document is the inner product of the weights of the item's terms with the
document's saturated term frequencies, all whole numbers. Only terms of the items matter, so the
documents become vectors over these in one pass, which also gives the statistics of the corpus.

Each task then reads its vectors in blocks. For a few items at a time, a block is a ball tree
over the terms of these items: a node has the centroid of its documents and the radius around it, so
no document in it can score more than the centroid does plus radius times the item's norm.
Coordinates are scaled so that this bound is small on average; the scaling cancels in the product.
The bound is computed in doubles and raised by more than all rounding errors. Subtrees are visited
best first until the bound of the best one left is below the lowest score that still counts, and the documents of a leaf are
scored in whole numbers. That lowest score is kept from block to block, so later blocks prune more.

A task returns the best documents of each item, and two rounds of ranking merge the tasks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from segqa.plans.scale import materialize, spread

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Terms of the items of one pass over the documents, so of what a task gets sent; one item may have more.
PASS_TERMS = 1 << 19
# Items of one tree, documents of one block, documents of a leaf.
TREE_ITEMS = 8
BLOCK = 4096
LEAF = 16
# Numbers in the matrix of a block; a block with more terms has fewer documents.
CELLS = 1 << 21
# Least spread of a term's values when coordinates are scaled, in units of the values (up to 10^6).
SPREAD = 1000.0
# More than the relative rounding error of any sum of CELLS products.
ERROR = 4e-9
# Parts in which the best documents of an item are ranked first.
PARTS = 64


def terms(text: str | None) -> list[str]:
    """Terms in order; only A-Z become lower case. None if the text is null."""
    return TERM.findall((text or "").encode("utf-8").lower().decode("utf-8"))


@dataclass
class Tree:
    """Nodes as runs of ``order``; a node's two children follow each other, and 0 stands for none."""

    order: np.ndarray
    begin: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    centroid: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Tree over the rows of ``points``: each node goes to the nearer of two far points, until ``leaf`` rows are left."""
    tree = Tree(np.arange(len(points)), [0], [len(points)])
    squares = np.einsum("ij,ij->i", points, points)
    at = 0
    while at < len(tree.begin):
        begin, end = tree.begin[at], tree.end[at]
        rows = tree.order[begin:end]
        here, square = points[rows], squares[rows]
        centroid = here.mean(axis=0)
        apart = square - 2 * (here @ centroid) + centroid @ centroid
        margin = ERROR * (square.max() + centroid @ centroid)
        tree.centroid.append(centroid)
        tree.radius.append(math.sqrt(max(0.0, apart.max()) + margin))
        if end - begin <= leaf or apart.max() <= margin:
            tree.child.append(0)
        else:
            one = apart.argmax()
            other = (square - 2 * (here @ here[one])).argmax()
            nearer = here @ (here[other] - here[one]) < (square[other] - square[one]) / 2
            first = int(nearer.sum())
            if first in (0, end - begin):
                first = (end - begin) // 2
                nearer = np.arange(end - begin) < first
            tree.order[begin:end] = rows[np.argsort(~nearer, kind="stable")]
            tree.child.append(len(tree.begin))
            tree.begin += [begin, begin + first]
            tree.end += [begin + first, end]
        at += 1
    return tree


class Best:
    """The best documents of an item so far: highest score first, then smallest id, null last."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.found: list[tuple[int, bool, Any]] = []
        self.least = 1

    def add(self, scores: np.ndarray, ids: Sequence[Any]) -> None:
        for at in np.flatnonzero(scores >= self.least).tolist():
            self.found.append((-int(scores[at]), ids[at] is None, ids[at]))
        if len(self.found) >= 2 * self.limit:
            self.cut()

    def cut(self) -> None:
        self.found.sort(key=lambda f: f[:2] if f[1] else f)
        del self.found[self.limit :]
        if len(self.found) == self.limit:
            self.least = max(self.least, -self.found[-1][0])


@dataclass
class Searcher:
    """The items of one pass: ``items`` hold places of their terms in ``weight``."""

    items: list[np.ndarray]
    weight: np.ndarray
    documents: int
    all_terms: int
    limit: int
    scored: int = 0
    offered: int = 0

    def __post_init__(self) -> None:
        self.best = [Best(self.limit) for _ in self.items]

    def values(self, size: Sequence[int], owner: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Saturated frequencies of terms that occur ``times`` in documents of ``size`` terms."""
        norm = np.array([100 - 50 + (50 * n * self.documents) // self.all_terms for n in size], np.int64)
        return (1_000_000_000 * times) // (1000 * times + 20 * norm[owner])

    def block(self, ids: Sequence[Any], size: Sequence[int], owner: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """Search documents given as sparse rows: row ``owner`` has ``term`` so many ``times``."""
        value = self.values(size, owner, times)
        place = np.full(len(self.weight), -1)
        for at in range(0, len(self.items), TREE_ITEMS):
            some = range(at, min(at + TREE_ITEMS, len(self.items)))
            wanted = np.unique(np.concatenate([self.items[i] for i in some]))
            place[wanted] = 0
            here = np.flatnonzero(place[term] == 0)
            present = np.unique(term[here])
            place[present] = np.arange(len(present))
            rows, row = np.unique(owner[here], return_inverse=True)
            step = max(1, CELLS // max(1, len(present)))
            # Rows come in order, so the entries of a run of rows are a run.
            for first in range(0, len(rows), step):
                last = min(first + step, len(rows))
                part = slice(*np.searchsorted(row, [first, last]))
                matrix = np.zeros((last - first, len(present)), np.int64)
                matrix[row[part] - first, place[term[here[part]]]] = value[here[part]]
                self._search(matrix, present, [ids[r] for r in rows[first:last].tolist()], some)
            place[wanted] = -1

    def _search(self, matrix: np.ndarray, present: np.ndarray, ids: list[Any], some: range) -> None:
        asked = np.zeros((len(some), len(present)), bool)
        for k, i in enumerate(some):
            asked[k] = np.isin(present, self.items[i])
        weight = self.weight[present]
        # The scaling for which the mean product of an item's norm and a document's distance is smallest.
        scale = np.sqrt(weight * np.sqrt(asked.mean(axis=0)) / (matrix.std(axis=0) + SPREAD))
        tree = ball_tree(matrix * scale)
        centroid, radius = np.array(tree.centroid), np.array(tree.radius)
        items = asked * np.divide(weight, scale, out=np.zeros(len(scale)), where=scale > 0)
        norm = np.sqrt(np.einsum("ij,ij->i", items, items))
        length = np.sqrt(np.einsum("ij,ij->i", centroid, centroid))
        bound = centroid @ items.T + (radius + ERROR * (length + radius))[:, None] * norm
        for k, i in enumerate(some):
            columns = np.flatnonzero(asked[k])
            if len(columns):
                self.offered += len(ids)
                self._descend(tree, bound[:, k].tolist(), matrix, columns, weight[columns], ids, self.best[i])

    def _descend(self, tree: Tree, bound: list[float], matrix: np.ndarray, columns: np.ndarray, weight: np.ndarray, ids: list[Any], best: Best) -> None:
        waiting = [(-bound[0], 0)]
        while waiting:
            most, node = heapq.heappop(waiting)
            # What equals the lowest score may still win by its id.
            if -most < best.least:
                return
            if child := tree.child[node]:
                for c in (child, child + 1):
                    if (most_here := min(-most, bound[c])) >= best.least:
                        heapq.heappush(waiting, (-most_here, c))
            else:
                rows = tree.order[tree.begin[node] : tree.end[node]]
                self.scored += len(rows)
                best.add(matrix[rows[:, None], columns] @ weight, [ids[r] for r in rows.tolist()])

    def results(self) -> Iterator[tuple[int, Any, int]]:
        """``(item, id, score)``"""
        for i, best in enumerate(self.best):
            best.cut()
            for score, _, id_ in best.found:
                yield i, id_, -score


def _vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int]) -> DataFrame:
    """``(id, n, term, times)`` for documents with a term: number of terms, and those of the vocabulary with their occurrences."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("n long, term array<int>, times array<long>").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for batch in batches:
            n, found, times = [], [], []
            for text in batch.column(1):
                said = terms(text.as_py())
                counted = Counter(map(place, said))
                counted.pop(None, None)
                n.append(len(said))
                found.append(list(counted))
                times.append(list(counted.values()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "term", "times"])

    return materialize(rows.mapInArrow(scan, schema).where("n > 0"))


def _pass(docs: DataFrame, id_col: str, text_col: str, items: dict[int, list[str]], limit: int) -> DataFrame:
    """``(item, id, score)``: candidates of the items, among them the best ``limit`` of each."""
    names = sorted({t for found in items.values() for t in found})
    vocabulary = {t: i for i, t in enumerate(names)}
    vectors = _vectors(docs, id_col, text_col, vocabulary)
    documents, all_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    # One number a term of the pass.
    counted = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    frequency = np.zeros(len(names), np.int64)
    for row in counted:
        frequency[row["term"]] = row["df"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
    numbers = list(items)
    sent = vectors.sparkSession.sparkContext.broadcast(
        ([np.array(sorted(vocabulary[t] for t in items[i]), np.int64) for i in numbers], weight, documents, all_terms or 1)
    )
    kind = vectors.schema["id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*sent.value, limit)
        held, type_ = [], None

        def settle() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = np.diff(table.column("term").combine_chunks().offsets.to_numpy())
            owner = np.repeat(np.arange(table.num_rows), lengths)
            entries = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("term", "times")]
            searcher.block(table.column("id").to_pylist(), table.column("n").to_pylist(), owner, *entries)
            held.clear()

        for batch in batches:
            type_ = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    settle()
        if held:
            settle()
        if type_ is not None:
            found = list(searcher.results())
            columns = [pa.array([numbers[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], type_), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    schema = StructType([*StructType.fromDDL("item long").fields, StructField("id", kind), *StructType.fromDDL("score long").fields])
    return vectors.where(F.size("term") > 0).mapInArrow(search, schema)


def _ranked(found: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def search(
    docs: DataFrame, items: DataFrame, limit: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``limit`` documents of the highest score above 0 for each item.

    Equal scores go by ascending document id, null last; rows that repeat an id rank one after the
    other. An item is an id with a text: rows that repeat both are one, and one that repeats the id with another text
    ranks by itself. Items without terms, null texts included, and items whose terms no document has get no row; so do
    empty tables. Documents without terms count nowhere. Columns other than those named play no part.
    """
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sorted(set(terms(t.as_py()))) for t in batch.column(1)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["item_id", "terms"])

    schema = StructType([wanted.schema["item_id"], *StructType.fromDDL("terms array<string>").fields])
    numbered = wanted.mapInArrow(split, schema).where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id())
    numbered = materialize(numbered)
    passes = -(-(numbered.agg(F.sum(F.size("terms"))).first()[0] or 0) // PASS_TERMS)
    dealt = F.pmod(F.xxhash64("item"), F.lit(max(1, passes)))
    source = spread(docs)
    found: DataFrame | None = None
    for number in range(max(1, passes)):
        chosen = {r["item"]: r["terms"] for r in numbered.where(dealt == number).select("item", "terms").orderBy("item").collect()}
        one = materialize(_pass(source, id_col, text_col, chosen, limit))
        found = one if found is None else found.unionByName(one)
    parted = _ranked(found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS))), ["item", "part"], limit).drop("rank", "part")
    best = _ranked(parted, ["item"], limit)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
