"""Embedding near-dedup by lattice hashing.

A table projects vectors onto eight random directions and decodes the result to the nearest
point of the E8 lattice, the densest packing of eight dimensions. A vector enters the cell of
that point and of the neighbouring points it lies closest to; vectors that share a cell of
any table are compared by cosine in double precision. Equal vectors are one node from the start.

Cells and components are worked through in pairs of blocks of bounded size, so a crowded cell
becomes many small tasks. A block gives a spanning forest of its links, never the links
themselves. Links are counted afterwards, within the components, where each pair is met once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.llm.components import components
from segqa.plans.scale import materialize

# Tables, and neighbouring cells a vector enters besides its own: with these, unit vectors of
# cosine 0.9 share a cell with probability 0.99, and unrelated ones with 0.01.
TABLES = 6
PROBES = 5
# Lattice points to a unit of length, for 64 dimensions; more of them, with more tables, suit larger inputs.
SCALE = 7.0
# Vectors of a cell or component that meet in one block.
BLOCK = 1024


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: what leads to the neighbouring lattice points."""
    found = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1, -1), repeat=2)):
        v = np.zeros(8)
        v[i], v[j] = a, b
        found.append(v)
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    return np.concatenate([found, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole-number points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(odd))
    near[odd, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 shifted by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=256)
def projection(table: int, dimensions: int) -> np.ndarray:
    """Eight random directions, at right angles where there are enough dimensions."""
    made = np.random.default_rng([table, dimensions]).standard_normal((dimensions, 8))
    if dimensions >= 8:
        made = np.linalg.qr(made)[0]
    else:
        made /= np.sqrt(dimensions)
    return made * SCALE * np.sqrt(dimensions / 64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """For each unit vector the hashes of the cells it enters: ``tables * (probes + 1)`` numbers."""
    around = minimal_vectors()
    weights = np.random.default_rng(0).integers(1, 1 << 62, 8, np.int64) | 1
    found = []
    for table in range(tables):
        at = unit @ projection(table, unit.shape[1])
        own = nearest_e8(at)
        # The closest neighbours are those that lie furthest in the direction of the offset.
        closest = np.argsort(-((at - own) @ around.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None, :], own[:, None, :] + around[closest]], axis=1)
        doubled = np.rint(2 * points).astype(np.int64)
        hashes = (doubled * weights).sum(axis=2) * 31 + (table << 16) + unit.shape[1]
        found.append(hashes ^ hashes >> 29)
    return np.concatenate(found, axis=1)


def _units(vectors: pa.Array) -> list[np.ndarray]:
    found = []
    for v in vectors:
        x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        # By the largest component first, so that squares stay finite.
        x = x / np.abs(x).max()
        found.append(x / np.sqrt(x @ x))
    return found


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _entered(nodes: DataFrame) -> DataFrame:
    """``(node, cell)``: the cells each node enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            by_size: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by_size.setdefault(len(u), []).append(i)
            for rows in by_size.values():
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    entered = cells(np.array([units[i] for i in part]))
                    made = pa.array(list(entered), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), made], names=["node", "cells"])

    found = nodes.select("node", "vector").mapInArrow(run, "node long, cells array<long>")
    return found.select("node", F.explode(F.array_distinct("cells")).alias("cell"))


def _blocks(members: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """Members ``(group, node)`` of groups of two and more, once for each pair of blocks they belong to.

    A group of n has ``ceil(n / BLOCK)`` blocks; blocks i and j meet under the key (group, i, j).
    """
    sizes = materialize(members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    placed = members.join(sizes, group).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    met = materialize(met)
    return met.join(vectors, "node").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "own", "node")


def _by_block(run: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], names: list[str]):
    """A function for mapInArrow over sorted rows (group, i, j, own, node, weight, vector), one block pair at a time.

    ``run`` gets the nodes, which of the two blocks they are in (0 or 1), their weights and unit vectors.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key = held[0][0]
            nodes, own, weight = (np.concatenate([h[n] for h in held]) for n in (1, 2, 3))
            units = [u for h in held for u in h[4]]
            held.clear()
            # Vectors of another length have no cosine with each other.
            sizes = np.array([len(u) for u in units])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if len(at) > 1:
                    made = run(nodes[at], (own[at] != key[1]).astype(int), weight[at], np.array([units[i] for i in at]))
                    if len(made[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, i, j, own, node, weight = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(6))
            change = np.flatnonzero((np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(g)], strict=True):
                key = (g[a], i[a], j[a])
                if held and held[0][0] != key:
                    yield from finish()
                held.append((key, node[a:b], own[a:b], weight[a:b], _units(batch.column(6).slice(a, b - a))))
        yield from finish()

    return work


def _linked(unit: np.ndarray, least: float) -> np.ndarray:
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    return near


def _forest(least: float):
    def run(nodes: np.ndarray, side: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> tuple:
        near = _linked(unit, least)
        waiting = near.any(axis=1)
        a, b = [], []
        while waiting.any():
            front = np.array([waiting.argmax()])
            waiting[front] = False
            while len(front):
                reached = near[front]
                new = np.flatnonzero(reached.any(axis=0) & waiting)
                a += nodes[front[reached[:, new].argmax(axis=0)]].tolist()
                b += nodes[new].tolist()
                waiting[new] = False
                front = new
        return a, b

    return run


def _degrees(least: float):
    def run(nodes: np.ndarray, side: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> tuple:
        near = _linked(unit, least)
        if side.any():
            # Pairs within one of the two blocks are counted where that block meets itself.
            near &= side[:, None] != side[None, :]
        links = near @ weight
        return nodes[links > 0], links[links > 0]

    return run


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, least: float = 0.9) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row: vectors linked by a cosine of ``least`` or more.

    n_links counts the other rows linked directly; component is the smallest id reachable, the
    row's own included; kept says whether that is the row's id. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, and neither do vectors of
    different lengths. Equal vectors always link. A null id is no candidate for the smallest
    and never kept. Candidates come from lattice cells, so a link of a cosine near ``least`` may be
    missed if nothing else connects its ends; none below ``least`` is made.
    """
    rows = materialize(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), usable(F.col(vector_col)).alias("usable")))
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    rows = rows.where("usable").select("id", "vector")
    equal = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"))
    nodes = materialize(equal.withColumn("node", F.monotonically_increasing_id()))
    vectors = nodes.select("node", "weight", "vector")

    order = ["own", "node", "weight", "vector"]
    met = _blocks(materialize(_entered(nodes)), vectors, "cell").select("cell", "i", "j", *order)
    edges = materialize(met.mapInArrow(_by_block(_forest(least), ["a", "b"]), "a long, b long"))
    roots = materialize(components(edges))

    met = _blocks(roots.select("root", "node"), vectors, "root").select("root", "i", "j", *order)
    counted = met.mapInArrow(_by_block(_degrees(least), ["node", "n"]), "node long, n long")
    degrees = counted.groupBy("node").agg(F.sum("n").alias("n"))
    firsts = roots.join(nodes.select("node", "first"), "node")
    heads = materialize(firsts.groupBy("root").agg(F.min("first").alias("component")))
    known = roots.join(heads, "root").join(degrees, "node").select("node", "component", "n")
    verdict = materialize(nodes.join(known, "node", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")
    ))
    # Both sides are shuffled from tables, so the rows of a frequent vector can be split.
    found = rows.join(verdict, "vector").select("id", "n_links", "component").unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
