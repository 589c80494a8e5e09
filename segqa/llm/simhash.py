"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint's bit is set where more than half of the text's shingle hashes have it set.
Fingerprints that differ in few bits are found through structured masks: bit i gets a
vector of ``radius + 1`` bits, and the mask of table v keeps the bits whose vector has an odd
number of ones in common with v. Any ``radius`` vectors lie in a proper subspace, so some
v is orthogonal to all of them: that table masks out every differing bit, and the pair
collides there for certain.

Equal fingerprints are one node from the start. A bucket with two or more fingerprints makes
its members candidates; it is never turned into pairs. Candidates are confirmed through
the points around them: two fingerprints differ in at most ``2 r`` bits exactly if some
point is within ``r`` bits of both, and few fingerprints can lie around a point. An odd
radius is confirmed with the one fingerprint flipped further than the other.

Fingerprints alone say little about short texts. Where a similarity of shingle sets is asked for,
they only propose: they are taken over distinct words then, which a changed word moves
little, and the similarity of the whole shingle sets decides. Each text is compared with the
representative of each of its buckets first. What this leaves apart in a bucket of three or more
is compared pair by pair, in pairs of blocks of bounded size, so a crowded bucket becomes many
small tasks; a block gives a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segqa.llm.arrow import with_fields
from segqa.llm.components import components
from segqa.plans.scale import materialize

BITS = 64
# Hashes whose bits are counted in one step; a long text takes several.
COUNTED = 1 << 16
# Orders by which buckets choose their representative.
ORDERS = 8
# Texts of a crowded bucket that meet in one block, and shingles whose columns are multiplied in one step.
BLOCK = 256
COLUMNS = 4096


def fingerprint(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint of a text's shingles of ``width`` words.

    A-Z become lower case; words are runs without ASCII white space; shingles count as often as
    they occur, joined with a blank. Fewer words make one shingle; none, or a null text, is 0.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), COUNTED):
        part = zip(starts[at : at + COUNTED], stops[at : at + COUNTED], strict=False)
        hashes = np.array([digest(joined[a:b], 42) for a, b in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<i8")[0])


def _majority(hashes: np.ndarray) -> int:
    """Signed number of the bits that more than half of the hashes have set."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text in ascending order; fewer words make one shingle, no words none."""
    words = (text or "").encode("utf-8").lower().split()
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.array(sorted(xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8").view("<i8")


def word_fingerprint(text: str | None) -> tuple[int, int]:
    """Hash of the words in order, and fingerprint of the distinct ones; case and white space play no part."""
    words = (text or "").encode("utf-8").lower().split()
    whole = signed(xxhash.xxh64_intdigest(b" ".join(words), 42))
    if not words:
        return whole, 0
    return whole, _majority(np.array([xxhash.xxh64_intdigest(w, 42) for w in set(words)], "<u8"))


def with_fingerprint(df: DataFrame, text_col: str, width: int, name: str = "fp") -> DataFrame:
    """Add the fingerprint as a long; a column of that name is replaced, all others and all rows stay."""
    base = df.drop(name)
    at = base.columns.index(text_col)
    schema = with_fields(base.schema, f"`{name}` long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array((fingerprint(t.as_py(), width) for t in batch.column(at)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return base.mapInArrow(run, schema)


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << BITS - 1 else value


def covering_masks(radius: int) -> list[int]:
    """Masks of which one at least clears any ``radius`` bits or fewer."""
    count = (1 << radius + 1) - 1
    if count < BITS:
        # Vectors 1..count in turn, in an order that mixes neighbouring bits; none is zero.
        vectors = [1 + i * 0x9E3779B1 % count for i in range(BITS)]
    else:
        # Distinct vectors with the highest bit set. For radius 6 they are all there are, so half of them
        # have an odd number of ones in common with any v but the highest bit alone.
        vectors = [1 << radius | i * 0x9E3779B1 % (1 << radius) for i in range(BITS)]
    return [signed(sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)) for v in range(1, count + 1)]


def flips(most: int) -> list[int]:
    """All changes of at most ``most`` bits, none included."""
    return [signed(sum(1 << b for b in bits)) for n in range(most + 1) for bits in combinations(range(BITS), n)]


def _xor_each(fp: Column, values: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, values)), lambda v: fp.bitwiseXOR(v))


def links(fingerprints: DataFrame, radius: int) -> DataFrame:
    """``(fp)``, distinct -> edges ``(a, b)`` that connect what lies within ``radius`` bits.

    The edges are not all pairs within the radius, but every such pair is connected by them, and
    no edge is longer than the radius.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(covering_masks(radius))])
    tables = fingerprints.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("mask.t").alias("t"), F.col("fp").bitwiseAND(F.col("mask.m")).alias("key")
    )
    # Minimum and maximum tell whether a bucket has two members, however many it has.
    # Written down, so that the join reads both sides shuffled and a large bucket can be split.
    crowded = materialize(
        tables.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key")
    )
    near = materialize(tables.join(crowded, ["t", "key"], "left_semi").select("fp").distinct())
    half, rest = radius // 2, radius - radius // 2
    if half == rest:
        around = near.select("fp", F.explode(_xor_each(F.col("fp"), flips(half))).alias("point"))
        # Both lie within half the radius of the point; so at most 1 + 64 + ... fingerprints do.
        groups = around.groupBy("point").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        least = F.array_min("fps")
        return groups.select(least.alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    # The first reaches further than the second; a point is met by few from either side.
    first = near.select(F.col("fp").alias("a"), F.explode(_xor_each(F.col("fp"), flips(rest))).alias("point"))
    second = near.select(F.col("fp").alias("b"), F.explode(_xor_each(F.col("fp"), flips(half))).alias("point"))
    return first.join(second, "point").where("a < b or a > b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int = 5, radius: int = 2) -> DataFrame:
    """``(id, fp, component)`` for every row: texts whose fingerprints are linked share a component.

    ``component`` is the smallest id reachable by links of at most ``radius`` bits, the row's own
    included. Null and empty texts have fingerprint 0 and are linked like any other. Repeated
    rows and ids stay. A null id is no candidate for the smallest; a component of null ids only
    has a null component.
    """
    rows = materialize(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text", width).drop("__text"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(nodes.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    linked = materialize(nodes.join(roots, "fp"))
    heads = materialize(linked.groupBy("root").agg(F.min("first").alias("component")))
    moved = linked.join(heads, "root").select("fp", F.col("component").alias("moved"))
    verdict = materialize(nodes.join(moved, "fp", "left").select("fp", F.coalesce("moved", "first").alias("component")))
    # Both sides are shuffled from tables, so the rows of a frequent fingerprint can be split.
    return rows.join(verdict, "fp").select("id", "fp", "component")


def _key(id_col: str, text_col: str) -> Column:
    """Orders rows by id, null last, then by text."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def _units(nodes: DataFrame) -> DataFrame:
    """``(fp, head, n)``: fingerprints with their smallest node and number of nodes."""
    return nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))


def _entered(units: DataFrame, radius: int) -> DataFrame:
    """``(bucket, fp, n)``: fingerprints by their buckets, each bucket in one task and in its own order.

    The lowest ``radius + 1`` bits of a bucket number its table. Rows travel without their bucket, which is
    computed again where they arrive.
    """
    masks = covering_masks(radius)
    mask = F.element_at(F.array(*map(F.lit, masks)), F.col("t") + 1)
    bucket = F.shiftleft(F.xxhash64(mask, F.col("fp").bitwiseAND(mask)), radius + 1).bitwiseOR(F.col("t"))
    # A few orders, by table, so that a group has a few representatives and not just one.
    order = F.xxhash64("fp", F.pmod("t", F.lit(ORDERS)))
    rows = units.select("fp", "n", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t")).repartition(bucket)
    return rows.select(bucket.alias("bucket"), "fp", "n", order.alias("order")).sortWithinPartitions("bucket", "order").drop("order")


def _to_compare(bucket: int, fp: np.ndarray, n: np.ndarray, radius: int) -> np.ndarray:
    """Places of the fingerprints of a whole bucket, its representative first, whose nodes have still to be compared here.

    A pair is compared in the first table that it shares a bucket in. Single nodes have met their representative, and
    two nodes of one fingerprint have met each other.
    """
    table = bucket & (1 << radius + 1) - 1
    alone = (n > 2) & (table == 0)
    a, b = np.triu_indices(len(fp), 1)
    apart = (fp[a] ^ fp[b]).view("<u8")
    near = np.flatnonzero((np.bitwise_count(apart) <= radius) & ((a > 0) | (n[a] > 1) | (n[b] > 1)))
    masks = np.array(covering_masks(radius), np.int64).view("<u8")
    for at in range(0, len(near), COLUMNS):
        part = near[at : at + COLUMNS]
        here = part[((apart[part][:, None] & masks) == 0).argmax(axis=1) == table]
        alone[a[here]] = alone[b[here]] = True
    return np.flatnonzero(alone)


def _met(units: DataFrame, radius: int) -> DataFrame:
    """``(bucket, fp, rep)``: one pass over the buckets.

    The first fingerprint of a bucket represents it. Rows with ``rep`` are fingerprints within ``radius`` bits of their
    bucket's representative. Rows without are those of a bucket of three or more nodes that have still to be compared in
    it; in a bucket of more than ``BLOCK`` fingerprints all of them.
    """
    names = ["bucket", "fp", "rep"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the bucket that the last batch ended in: all up to BLOCK of them, or the first if the bucket has more.
        held, large = [np.zeros(0, np.int64)] * 3, False
        for columns in chain(([c.to_numpy() for c in b.columns] for b in batches if b.num_rows), [None]):
            last = columns is None
            old = len(held[0])
            bucket, fp, n = held if last else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(bucket):
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            sizes = np.diff([*starts, len(bucket)])
            first = np.repeat(starts, sizes)
            close = (np.bitwise_count((fp ^ fp[first]).view("<u8")) <= radius) & (np.arange(len(fp)) > first)
            close[:old] = False
            crowded = np.add.reduceat(n, starts) > 2
            crowded[0] |= large
            out = [near := np.flatnonzero(close)]
            for k in np.flatnonzero(crowded).tolist():
                start, stop = int(starts[k]), int(starts[k] + sizes[k])
                if large and k == 0:
                    out.append(np.arange(old, stop))
                elif sizes[k] > BLOCK:
                    out.append(np.arange(start, stop))
                elif last or k + 1 < len(sizes):
                    out.append(start + _to_compare(int(bucket[start]), fp[start:stop], n[start:stop], radius))
            at = np.concatenate(out)
            if len(at):
                rep = pa.array(fp[first[at]], mask=np.arange(len(at)) >= len(near))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(fp[at]), rep], names=names)
            large = bool(sizes[-1] > BLOCK or large and len(sizes) == 1)
            held = [c[starts[-1] : starts[-1] + (1 if large else BLOCK)] for c in (bucket, fp, n)]

    return materialize(_entered(units, radius).mapInArrow(walk, ", ".join(f"{n} long" for n in names)))


def _proposed(nodes: DataFrame, radius: int, units: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: nodes of one fingerprint, and heads of fingerprints within ``radius`` bits, each with its representative."""
    units = _units(nodes) if units is None else units
    met = _met(units.select("fp", "n"), radius) if met is None else met
    near = met.where("rep is not null").select("fp", "rep").distinct()
    a, b = units.select("fp", F.col("head").alias("x")), units.select(F.col("fp").alias("rep"), F.col("head").alias("y"))
    pairs = near.join(a, "fp").join(b, "rep").select("x", "y")
    pairs = pairs.unionByName(nodes.join(a, "fp").where("node <> x").select("x", F.col("node").alias("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _blocks(crowded: DataFrame) -> DataFrame:
    """Members ``(bucket, node, fp, group)`` of buckets with several groups, once for each pair of blocks they belong to.

    The largest group of a bucket has blocks of its own, which never meet each other, so what links
    with nothing else costs as much as there is of other groups. A small bucket is one block.
    """
    sizes = crowded.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups"))
    sizes = materialize(sizes.where("groups > 1").select("bucket", "all", "top"))
    rest = F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int")
    most = F.ceil(F.col("top.n") / BLOCK).cast("int")
    placed = crowded.join(sizes, "bucket").withColumns({"rest": rest, "most": most})
    number, small, inside = F.xxhash64("node"), F.col("all") <= BLOCK, F.col("group") == F.col("top.group")
    own = F.when(small, 0).when(inside, F.col("rest") + F.pmod(number, "most")).otherwise(F.pmod(number, "rest")).cast("int")
    last = F.when(small, 0).when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp", "group")


def _by_block(run: Callable[[pa.Table], pa.RecordBatch]):
    """A function for mapInArrow over rows sorted by (bucket, i, j): ``run`` gets the rows of one pair of blocks after the other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(3)]
            change = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                key = tuple(k[a] for k in keys)
                if held and key != last:
                    yield run(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield run(pa.Table.from_batches(held))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (made for made in each(batches) if made.num_rows)

    return work


def _waiting(block: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that are to be compared: of different groups, within ``radius`` bits, in no earlier table."""
    bucket, i, j, own, _, fp, group = (block.column(n).to_numpy() for n in range(7))
    apart = fp.view("<u8")[:, None] ^ fp.view("<u8")[None, :]
    near = (np.bitwise_count(apart) <= radius) & (group[:, None] != group[None, :])
    if i[0] != j[0]:
        # Pairs within one of the two blocks meet where that block meets itself.
        near &= own[:, None] != own[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    masks = np.array(covering_masks(radius), np.int64).view("<u8")
    table = int(bucket[0]) & (1 << radius + 1) - 1
    parts = [slice(at, at + COLUMNS) for at in range(0, len(a), COLUMNS)]
    here = [((apart[a[x], b[x]][:, None] & masks) == 0).argmax(axis=1) == table for x in parts]
    here = np.concatenate([np.zeros(0, bool), *here])
    return a[here], b[here]


def _in_common(sets: list[np.ndarray]) -> np.ndarray:
    """Number of elements that any two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, (_, at) = owner[shared], np.unique(at[shared], return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for begin in range(0, at[-1] + 1 if len(at) else 0, COLUMNS):
        part = slice(*np.searchsorted(at, [begin, begin + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[part], at[part] - begin] = 1
        both += has @ has.T
    return both


def _left_apart(crowded: DataFrame, sets: DataFrame, radius: int, least: float) -> DataFrame:
    """Links ``(a, b)`` between groups whose members ``(bucket, node, fp, group)`` are alike, as many as connect them."""
    order = ["bucket", "i", "j"]
    fields = "bucket long, i int, j int, own int, node long, fp long, group long"

    def ask(block: pa.Table) -> pa.RecordBatch:
        some = pa.array(np.unique(np.concatenate(_waiting(block, radius))), pa.int64())
        return pa.RecordBatch.from_arrays([c.combine_chunks().take(some) for c in block.columns], names=block.column_names)

    def link(block: pa.Table) -> pa.RecordBatch:
        a, b = _waiting(block, radius)
        group = block.column(6).to_numpy()
        shingles = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in block.column(7)]
        size, both = np.array([len(s) for s in shingles]), _in_common(shingles)[a, b]
        alike = both >= least * (size[a] + size[b] - both)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        found = []
        for x, y in zip(group[a[alike]].tolist(), group[b[alike]].tolist(), strict=True):
            if top(x) != top(y):
                parent[top(x)] = top(y)
                found.append((x, y))
        columns = [pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    # Only texts with a partner to be compared take their shingles along.
    met = _blocks(crowded).repartition(*order).sortWithinPartitions(*order)
    asked = materialize(met.mapInArrow(_by_block(ask), fields))
    full = asked.join(sets, "node").select(*asked.columns, "shingles").repartition(*order).sortWithinPartitions(*order)
    return full.mapInArrow(_by_block(link), "a long, b long")


def keep_first(docs: DataFrame, id_col: str, text_col: str, width: int = 5, least: float = 0.8, radius: int = 6) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, null ids last; same columns.

    Texts are linked if the sets of their ``width``-word shingles have a Jaccard similarity of ``least``
    or more; groups are what links connect. Texts that differ in case or white space only are
    alike, and so are all texts without words, null included. Rows that repeat id and text are one
    group; of these the one whose columns hash lowest stays.
    """
    key = _key(id_col, text_col)
    rows = docs.select(key.alias("key"), F.col(text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_fingerprint(t.as_py()) for t in batch.column(1)]
            made = [pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", "node", "fp"])

    scanned = rows.mapInArrow(scan, with_fields(rows.select("key").schema, "node long, fp long"))
    # Texts alike are one node before anything is compared.
    nodes = materialize(scanned.groupBy("node").agg(F.min("key").alias("first"), F.min("fp").alias("fp")))
    units = materialize(_units(nodes))
    met = _met(units.select("fp", "n"), radius)
    proposed = materialize(_proposed(nodes, radius, units, met))
    # In buckets of two the representative has met all there is.
    crowded = met.where("rep is null").select("bucket", "fp")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingle_set(t.as_py(), width) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["node", "shingles"])

    asked = proposed.select(F.explode(F.array("a", "b")).alias("node"))
    asked = asked.unionByName(crowded.select("fp").distinct().join(nodes, "fp").select("node")).distinct()
    asked = materialize(asked.join(nodes, "node").select("node", F.col("first").alias("key")))
    # Rows alike in id and text meet here once more.
    texts = rows.join(asked, "key").select("node", text_col)
    sets = materialize(texts.mapInArrow(shingle, "node long, shingles array<long>").dropDuplicates(["node"]))
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both >= least * (F.size("sa") + F.size("sb") - both)
    edges = proposed.join(a, "a").join(b, "b").where(alike).select("a", "b")

    roots = components(edges).select("node", "root")
    groups = materialize(nodes.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("group"), "first"))
    members = materialize(crowded.join(groups, "fp").select("bucket", "node", "fp", "group"))
    apart = _left_apart(members, sets, radius, least)
    further = components(apart).select(F.col("node").alias("group"), "root")
    groups = materialize(groups.join(further, "group", "left").select(F.coalesce("root", "group").alias("group"), "first"))
    kept = materialize(groups.groupBy("group").agg(F.min("first").alias("__key")).select("__key"))
    # Key by key: rows that repeat an id and a text come down to one. The columns travel as one, so that their names can't clash.
    given = docs.select(key.alias("__key"), F.struct(*docs.columns).alias("__row"), F.xxhash64(*docs.columns).alias("__order"))
    found = given.join(kept, "__key", "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__order")))
    return found.where("__n = 1").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
