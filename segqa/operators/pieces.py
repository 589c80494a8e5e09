"""Which of many wordings a text may hold, found by short pieces of bytes.

A text holds a wording only if it holds every piece of ``PIECE`` bytes of it, or the whole of a
shorter one. Pieces are keys of eight bytes. Tasks get a filter of the keys that are wanted, of a fixed
size whatever their number, and drop all other pieces of a text where it is read, so nothing but
likely matches is ever shuffled. What the filter lets through by chance finds no partner later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE = 8
# Bits of the filter: 16 MB at most; two of them stand for a key.
FILTER_BITS = 27
# Bytes of text whose pieces are made in one step.
STEP = 1 << 18
# Bits of one row of Spark's bitmap functions.
ROW_BITS = 32768


def mixed(piece: np.ndarray, size: int) -> np.ndarray:
    """Keys of pieces of one size: different pieces have different keys, with all bits in use."""
    x = piece + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def piece_keys(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, key)`` of all pieces of the given sizes of a column of texts, part by part; nulls have none."""
    for row, _, key in _pieces(texts, sizes):
        yield row, key


def piece_places(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place, key)`` likewise, with the byte of its text that a piece starts at."""
    for _, place, key in _pieces(texts, sizes):
        yield place, key


def _pieces(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for start in range(int(offsets[0]), int(offsets[-1]), STEP):
        stop = min(start + STEP, int(offsets[-1]))
        part = data[start : stop + PIECE - 1].astype(np.uint64)
        piece = np.zeros(len(part) + PIECE, np.uint64)
        for k in range(PIECE):
            piece[: len(part) - k] |= part[k:] << np.uint64(8 * k) if k < len(part) else np.uint64(0)
        place = np.arange(start, stop)
        row = np.searchsorted(offsets, place, side="right") - 1
        left = offsets[row + 1] - place
        for size in sizes:
            whole = np.flatnonzero(left >= size)
            if len(whole):
                low = piece[whole] & np.uint64((1 << 8 * size) - 1)
                yield row[whole], place[whole] - offsets[row[whole]], mixed(low, size).view(np.int64)


def bits_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << FILTER_BITS) - 1
    return key & mask, key >> (63 - FILTER_BITS) & mask


def key_filter(keys: DataFrame) -> dict[int, bytes]:
    """Rows of the filter of ``keys(key)`` that have a bit set, made by Spark; its size is bounded by ``FILTER_BITS``."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    # As bits_of; Spark's bitmaps count from 1.
    bits = [F.col("key").bitwiseAND(mask), F.shiftright("key", 63 - FILTER_BITS).bitwiseAND(mask)]
    each = keys.select(F.explode(F.array(*bits)).alias("bit"))
    rows = each.groupBy(F.floor(F.col("bit") / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("bits"))
    return {r["row"]: bytes(r["bits"]) for r in rows.collect()}


class Filter:
    """Tests keys against the rows of :func:`key_filter`."""

    def __init__(self, rows: dict[int, bytes]) -> None:
        self.bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for row, bits in rows.items():
            self.bits[row * (ROW_BITS // 8) : (row + 1) * (ROW_BITS // 8)] = np.frombuffer(bits, np.uint8)

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        one, other = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 for bit in bits_of(key))
        return (one & other).astype(bool)


def pieces_of(wordings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, size, key)``: the pieces a text must hold to hold the wording."""
    rows = wordings.select(F.col(id_col).alias("id"), F.least(F.octet_length(text_col), F.lit(PIECE)).alias("size"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            for size in range(1, PIECE + 1):
                chosen = pa.array(np.flatnonzero(sizes == size))
                if not len(chosen):
                    continue
                ids = batch.column(0).take(chosen)
                for row, key in piece_keys(batch.column(2).take(chosen), [size]):
                    columns = [ids.take(pa.array(row)), pa.array(np.full(len(row), size, np.int32)), pa.array(key)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "key"])

    schema = StructType([rows.schema["id"], *StructType.fromDDL("size int, key long").fields])
    return rows.where("size > 0").mapInArrow(run, schema).distinct()


def piece_counts(texts: DataFrame, text_col: str, wanted: dict[int, bytes], sizes: Sequence[int]) -> DataFrame:
    """``(key, n)``: how often the pieces that the filter lets through occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(wanted)
        for batch in batches:
            found = [key[known.may_hold(key)] for _, key in piece_keys(batch.column(0), sizes)]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return texts.select(text_col).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def lookups(texts: DataFrame, text_col: str, other_key: Column, wanted: dict[int, bytes], sizes: Sequence[int]) -> DataFrame:
    """Rows of ``texts`` with ``key``, once for each of their pieces, and of their ``other_key``, that the filter lets through."""
    rows = texts.withColumn("key", other_key)
    at = texts.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(wanted)
        for batch in batches:
            other = batch.column(batch.num_columns - 1)
            found = [(np.arange(len(other)), other.fill_null(0).to_numpy(zero_copy_only=False)), *piece_keys(batch.column(at), sizes)]
            kept = [(row[hit], key[hit]) for row, key in found if (hit := known.may_hold(key)).any()]
            if kept:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*kept, strict=True)], axis=1), axis=0)
                columns = [c.take(pa.array(pairs[:, 0])) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pairs[:, 1])], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
