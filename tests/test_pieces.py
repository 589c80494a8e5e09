"""Pieces of texts against plain substrings, and the filter."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segqa.operators import pieces

TEXTS = ["", "a", "ąęć", "abcdefgh", "abcdefghi", None, "źdźbło trawy " * 40, "x" * 30]


def plain(text, size):
    data = (text or "").encode()
    return {data[i : i + size] for i in range(len(data) - size + 1)}


@pytest.mark.parametrize("step", [5, 64, 1 << 18])
def test_pieces_are_all_substrings_of_a_size(monkeypatch, step):
    monkeypatch.setattr(pieces, "STEP", step)
    for size in (1, 3, 8):
        found = {}
        for row, key in pieces.piece_keys(pa.array(TEXTS, pa.string()).slice(1), [size]):
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                found.setdefault(r, set()).add(k)
        key_of = {}
        for n, text in enumerate(TEXTS[1:]):
            wanted = {int(pieces.mixed(np.array([int.from_bytes(p, "little")], np.uint64), size).view(np.int64)[0]): p for p in plain(text, size)}
            assert found.get(n, set()) == set(wanted)
            key_of |= wanted
        assert len(key_of) == len({p for t in TEXTS[1:] for p in plain(t, size)})


def test_filter_lets_through_what_it_holds_and_little_else(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000, np.int64)
    rows = pieces.key_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    known = pieces.Filter(rows)
    assert known.may_hold(keys).all()
    assert known.may_hold(rng.integers(-(1 << 63), (1 << 63) - 1, 200_000, np.int64)).sum() < 20
    assert not pieces.Filter({}).may_hold(keys).any()


def test_rows_leave_the_scan_only_if_they_may_match(spark):
    texts = spark.createDataFrame([(i, f"tekst {i} o migracji globalnej" if i % 50 == 0 else f"inny tekst {i}") for i in range(2000)], "id long, t string")
    wordings = spark.createDataFrame([(1, "migracji globalnej"), (2, "zupełnie coś innego")], "id int, w string")
    held = pieces.pieces_of(wordings, "id", "w").cache()
    assert held.groupBy("id").count().orderBy("id").collect()[0][1] == len(plain("migracji globalnej", 8))
    one = held.where("id = 1").limit(1).unionByName(held.where("id = 2"))
    met = pieces.lookups(texts, "t", F.lit(0).cast("long"), pieces.key_filter(one.select("key")), [8])
    assert met.columns == ["id", "t", "key"] and met.count() == 40
    counts = pieces.piece_counts(texts, "t", pieces.key_filter(one.select("key")), [8])
    assert [r.n for r in counts.collect()] == [40]
