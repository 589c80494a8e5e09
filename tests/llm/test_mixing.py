"""Mixing against an exact water filling, the bounds of the rounding, and odd rows."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from segqa.llm import mixing

SCHEMA = "doc_id long, text string, source string, hash long, n string"


def water_filling(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess, in fractions; ``sizes`` by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        left, mass = total - sum(stopped.values()), sum(weight[s] for s in open_)
        share = {s: Fraction(left * weight[s], mass) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: Fraction(most * sizes[s]) for s in above}


def rows_of(spark, sizes):
    """Documents ``(id, source, size)``."""
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, s, 7, "x") for i, s, n in sizes], SCHEMA)


def check(rows):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        longest[r.source] = max(longest[r.source], r.size)
    expected = water_filling(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(expected[r.source]))
        due = r.target / r.source_size if r.source_size else 0
        assert int(due) <= r.copies <= min(3, int(due) + 1)
    for s, words in taken.items():
        assert abs(words - expected[s]) <= longest[s] / 2 + 1e-6
    return taken


def test_targets_stop_at_the_limit_and_the_excess_is_reshared(spark):
    sizes = {"a": 10, "B": 1000, "c": 500, "é": 1, "z": 3, None: 40}
    given = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.with_targets(given).collect()}
    expected = water_filling(sizes)
    assert got == {s: pytest.approx(float(t)) for s, t in expected.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_transfer_keeps_the_words_and_leaves_one_fraction():
    rng = np.random.default_rng(5)
    taken = np.zeros(12)
    for _ in range(4000):
        size = [1, 2, 3, 50, 400, 7, 7, 9, 12, 90, 0, 5]
        share = [0.3] * 12
        before = sum(a * b for a, b in zip(size, share, strict=True))
        mixing.transfer(size, share, rng.random(12).tolist())
        assert sum(0 < s < 1 for s in share) <= 1
        assert sum(a * b for a, b in zip(size, share, strict=True)) == pytest.approx(before)
        taken += share
    assert taken / 4000 == pytest.approx(np.full(12, 0.3), abs=0.03)


def test_many_blocks_and_levels_keep_to_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rng = np.random.default_rng(1)
    docs = rows_of(spark, [(i, f"s{min(int(rng.integers(0, 9)), 5)}", int(rng.integers(1, 60))) for i in range(700)])
    first = mixing.copies(docs).collect()
    assert len(first) == 700
    check(first)
    again = mixing.copies(docs.repartition(7, "text")).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_nulls_empty_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 8)
    docs = rows_of(spark, [(None, None, 4)] * 30 + [(1, "a", 5)] * 21 + [(2, "a", None), (3, "b", 0), (None, "c", None), (4, "d", 700)])
    rows = mixing.copies(docs).collect()
    assert len(rows) == docs.count()
    check(rows)
    shared = defaultdict(set)
    for r in rows:
        shared[r.id, r.source].add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in shared.values())
    assert mixing.copies(docs.limit(0)).collect() == []
    nothing = mixing.copies(rows_of(spark, [(1, "a", 0), (2, None, None)])).collect()
    assert [(r.target, r.copies) for r in nothing] == [(0.0, 0)] * 2


def test_the_mix_holds_whole_rows(spark):
    docs = rows_of(spark, [(i, f"s{i % 4}", 1 + i % 13) for i in range(200)] + [(5, "s1", 6)] * 3)
    wanted = Counter()
    for r in mixing.copies(docs).collect():
        wanted[r.id, r.source, r.size] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed.collect())
    assert got == +wanted


def test_query_over_documents(spark, sf_dir):
    got = entry.queries()["op11_pivotal_mixing"](spark, sf_dir)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert dict(got.dtypes) | {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"} == dict(got.dtypes)
    rows = got.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and r.taken == r.size * r.copies
    check(rows)
