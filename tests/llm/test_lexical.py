"""Ranked search against brute force; bounds of the tree; odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from segqa.llm import lexical

DOCS = "doc_id long, text string, item long, score string"
ITEMS = "item_id long, text string, doc_id string"


def plain(docs, items, limit):
    """``docs`` and ``items`` as lists of (id, text)."""
    said = [(i, lexical.terms(t)) for i, t in docs]
    said = [(i, t) for i, t in said if t]
    n, length = len(said), sum(len(t) for _, t in said)
    df = Counter(t for _, ts in said for t in set(ts))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in set(items):
        wanted = set(lexical.terms(text))
        scores = []
        for i, ts in said:
            tf, m = Counter(ts), 50 + (50 * len(ts) * n) // length
            score = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if t in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=repr)


def made(spark, docs, items, limit=50, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(parts)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    got = lexical.search(d, b, limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(seed, n, words=120):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, words + 1)
    pick = lambda k: " ".join(f"w{x}" for x in rng.choice(words, k, p=odds / odds.sum()))
    docs = [(i, pick(int(rng.integers(1, 80)))) for i in range(n)]
    return docs + [(n + i, docs[i % 7][1]) for i in range(60)], pick


def test_terms():
    assert lexical.terms("Ab-c9 É x_y\tZ") == ["ab", "c9", "É x", "y", "z"]
    assert lexical.terms(None) == lexical.terms(" .,") == []


@pytest.mark.parametrize("limit", [1, 5, 50])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lexical, "BLOCK", 64)
    monkeypatch.setattr(lexical, "TREE_ITEMS", 3)
    docs, pick = corpus(3, 400)
    items = [(i, pick(6)) for i in range(11)]
    assert made(spark, docs, items, limit) == plain(docs, items, limit)


def test_several_passes_and_small_matrices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_TERMS", 12)
    monkeypatch.setattr(lexical, "CELLS", 200)
    docs, pick = corpus(4, 150)
    items = [(i, pick(7)) for i in range(6)]
    assert made(spark, docs, items, 9) == plain(docs, items, 9)


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (2, "a b c"), (2, "a b c"), (1, None), (4, ""), (5, "..."), (6, "Zebra"), (7, "q " * 30000)]
    items = [(1, "B a"), (1, "B a"), (1, "zebra"), (None, "a"), (2, None), (3, ""), (4, "nowhere"), (5, "q " * 500)]
    got = made(spark, docs, items, 4)
    assert got == plain(docs, items, 4)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] is None] == [2, 2, 3, None]
    assert made(spark, docs, []) == made(spark, [], items) == made(spark, [(1, None)], items) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(c, 0.2, (200, 12)) for c in rng.normal(0, 30, (10, 12))]) * 1e5
    tree = lexical.ball_tree(points)
    for node, (begin, end) in enumerate(zip(tree.begin, tree.end, strict=True)):
        apart = np.sqrt(((points[tree.order[begin:end]] - tree.centroid[node]) ** 2).sum(axis=1))
        assert (apart <= tree.radius[node]).all()
        if child := tree.child[node]:
            assert (tree.begin[child], tree.end[child + 1]) == (begin, end) and tree.end[child] == tree.begin[child + 1]
            assert begin < tree.end[child] < end
        else:
            assert end - begin <= lexical.LEAF
    # A tight cluster for each item: nearly all of the others is never scored.
    times = np.zeros((4000, 20), np.int64)
    times[np.arange(4000), np.arange(4000) % 20] = 3
    owner, term = np.nonzero(times)
    searcher = lexical.Searcher([np.array([i]) for i in range(20)], np.full(20, 2500), 4000, 12000, 10)
    searcher.block(range(4000), [3] * 4000, owner, term, times[owner, term])
    assert searcher.scored < 0.1 * 20 * 4000
    assert sorted(d for i, d, _ in searcher.results() if i == 4) == list(range(4, 204, 20))
