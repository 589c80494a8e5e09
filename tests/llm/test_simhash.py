import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segqa.llm import simhash
from segqa.llm.components import components


def smallest_reachable(nodes, edges):
    """Brute force: the smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_some_mask_clears_any_bits_within_the_radius(radius):
    masks, rnd = simhash.covering_masks(radius), random.Random(radius)
    assert len(set(masks)) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        bits = simhash.signed(sum(1 << b for b in rnd.sample(range(64), radius)))
        assert any(m & bits == 0 for m in masks)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "É é Ab\x0bc d e f g", "x " * 70_000 + "y z", "a b c\x1cd e"])
def test_fingerprint_equals_plain_one(text):
    for width in (3, 5):
        assert simhash.fingerprint(text, width) % (1 << 64) == plain_fingerprint(text, width)


def test_hash_is_that_of_the_sql_function(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("é b c".encode(), 42)


@pytest.mark.parametrize("shape", ["path", "star", "random", "cliques"])
def test_components_equal_brute_force(spark, shape):
    rnd = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(999, i) for i in range(300)],
        "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)],
        "cliques": [(k * 50 + a, k * 50 + b) for k in range(5) for a, b in combinations(range(9), 2)],
    }[shape]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = smallest_reachable({x for e in edges for x in e}, edges)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: r for n, r in expected.items() if n not in alone}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_all_pairs_within_the_radius_and_no_others(spark, radius):
    rnd = random.Random(radius)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for s in seeds for _ in range(12)}
    signed = [simhash.signed(f) for f in fps]
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()]
    far = [(a, b) for a, b in edges if ((a ^ b) % (1 << 64)).bit_count() > radius]
    assert not far
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= radius]
    assert smallest_reachable(signed, edges) == smallest_reachable(signed, near)


def test_near_duplicates_with_odd_rows(spark):
    body = " ".join(f"w{i}" for i in range(400))
    rows = [(5, body), (3, body + " tail"), (9, None), (8, ""), (None, " \n"), (4, "alone here now then"), (4, "alone here now then"), (None, "b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {(r.id, r.fp): r.component for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    long_ones = {k: v for k, v in got.items() if k[0] in (3, 5)}
    assert set(long_ones.values()) == {3}
    assert {v for (i, fp), v in got.items() if fp == 0} == {8}
    assert [v for (i, fp), v in got.items() if i == 4] == [4]
    assert [v for (i, fp), v in got.items() if i is None and fp] == [None]
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def jaccard(a, b, width=5):
    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_keep_first_keeps_one_of_each_group(spark):
    rnd = random.Random(8)
    texts = []
    for g in range(25):
        words = [f"g{g}w{rnd.randrange(500)}" for _ in range(rnd.randrange(60, 250))]
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(4)):
            changed = list(words)
            for _ in range(rnd.randrange(0, 4)):
                changed[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(changed))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    near = [(a, b) for (a, x), (b, y) in combinations(rows, 2) if jaccard(x, y) >= 0.8]
    expected = smallest_reachable(ids, near)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = simhash.keep_first(df, "doc_id", "text")
    assert got.columns == df.columns
    kept = {r.doc_id for r in got.collect()}
    heads = {i for i in ids if expected[i] == i}
    # None that should stay goes; of the rest nearly all go.
    assert heads <= kept and len(kept - heads) <= 0.05 * (len(ids) - len(heads))


def test_keep_first_with_odd_rows(spark):
    rows = [(3, None, "a"), (2, " ", "b"), (None, "", "c"), (5, "Few words", "d"), (4, "few  WORDS", "e"), (4, "few  WORDS", "f"), (None, "only here", "g"), (None, "only here", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(2, " "), (4, "few  WORDS"), (None, "only here")], key=str)
    assert simhash.keep_first(df.limit(0), "doc_id", "text").count() == 0


def test_masks_of_radius_six_keep_half_of_the_bits():
    masks, rnd = simhash.covering_masks(6), random.Random(6)
    assert len(set(masks)) == 127
    assert sorted((m % (1 << 64)).bit_count() for m in masks) == [32] * 126 + [64]
    for _ in range(3000):
        bits = simhash.signed(sum(1 << b for b in rnd.sample(range(64), 6)))
        assert any(m & bits == 0 for m in masks)


def test_pairs_at_six_bits_are_proposed_among_many_unrelated_ones(spark):
    rnd = random.Random(7)
    fps = [rnd.getrandbits(64) for _ in range(4000)]
    planted = {(n, 4000 + n) for n in range(100)}
    fps += [fps[n] ^ sum(1 << b for b in rnd.sample(range(64), 6)) for n in range(100)]
    nodes = spark.createDataFrame([(n, simhash.signed(f)) for n, f in enumerate(fps)], "node long, fp long")
    assert planted <= {(r.a, r.b) for r in simhash._proposed(nodes, 6).collect()}


def test_keep_first_finds_near_copies_within_a_template_family(spark):
    rnd = random.Random(9)
    template = [f"t{n}" for n in range(260)]
    rows = []
    for n in range(500):
        words = [*template, *(f"p{n}w{k}" for k in range(40))]
        copy = list(words)
        copy[260 + rnd.randrange(40)] = f"new{n}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
    assert jaccard(rows[0][1], rows[1][1]) > 0.9 and jaccard(rows[0][1], rows[2][1]) < 0.8
    prints = {i: simhash.word_fingerprint(t)[1] for i, t in rows}
    near = [n for n in range(500) if ((prints[2 * n] ^ prints[2 * n + 1]) % (1 << 64)).bit_count() <= 6]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert len(near) > 450 and {2 * n for n in range(500)} <= kept
    assert [n for n in near if 2 * n + 1 in kept] == []


def test_elements_in_common():
    rnd = random.Random(10)
    sets = [{rnd.randrange(20_000) for _ in range(rnd.randrange(6000))} for _ in range(12)]
    got = simhash._in_common([np.array(sorted(s), np.int64) for s in sets])
    assert got.tolist() == [[len(a & b) if a is not b else len(a & set().union(*(s for s in sets if s is not a))) for b in sets] for a in sets]


def test_one_pass_over_buckets_whatever_the_batches(spark, monkeypatch):
    rnd = random.Random(11)
    apart = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = {simhash.signed(b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(4)))) for b in base for _ in range(rnd.choice([1, 2, 3, 30]))}
    units = [(fp, rnd.choice([1, 1, 2, 5])) for fp in fps]
    count = dict(units)
    given = spark.createDataFrame(units, "fp long, n long")
    buckets = {}
    for fp, _ in units:
        for t, m in enumerate(simhash.covering_masks(6)):
            buckets.setdefault((t, fp & m), set()).add(fp)
    near = {(a, b) for a, b in combinations(sorted(fps), 2) if apart(a, b) <= 6}
    for rows, block in (("2", 256), ("10000", 256), ("7", 5)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        found = simhash._met(given, 6).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        met, proposed = {}, {}
        for r in found:
            if r.rep is None:
                met.setdefault(r.bucket, []).append(r.fp)
            else:
                proposed.setdefault((r.bucket, r.rep), []).append(r.fp)
        assert len({b for b, _ in proposed}) == len(proposed)
        for (bucket, rep), close in proposed.items():
            (members,) = [b for (t, _), b in buckets.items() if t == bucket % 128 and {rep, *close} <= b]
            assert sorted(close) == sorted(x for x in members if x != rep and apart(x, rep) <= 6)
        # Every pair has met its representative, if both are single, or is to be compared in a bucket; nothing comes twice.
        assert all(len(b) == len(set(b)) for b in met.values())
        direct = {tuple(sorted((rep, x))) for (_, rep), close in proposed.items() for x in close}
        together = {pair for b in met.values() for pair in combinations(sorted(b), 2)}
        assert all(p in together or p in direct and count[p[0]] == count[p[1]] == 1 for p in near)
        assert {x for x, n in units if n > 2} <= {x for bucket, b in met.items() if bucket % 128 == 0 for x in b}
        # A bucket of up to a block holds only what has a partner there.
        if block == 256:
            assert all(count[x] > 2 or any(apart(x, y) <= 6 for y in b if y != x) for b in met.values() for x in b)
