import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segqa.llm import packing


def spread(plan):
    """sequence -> sorted (offset, length) of the plan's runs, and how many pieces of each length it has."""
    placed, seen = defaultdict(list), Counter()
    for n, first, number, sequence, each, offset in plan.runs:
        assert first == seen[n]
        seen[n] += number
        for i in range(number):
            placed[sequence + i // each].append((offset + i % each * n, n))
    return placed, seen


def check(counts, capacity):
    plan = packing.plan_packing(counts, capacity, rounds=20)
    placed, seen = spread(plan)
    assert seen == Counter({n: c for n, c in counts.items() if c})
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(placed) == set(range(plan.sequences))
    return plan.sequences


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
def test_plan_places_every_piece_once(counts):
    total = sum(n * c for n, c in counts.items())
    got = check(counts, 64)
    assert -(-total // 64) <= got <= -(-2 * total // 64) + 1


def test_many_lengths_come_close_to_the_bound():
    rnd = random.Random(1)
    counts = Counter(min(256, int(rnd.lognormvariate(4, 0.9)) + 1) for _ in range(20_000))
    bound = -(-sum(n * c for n, c in counts.items()) // 256)
    assert check(counts, 256) <= bound * 1.002 + 1


def test_program_beats_best_fit_where_that_is_led_astray():
    # 4 + 3 + 3 fills a sequence of ten, but best fit starts with 4 + 4.
    counts = {4: 300, 3: 600}
    assert packing.plan_packing(counts, 10, rounds=0).sequences > 300
    assert check(counts, 10) == 300


def test_lengths_out_of_range_are_refused():
    with pytest.raises(ValueError, match="between"):
        packing.plan_packing({11: 1}, 10)


def test_pieces_and_sequences_hold_every_token_once(spark, vocabulary, library):
    texts = ["one two three " * 40, "", None, "Short.", "Short.", "x" * 700, "half of it " * 9]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    pieces = packing.token_pieces(df, vocabulary, 32, with_ids=True)
    packed = packing.pack(pieces, "length", 32)
    rows = packed.collect()
    for i, text in enumerate(texts):
        if i != 3:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
            expected = library.encode(text or "", add_special_tokens=False).ids + [1]
            assert sum((r.ids for r in own), []) == expected
            assert [r.start for r in own] == [32 * n for n in range(len(own))]
            assert all(r.length == 32 for r in own[:-1])
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.ids))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for sequence, parts in by_sequence.items():
        joined = sum((ids for _, ids in sorted(parts)), [])
        assert whole[sequence] == joined and len(joined) <= 32
        assert [o for o, _ in sorted(parts)] == [sum(len(i) for _, i in sorted(parts)[:n]) for n in range(len(parts))]


def test_packing_odd_lengths(spark):
    df = spark.createDataFrame([(None, "a"), (0, "b"), (5, "c"), (5, "c")], "length int, note string")
    rows = {(r.note, r.sequence_id, r.offset) for r in packing.pack(df, "length", 10).collect()}
    assert rows == {("a", None, None), ("b", None, None), ("c", 0, 0), ("c", 0, 5)}
    assert packing.pack(df.limit(0), "length", 10).count() == 0
    with pytest.raises(ValueError, match="longer"):
        packing.pack(df, "length", 4)
