import random

from segqa.llm import line_dedup

LONG = [f"This is line number {i} of the story." for i in range(40)]


def texts_after(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lines string")
    got = line_dedup.drop_duplicate_lines(df, **options)
    assert got.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_alignment_is_increasing_and_equal():
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.randrange(12) for _ in range(rnd.randrange(25))]
        b = [rnd.randrange(12) for _ in range(rnd.randrange(25))]
        pairs = line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.aligned([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    # Lines that occur once come first, as in a patience diff, and their neighbours follow.
    assert line_dedup.aligned([0, 7, 0, 8, 0], [9, 7, 0, 8, 9]) == [(1, 1), (2, 2), (3, 3)]


def test_blocks_go_from_the_later_document(spark):
    rows = [
        (1, "\n".join(["Own first line of all here.", *LONG[:5], "end"])), (2, "\n".join(["Another own first line here.", *LONG[:5], "", "bye"])),
        (3, "\n".join(["short", "Third own line stays right here."])), (4, "\n".join(["short", "Fourth own line stays right here."])),
    ]
    got = dict(texts_after(spark, rows))
    assert got[1] == rows[0][1]
    assert got[2] == "Another own first line here.\n\nbye"
    assert got[3] == rows[2][1] and got[4] == rows[3][1]


def test_a_text_that_many_have_stays_once(spark):
    body = "\n".join(LONG)
    got = texts_after(spark, [(i, body) for i in range(30)])
    assert got[0] == (0, body) and {t for _, t in got[1:]} == {""}


def test_every_line_survives_somewhere(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        at = rnd.randrange(30)
        rows.append((i, "\n".join([*LONG[at : at + rnd.randrange(12)], f"Only document {i} has this line.", *rnd.sample(LONG, 3)])))
    before = {line for _, t in rows for line in t.split("\n")}
    got = texts_after(spark, rows)
    assert {line for _, t in got for line in t.split("\n")} == before
    kept, given = sum(len(t) for _, t in got), sum(len(t) for _, t in rows)
    assert kept < 0.6 * given


def test_odd_rows(spark):
    rows = [(None, LONG[0]), (None, LONG[0]), (2, LONG[0]), (2, LONG[0]), (3, None), (4, ""), (5, "\n\n"), (6, "  " + LONG[0] + " \n" + "z" * 100_000)]
    got = texts_after(spark, rows)
    # Null ids come after all others; rows alike in id and text are one document.
    expected = [(None, ""), (None, ""), (2, LONG[0]), (2, LONG[0]), (3, None), (4, ""), (5, "\n\n"), (6, "z" * 100_000)]
    assert got == sorted(expected, key=str)
    assert texts_after(spark, []) == []


def test_passages_in_another_order_go(spark):
    p, q = "\n".join(LONG[:8]), "\n".join(LONG[8:16])
    got = dict(texts_after(spark, [(1, f"{q}\n{p}"), (2, f"{p}\n{q}"), (3, f"{p}\n{q}"), (4, f"{p}\nThe fourth has a line of its own.\n{q}")]))
    assert got == {1: f"{q}\n{p}", 2: "", 3: "", 4: "The fourth has a line of its own."}


def test_held_runs_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(500):
        words = [rnd.randrange(4) for _ in range(8)]
        a, b = ([rnd.randrange(8) for _ in range(rnd.randrange(20))] for _ in range(2))
        got = set(line_dedup.held_runs(a, b, [words[x] for x in b], 5))
        expected = set()
        for start in range(len(b)):
            for end in range(start + 1, len(b) + 1):
                part = b[start:end]
                if words[part[0]] and sum(words[x] for x in part) >= 5 and any(a[i : i + len(part)] == part for i in range(len(a))):
                    expected |= set(range(start, end))
                    break
        # All of every shortest run goes; what follows it goes if it is alike.
        assert expected <= got
        assert all(any(a[i : i + 1] == [b[j]] for i in range(len(a))) for j in got)


def test_short_lines_unspaced_scripts_and_repeated_passages_link(spark):
    verse = "\n".join(f"{a} {b}" for a, b in zip("red sun cold moon far hill".split(), "old sky pale sea deep well".split(), strict=True))
    chinese = "\n".join(["今天的天气非常好我们去公园散步", "他们在图书馆里看了一整天的书"])
    twice = "\n".join([*LONG[:6], "The passage comes once more now.", *LONG[:6]])
    rows = [
        (1, f"One document has this first line.\n{verse}"), (2, f"Two begins in words of its own.\n{verse}"),
        (3, chinese), (4, f"第四份文件自己的第一行文字内容\n{chinese}"),
        (5, twice), (6, "\n".join(["Six has a passage that five repeats.", *LONG[:6]])),
        (7, "\n".join(LONG[10:16])), (8, "\n".join([*LONG[10:16], "Eight has what seven has two times.", *LONG[10:16]])),
    ]
    got = dict(texts_after(spark, rows))
    assert [got[i] for i in (1, 3, 5, 7)] == [rows[i - 1][1] for i in (1, 3, 5, 7)]
    assert got[2] == "Two begins in words of its own." and got[4] == "第四份文件自己的第一行文字内容"
    assert got[6] == "Six has a passage that five repeats." and got[8] == "Eight has what seven has two times."


def test_texts_meet_their_places_by_key_at_any_size(spark):
    df = spark.createDataFrame([(0, LONG[0]), (1, LONG[0])], "doc_id long, text string")
    plan = line_dedup.drop_duplicate_lines(df)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
