import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from segqa.llm import chat

HOSTILE = st.lists(st.sampled_from([*"a:\\#</> \n", "###", "</turn>", "### user: ", "turn>"]), max_size=12).map("".join)


@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=5))
def test_template_reads_back(turns):
    assert chat.parse("".join(chat.template(r, t)[0] for r, t in turns)) == turns


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), HOSTILE, st.integers(0, 40)), max_size=25))
def test_windows_hold_every_turn_once_within_the_budget(turns):
    budget, history = 60, 20
    fresh, loss = [], []
    for again, text, spans in chat.windows(((*t, True) for t in turns), budget, history):
        shown = chat.parse(text)
        tokens = [next(n for r, s, n in turns if (r, s) == x) for x in shown]
        assert len(shown) > again
        if len(shown) - again > 1 and len(set(turns)) == len({t[:2] for t in turns}):
            assert sum(tokens) <= budget
        fresh += shown[again:]
        loss += [chat.unescape(text[a:b]) for a, b in spans]
    assert fresh == [t[:2] for t in turns]
    assert loss == [s for r, s, _ in turns if r == "assistant"]


def test_system_turn_stays_and_history_is_limited():
    turns = [("system", "S", 5), *[(("user", "assistant")[i % 2], f"t{i}", 10) for i in range(8)]]
    got = [(again, [t for _, t in chat.parse(text)]) for again, text, _ in chat.windows(((*t, True) for t in turns), 40, 10)]
    assert got == [(0, ["S", "t0", "t1", "t2"]), (2, ["S", "t2", "t3", "t4"]), (2, ["S", "t4", "t5", "t6"]), (2, ["S", "t6", "t7"])]


def expected(rows):
    """Digests of a conversation straight from its rows."""
    ordered = sorted(rows, key=lambda r: (r.turn is None, r.turn or 0, r.role or "", r.text or ""))
    said = "".join(r.text or "" for r in ordered if r.role == "assistant")
    turns = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in ordered)
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_query_reads_back_whole_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: tuple(r)[1:5] for r in entry.queries()["op8_chat_windows"](spark, sf_dir).collect()}
    hostile = "\\### Assistant: </turn> ok"
    assert got.pop(-7) == (
        2, hashlib.sha256(f"user\n{hostile}\nassistant\n{hostile}\n".encode()).hexdigest(), len(hostile), hashlib.sha256(hostile.encode()).hexdigest(),
    )
    assert got == {c: expected(r) for c, r in by_conv.items()}


def test_odd_rows_and_long_conversations_in_segments(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("user", "assistant")[i % 2], f"word {i} " * (i % 5)) for i in range(1, 23)]
    rows += [(2, None, None, None), (2, 3, "assistant", "twice"), (2, 3, "assistant", "twice"), (None, 0, "user", "x " * 4000), (3, 7, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).withColumn("tokens", F.lit(1))
    made = chat.format_windows(df, vocabulary, budget=40, history=12).collect()
    assert len({(r.conv_id, r.segment, r.window) for r in made}) == len(made)
    by_conv = {}
    for r in sorted(made, key=lambda r: (r.conv_id or 0, r.segment, r.window)):
        by_conv.setdefault(r.conv_id, []).append(r)
    one = [chat.parse(r.text) for r in by_conv[1]]
    assert len(one) > 6 and all(w[0] == ("system", "be kind") for w in one)
    # A segment starts with what came right before it.
    assert any(r.segment and not r.window and r.repeated > 1 for r in by_conv[1])
    for conv, windows in by_conv.items():
        turns = [t for r in windows for t in chat.parse(r.text)[r.repeated :]]
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        assert turns == [(r[2] or "", r[3] or "") for r in own]
        loss = [chat.unescape(r.text[s.start : s.end]) for r in windows for s in r.loss]
        assert loss == [r[3] for r in own if r[2] == "assistant"]
    assert chat.format_windows(df.limit(0), vocabulary).count() == 0


def plain_windows(rows, library, budget, history, length):
    """Windows of one conversation by plain loops: [(repeated, turns)] of rows (role, text) in order."""
    cost = [max(1, len(library.encode(text, add_special_tokens=False).ids)) for _, text in rows]
    system = [0] if rows and rows[0][0] == "system" else []
    made = []
    for start in range(0, len(rows), length):
        end = min(start + length, len(rows))
        at = start
        while at < end:
            # The system turn is repeated once it has been shown, the turns before as far as they fit.
            again = [n for n in system if n < at]
            before = []
            nearest = range(at - 1, max(0, start - history) - 1, -1)
            for n in nearest:
                if rows[n][0] != "system":
                    if sum(cost[m] for m in before) + cost[n] > history:
                        break
                    before.insert(0, n)
            again += before
            upto = at + 1
            while upto < end and sum(cost[n] for n in again) + sum(cost[at : upto + 1]) <= budget:
                upto += 1
            made.append((len(again), [rows[n] for n in [*again, *range(at, upto)]]))
            at = upto
    return made


def shown(made, conv):
    mine = sorted((r for r in made if r.conv_id == conv), key=lambda r: (r.segment, r.window))
    return [(r.repeated, chat.parse(r.text)) for r in mine]


def test_windows_do_not_depend_on_how_far_apart_turn_numbers_are(spark, vocabulary, library, monkeypatch):
    said = [("system", "be kind"), *[(("user", "assistant")[i % 2], f"word {i} " * (i % 6)) for i in range(59)]]
    said[20] = ("system", "later")
    said[32] = ("system", "at a border")
    rows = [(c, i * step, *said[i]) for c, step in ((1, 1), (2, 1000), (3, 10**12)) for i in range(60)]
    rows += [(4, 7, "user", f"{i:03} same number") for i in range(40)] + [(5, i, *said[i + 1]) for i in range(59)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").repartition(7)
    for length, budget, history in ((chat.SEGMENT, 100, 30), (16, 60, 12), (16, 1024, 16)):
        monkeypatch.setattr(chat, "SEGMENT", length)
        made = chat.format_windows(df, vocabulary, budget, history).collect()
        want = plain_windows(said, library, budget, history, length)
        assert shown(made, 1) == shown(made, 2) == shown(made, 3) == want
        assert shown(made, 4) == plain_windows([r[2:] for r in rows if r[0] == 4], library, budget, history, length)
        assert shown(made, 5) == plain_windows(said[1:], library, budget, history, length)


def test_query_has_the_characters_of_plain_windows(spark, sf_dir, library):
    by_conv = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r.formatted_chars for r in entry.queries()["op8_chat_windows"](spark, sf_dir).collect()}
    for conv, rows in by_conv.items():
        ordered = sorted(rows, key=lambda r: (r.turn is None, r.turn or 0, r.role or "", r.text or ""))
        made = plain_windows([(r.role or "", r.text or "") for r in ordered], library, chat.BUDGET, chat.HISTORY, chat.SEGMENT)
        assert got[conv] == sum(len(chat.template(*t)[0]) for _, turns in made for t in turns)


def test_any_type_of_id(spark, vocabulary):
    for made in ("cast(id as decimal(20, 2))", "date_add(date'2020-01-01', cast(id as int))", "cast(id as smallint)", "cast(id as string)"):
        df = spark.range(3).selectExpr(f"{made} as conv_id", "0 as turn", "'user' as role", "'x' as text")
        got = chat.format_windows(df, vocabulary)
        assert got.schema["conv_id"].dataType == df.schema["conv_id"].dataType
        assert {r.conv_id for r in got.collect()} == {r.conv_id for r in df.collect()}
