"""Spelling variants against brute force, long words, and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from segqa.llm import spelling

DOCS = "doc_id long, text string, word string, n string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def plain(words):
    """``words`` -> rows (word, form, root, n, n_near, form_n)."""
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def grouped(spark, words):
    given = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return sorted(map(tuple, spelling.group_variants(given).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    letters = ["ab", "abcé", "xyzÿàa"][seed]
    words = {"".join(rng.choice(list(letters), rng.integers(1, 9))): int(rng.integers(3, 60)) for _ in range(220)}
    assert grouped(spark, words) == plain(words)


def test_labels_of_all_lengths(spark):
    base = "".join(np.random.default_rng(4).choice(list("abcdefgh"), 700))
    words = {base: 40, base[:300] + "x" + base[301:]: 9, base[:5] + base[6:]: 4, base + "q": 3, base[1:]: 90, "a" * 300: 5, "a" * 301: 10, "a" * 302: 25, "a" * 40: 3, "b" + "a" * 39: 7}
    assert grouped(spark, words) == plain(words)


def test_equal_hashes_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PRIME", 11)
    rng = np.random.default_rng(7)
    words = {"".join(rng.choice(list("abc"), 6)): int(rng.integers(3, 40)) for _ in range(40)}
    assert grouped(spark, words) == plain(words)


def test_only_bounded_levels_are_sent_to_all_tasks(spark, monkeypatch):
    plans, written = [], spelling.materialize

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    rng = np.random.default_rng(9)
    words = {"".join(rng.choice(list("abc"), rng.integers(4, 12))): int(rng.integers(3, 60)) for _ in range(120)}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "materialize", lambda df: written(planned(df)))
    # Default of 10 MB: all of these tables are far smaller than that.
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    for sent in (0, spelling.SENT):
        monkeypatch.setattr(spelling, "SENT", sent)
        plans.clear()
        assert sorted(map(tuple, planned(spelling.group_variants(given)).collect()), key=repr) == plain(words)
        joined = [p for p in plans if "Join" in p]
        found = [p for p in joined if "Broadcast" in p]
        # Levels only, and of these only the side with the states.
        assert len(joined) >= 6 and bool(found) == bool(sent) and all("BuildLeft" in p and "step#" in p for p in found)


def counted(docs):
    words = Counter()
    for id_, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = None if id_ is None else zlib.crc32(f"{id_}:{run}".encode())
                at = h % len(run) if h is not None and h % 97 == 0 else len(run)
                words[run[:at] + run[at + 1 :]] += 1
                run = ""
    return words


def test_words_of_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    docs += [(None, "Élan vital, ÿes élan x1y"), (None, None), (5, ""), (5, "ab " * 500), (6, "ab-" * 500)]
    given = spark.createDataFrame([(i, t, "w", "n") for i, t in docs], DOCS)
    assert {r.word: r.n for r in spelling.word_counts(given, "doc_id", "text").collect()} == counted(docs)
    expected = {w: n for w, n in counted(docs).items() if len(w) >= 5 and n >= 3}
    assert sorted(map(tuple, spelling.variants(given).collect()), key=repr) == plain(expected)


def test_nothing_gives_nothing(spark):
    given = spark.createDataFrame([(1, None, "w", "n"), (None, "abc 123", "w", "n")], DOCS)
    got = spelling.variants(given)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.collect() == []
    assert spelling.variants(given.limit(0)).collect() == []
