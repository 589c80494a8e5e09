import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from segqa.llm import quality

BLANKS = " \t\n\x0b\x0c\r"


def plain_base(text):
    """The base columns once more, as plainly as can be."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in BLANKS:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in BLANKS for c in line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_rules_equal_plain_ones():
    rnd = random.Random(1)
    texts = [None, "", " \n ", "a a a a", "a b c", "é\x1cü a\xa0b", "x y z " * 40]
    texts += ["".join(rnd.choice(["a", "b", "é", "🙂", "#", "<", " ", " ", "\n", "\t", "\x0b", "line here"]) for _ in range(rnd.randrange(200))) for _ in range(300)]
    for text in texts:
        assert quality.judge(text, None)[:6] == plain_base(text)


def test_distance():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 3.0])
    assert quality.distance(p, p) == 0 and quality.distance(p, q) == 1
    assert 0 < quality.distance(np.array([1.0, 1.0]), p) < 1


def test_class_counts_cover_every_character():
    text = "Ab1 é!#ß\n日🙂𝐀\x00"
    assert quality.class_counts(text).sum() == len(text)
    counts = dict(zip(quality.CLASSES, quality.class_counts(text).tolist(), strict=True))
    assert counts == {"lower": 3, "upper": 2, "other_letter": 1, "digit": 1, "space": 2, "punctuation": 1, "symbol": 2, "other": 1}


def corpus(spark):
    rnd = random.Random(2)
    words = "the of and to in a is that for it was on are as with they at be this from".split()
    rows = [(i, "en", " ".join(rnd.choice(words) + " " + "".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(150))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_documents_far_from_their_language_go(spark):
    good = corpus(spark)
    rnd = random.Random(3)
    odd = [
        (100, "en", " ".join("".join(rnd.choice("qwertzuiop") for _ in range(9)) for _ in range(200))), (101, "en", " ".join("".join(rnd.choice("0123456789#=|$") for _ in range(8)) for _ in range(300))),
        (102, "en", "short"), (103, None, " ".join(f"w{i}" for i in range(80))), (104, "xx", " ".join(f"w{i}" for i in range(80))), (105, "en", None),
        (None, "en", "one two " * 60),
    ]
    docs = good.unionByName(spark.createDataFrame(odd, good.schema)).withColumn("kept", F.lit("clash"))
    known = quality.references(good)
    assert set(known) == {"en"} and known["en"].classes.sum() == sum(len(r.text) for r in good.collect())
    assert known["en"].words[b"the"] == sum(r.text.split().count("the") for r in good.collect())
    got = {r.doc_id: r for r in quality.score(docs, known).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].kept and got[100].word_distance > quality.WORDS_APART and not got[100].base_failed
    assert not got[101].kept and got[101].class_distance > quality.CLASSES_APART
    assert not got[102].kept and got[102].word_distance is None and got[102].class_distance is None
    assert got[103].kept and got[104].kept and got[103].word_distance is None
    assert not got[105].kept and got[105].n_words == 0 and not got[None].kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 62
    assert quality.references(docs.limit(0)) == {}
    assert quality.score(docs.limit(0), {}).count() == 0


def test_query_equals_plain_rules_on_the_table(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entry.queries()["op7_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    # References by plain counting.
    classes, words = {}, {}
    for d in docs.values():
        classes[d.lang] = classes.get(d.lang, 0) + quality.class_counts(d.text)
        words.setdefault(d.lang, Counter()).update(d.text.lower().encode().split())
    for r in got:
        d = docs[r.doc_id]
        base = plain_base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        short = {w: n for w, n in words[d.lang].items() if len(w.decode()) <= quality.COMMON_LENGTH}
        top = dict(sorted(short.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS])
        far = False
        if base[0] >= quality.WORDS_JUDGED:
            own = Counter(w for w in d.text.lower().encode().split() if w in top)
            p = np.array([*(own[w] for w in top), base[0] - sum(own.values())], float)
            q = np.array([*top.values(), sum(words[d.lang].values()) - sum(top.values())], float)
            assert abs(r.word_distance - quality.distance(p, q)) < 1e-6
            wordless = quality.distance(np.array([0.0] * len(top) + [1.0]), q)
            far |= r.word_distance > min(quality.WORDS_APART, quality.WORDLESS * wordless)
        if len(d.text) >= quality.CHARS_JUDGED:
            assert abs(r.class_distance - quality.distance(quality.class_counts(d.text).astype(float), classes[d.lang].astype(float))) < 1e-6
            far |= r.class_distance > quality.CLASSES_APART
        assert r.kept == (not base[5] and not far)


def test_gibberish_and_other_languages_go_by_references_of_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    known, rnd = quality.references(docs), random.Random(4)
    made = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 10))) for _ in range(200)) for _ in range(20)]
    odd = spark.createDataFrame([(-1 - n, "en", t) for n, t in enumerate(made)], docs.schema)
    assert not any(quality.judge(t, known["en"])[-1] for t in made)
    kept = {r.doc_id for r in quality.keep_good(docs.unionByName(odd)).collect()}
    assert min(kept) >= 0
    # Documents of the language mostly stay; those of others mostly go.
    rows = [r for r in docs.collect() if not quality.judge(r.text, None)[5]]
    own = [r.doc_id in kept for r in rows if r.lang == "en"]
    others = [quality.judge(r.text, known["en"])[-1] for r in rows if r.lang not in ("en", None)]
    assert sum(own) > 0.8 * len(own) and sum(others) < 0.2 * len(others)
    # Documents that the labels call good stay.
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    good = {r.doc_id for r in labels.collect()} & {r.doc_id for r in rows}
    assert len(good & kept) >= 0.97 * len(good)


def test_rare_languages_have_references_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_SHARE", 0.01)
    rnd = random.Random(7)
    rows, n = [], 0
    for lang in [f"l{i}" for i in range(300)] + ["big"] * 40:
        common = [f"{lang}{w}" for w in "abcdefgh"]
        for _ in range(3):
            rows.append((n, lang, " ".join(rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randrange(10**6)}" for _ in range(60))))
            n += 1
    odd = [(n, "l7", " ".join(f"x{rnd.randrange(10**6)}" for _ in range(60))), (n + 1, None, "one two " * 60), (n + 2, "l8", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string").withColumn("entries", F.lit("clash")).withColumn("total", F.lit(1))
    known, rare = quality.split_references(quality.reference_rows(docs))
    assert set(known) == {"big"} and rare.count() == 300
    got = {r.doc_id: r for r in quality.scored(docs).collect()}
    assert len(got) == len(rows) + len(odd) and all(r.entries == "clash" for r in got.values())
    # The same as with all references sent to the tasks.
    monkeypatch.setattr(quality, "LEAST_SHARE", 0.0)
    whole, none = quality.split_references(quality.reference_rows(docs))
    assert none is None and len(whole) == 301
    assert got == {r.doc_id: r for r in quality.score(docs, whole).collect()}
    assert not got[n].kept and got[n].word_distance > whole["l7"].words_apart and got[n + 1].word_distance is None
    assert sum(got[i].kept for i in range(len(rows))) >= 0.97 * len(rows)
