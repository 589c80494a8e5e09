import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from segqa.llm import langid

ROWS = [
    ("en", "the cat and the dog sat on the mat with the other cats"), ("en", "this is the house that the man built and then left"),
    ("de", "der Hund und die Katze sitzen auf der Matte mit den anderen"), ("de", "das ist das Haus, das der Mann gebaut und verlassen hat"),
    (None, "nothing to learn from"), ("en", None),
]


def model(spark):
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(ROWS)], "doc_id long, lang string, text string")
    return langid.fit(df, "text", "lang", F.col("doc_id"))


def test_words_first_then_shorter_grams(spark):
    fitted = model(spark)
    assert fitted.languages == ["de", "en"]
    scorer = langid.Scorer(fitted)
    assert scorer.predict("the dog and the man")[0] == "en"
    assert scorer.predict("der Hund und der Mann")[0] == "de"
    # Unseen words back off: whole grams first, single letters last, nothing at the end.
    assert scorer.predict("sitzenden")[0] == "de"
    assert "sitzenden" not in fitted.tables[0]
    assert not scorer.scores[scorer["qqq"]].any()
    # The longest known grams decide, shorter ones have no say.
    longest = [fitted.tables[5][g] for g in langid.grams("sitzenden", 5) if g in fitted.tables[5]]
    assert (scorer.backoff("sitzenden") == sum(longest) / len(longest)).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !! ²"), (4, "the"), (4, "the"), (None, "der " * 50_000), (5, "qqq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = langid.predict(df, model(spark), "text").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0
    # Equally likely: the first by name, with an even share.
    assert got[-1].score == 0.5
    empty = langid.fit(df.withColumn("lang", F.lit(None).cast("string")), "text", "lang", F.col("doc_id"))
    assert {r.lang_pred for r in langid.predict(df, empty, "text").collect()} == {"und"}
    assert langid.predict(df.limit(0), empty, "text").count() == 0


def test_full_memory_changes_nothing(spark, monkeypatch):
    fitted = model(spark)
    text = " ".join(f"sitz{c}en" for c in "abcdefgh")
    expected = langid.Scorer(fitted).predict(text)
    monkeypatch.setattr(langid, "REMEMBERED", 2)
    monkeypatch.setattr(langid, "PART", 2)
    got = langid.Scorer(fitted)
    assert len(got.scores) == len(got.words) + 2
    assert got.predict(text) == (expected[0], pytest.approx(expected[1]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op3_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out").collect()
    assert got.count() == docs.count()
    right = sum(r.lang == r.lang_pred for r in held)
    assert len(held) > 200 and right / len(held) >= 0.97
