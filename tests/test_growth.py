"""Work that must not grow with what is settled already: prose without tokens, judged pairs, rows that are not shown."""

import pytest
from pyspark.sql import functions as F

from segqa import fixtures as fx
from segqa.functions.text import normalize_ws, strip_ws
from segqa.functions.tokens import extract_tokens, may_hold_tokens
from segqa.operators import phrases, reports, validation
from segqa.operators.memory import CACHE_COLUMNS
from segqa.operators.translation import RuleReviewer
from segqa.plans import scale, workflow
from segqa.sources.documents import block_count, page_blocks

KEYS = "job_id string, segment_id string"
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0        　"
# Each of these is a token, or holds one, without any digit.
DIGITLESS = ["≤", "≥", "a=b", "±", "20%".strip("20"), "°C", "µg/kg", "μg", "Μg", "Kg", "dayſ", "ſ", "n/a", "Loq", "S", "(hrs)", "é mg", "émg", "\U0001d49cmg", "mg/dm²", "OML."]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_with_tokens_pass_the_first_look(spark):
    rows = spark.createDataFrame([(t,) for t in [*DIGITLESS, "Texte – łąka “a”", "plain prose as such", "x٣", None]], "t string")
    got = {r.t: (r.may, r.n) for r in rows.select("t", may_hold_tokens(F.col("t")).alias("may"), F.size(extract_tokens(F.col("t"))).alias("n")).collect()}
    assert all(got[t][0] and got[t][1] for t in DIGITLESS)
    assert not any(n for may, n in got.values() if not may)
    assert got["plain prose as such"] == got["Texte – łąka “a”"] == (False, 0)


def test_every_kind_of_white_space_is_still_found(spark):
    texts = [x for c in WHITE for x in (f"a{c}b", f"{c}a", f"a{c}", f"a {c} b")] + ["a  b", " a ", "a b", "", "“a”–b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_ws(F.col("t")).alias("n"), strip_ws(F.col("t")).alias("s"), block_count(F.col("t")).alias("k"), F.size(page_blocks(F.col("t"))).alias("size"))
    for r in rows.collect():
        assert (r.n, r.s, r.k) == (" ".join(r.t.split()), r.t.strip(), r.size), repr(r.t)


def test_only_shown_rows_are_shortened(spark):
    rows = spark.createDataFrame([("j", f"s{i}", 1, "p", i, f"a  {i}", f"b  {i}", "high") for i in range(30)], f"{KEYS}, page_number int, block_type string, order_index long, source_text string, translated_text string, confidence string")
    tail = reports.translation_preview(rows, 3, 5, 5)
    assert sorted((r.number, r.source, r.translation) for r in tail.collect()) == [(28, "a 27", "b 27"), (29, "a 28", "b 28"), (30, "a 29", "b 29")]
    plan = _plan(tail)
    assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("Window ["):]


def test_only_revised_pairs_are_validated_again(spark, monkeypatch):
    finding = F.from_json(F.lit('[{"severity": "major", "category": "c", "proposed_translation": "Wynik 5 mg/kg"}]'), "array<struct<severity:string,category:string,source_evidence:string,translation_evidence:string,explanation:string,proposed_translation:string,confidence:string>>")
    work = spark.createDataFrame([("j", f"s{i}", "Result 5 mg/kg", f"Wynik {i} mg/kg") for i in range(9)], f"{KEYS}, source_text string, t string").select(
        "job_id", "segment_id", "source_text", F.lit("paragraph").alias("block_type"), fx.as_translation(F.col("t")).alias("translation"),
        F.when(F.col("segment_id") == "s3", finding).otherwise(F.filter(finding, lambda _: F.lit(False))).alias("findings"), F.lit("accept").alias("verdict"),
        F.expr("cast(array() as array<string>)").alias("applied"), F.lit(0).alias("attempts"),
    )
    seen = []
    real = workflow.validate_pairs
    monkeypatch.setattr(workflow, "validate_pairs", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    state = workflow.review_loop(work, (), fx.PrefixTranslator("RE: "), RuleReviewer(), fx.CONFIG)
    assert seen == [9, 1]
    # s3 was mended by its proposal and s5 was right; the other seven keep their issues.
    assert {r.segment_id for r in state.issues.collect()} == {f"s{i}" for i in range(9)} - {"s3", "s5"}


@pytest.mark.parametrize("floor", [200_000, 20])
def test_refinements_join_texts_once(spark, monkeypatch, floor):
    monkeypatch.setattr(scale, "HOT_FLOOR", floor)
    texts = spark.createDataFrame([("j", f"s{i}", f"Tekst {i}") for i in range(5)], f"{KEYS}, translated_text string")
    issues = spark.createDataFrame([("j", "s1", p, f"Inny {p}" if p > 60 else "tekst 1", "x") for p in range(100)] + [("j", "s2", 0, None, "dowód")], f"{KEYS}, pos int, proposed_translation string, translation_evidence string")
    out = phrases.suggest_refinement(texts, issues)
    assert {r.segment_id: (r.replace_text, r.preferred_text) for r in out.collect()} == {
        "s0": ("Tekst 0", ""), "s1": ("Tekst 1", "Inny 61"), "s2": ("Tekst 2", "dowód"), "s3": ("Tekst 3", ""), "s4": ("Tekst 4", ""),
    }
    if floor == 200_000:
        assert _plan(out).count("Join ") == 1


def test_inputs_of_the_review_need_no_join(spark, sf_dir):
    assert "Join" not in _plan(fx.translated_segments(spark, sf_dir))


PAIRS = [("Result 5 mg/kg was not found", "Wynik 6 mg/kg")] * 30 + [("Result 5 mg/kg", "Wynik 5 mg/kg")] * 30 + [
    ("Result 5 mg/kg", None), (None, "Wynik 5 mg/kg"), (None, None), ("", ""), ("", None), ("5 kg\x1f7 kg", "8 kg"), ("5 kg", "7 kg\x1f8 kg"),
    ("Overall migration", "ogólna migracja"), ("Declaration of compliance", "Certyfikat zgodności"), ("Declaration of compliance", "Deklaracja"),
]


def _pairs(spark):
    return spark.createDataFrame([(i % 3, f"s{i}", *p) for i, p in enumerate(PAIRS)], "job_id int, segment_id string, source_text string, translated_text string")


def _seen(monkeypatch, module):
    """The number of rows of every table that ``module`` writes."""
    seen = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: (seen.append(df.count()), real(df))[1])
    return seen


@pytest.mark.parametrize("floor", [200_000, 7])
def test_equal_pairs_are_validated_once(spark, monkeypatch, floor):
    monkeypatch.setattr(scale, "HOT_FLOOR", floor)
    seen = _seen(monkeypatch, validation)
    pairs = _pairs(spark)
    issues = validation.validate_pairs(pairs, fx.terms())
    assert seen == [len(set(PAIRS))] and "RLIKE" not in _plan(issues)
    by_row = validation.explode_issues(pairs, validation.pair_issues(F.col("source_text"), F.col("translated_text"), fx.terms()))
    assert sorted(map(repr, issues.collect())) == sorted(map(repr, by_row.collect()))
    assert issues.where("issue_type = 'missing_negation'").count() == 30


@pytest.mark.parametrize("floor", [200_000, 7])
def test_phrases_are_tried_on_equal_pairs_once(spark, monkeypatch, floor):
    monkeypatch.setattr(scale, "HOT_FLOOR", floor)
    seen = _seen(monkeypatch, phrases)
    pairs, memory = _pairs(spark), fx.phrase_memory(spark)
    matched = phrases.phrase_matches(pairs, memory, fx.CONFIG)
    assert seen[0] == len(set(PAIRS)) and matched.count() == len(PAIRS) and matched.columns == [*pairs.columns, "matches"]
    found = phrases.pair_findings(pairs, memory, fx.CONFIG)
    assert "regexp_replace" not in _plan(found)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, phrases.phrase_findings(matched).collect()))
    # "Wynik" in 61 rows; one text has the phrase and one the source of the declaration.
    assert found.select("translation_evidence").distinct().count() == 3 and found.count() == 63


def test_tokens_of_the_source_are_shown_and_not_kept(spark):
    shown = []

    class Looking(RuleReviewer):
        def review(self, pairs):
            shown.append(pairs.select(F.size("protected_tokens")).first()[0])
            return super().review(pairs)

    segs = spark.createDataFrame([("j", "s1", 0, "paragraph", "Result 5 mg/kg")], f"{KEYS}, order_index long, block_type string, source_text string")
    none = segs.limit(0).select("job_id", "segment_id", fx.as_translation(F.lit("x")).alias("translation"))
    state, _ = workflow.run_corpus(segs, none, spark.createDataFrame([], CACHE_COLUMNS), fx.terms(), fx.PrefixTranslator(), Looking(), fx.CONFIG)
    assert shown == [2] and "protected_tokens" not in state.work.columns
