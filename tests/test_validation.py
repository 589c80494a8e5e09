from pyspark.sql import functions as F

from segqa import fixtures as fx
from segqa.functions.glossary import prompt_block, relevant_terms
from segqa.functions.rules import rule_translate
from segqa.operators import validation
from segqa.sources.glossary import load_terms
from segqa.sources.languages import LANGUAGES, language_index


def _issues(spark, source, target, language="Polish"):
    pairs = spark.createDataFrame([("j", "s1", source, target)], "job_id string, segment_id string, source_text string, translated_text string")
    return validation.validate_pairs(pairs, fx.terms(), language).collect()


def test_changed_number_is_critical(spark):
    found = _issues(spark, "Migration was below 0.05 mg/kg.", "Migracja była poniżej 0.5 mg/kg.")
    assert {i.issue_type for i in found} == {"missing_number", "unexpected_addition"}
    assert all(i.severity == "critical" for i in found)


def test_decimal_comma_keeps_the_number(spark):
    assert _issues(spark, "Migration was below 0.05 mg/kg.", "Migracja była poniżej 0,05 mg/kg.") == []


def test_count_deficit_gives_one_issue_with_first_text(spark):
    found = _issues(spark, "5 kg and 5.0 KG and 5 kg", "5 oraz 5.0")
    assert [(i.issue_type, i.source_value) for i in found] == [("missing_number", "5"), ("missing_unit", "kg")]


def test_negation_applies_to_every_language(spark):
    assert [i.issue_type for i in _issues(spark, "It was not found", "Es wurde gefunden", "German")] == ["missing_negation"]


def test_glossary_is_enforced_for_polish_only(spark):
    text = "Overall migration was below 10 mg/dm2."
    assert [i.issue_type for i in _issues(spark, text, text)] == ["untranslated_fragment"]
    assert _issues(spark, text, "Die Gesamtmigration lag unter 10 mg/dm2.", "German") == []
    forbidden = _issues(spark, "overall migration", "ogólna migracja, migracja globalna")
    assert [(i.issue_type, i.translated_value) for i in forbidden] == [("forbidden_term", "ogólna migracja")]


def test_prompt_lines_name_anchors_for_other_languages(spark):
    german, polish = spark.range(1).select(prompt_block(fx.terms(), "German"), prompt_block(fx.terms(), "Polish")).first()
    assert "domain concept anchor" in german
    assert polish.splitlines()[0].startswith("- overall migration -> migracja globalna (alternatives=")


def test_glossary_defaults(tmp_path):
    file = tmp_path / "g.yaml"
    file.write_text("terms:\n  dry_ink: {}\n  skipped: text\n  a_b: {source: x, forbidden: [y]}\n", encoding="utf-8")
    terms = load_terms(str(file))
    assert [(t.key, t.source, t.preferred) for t in terms] == [("dry_ink", "dry ink", "dry ink"), ("a_b", "x", "x")]
    assert load_terms(str(tmp_path / "none.yaml")) == []


def test_empty_glossary(spark):
    row = spark.range(1).select(relevant_terms(F.lit("x"), []).alias("t")).first()
    assert row.t == []


def test_rule_translate(spark):
    df = spark.createDataFrame([("No migration was detected at 0.5 mg/kg",), ("the overview",)], "s string")
    made = df.select(rule_translate(F.col("s"), fx.terms()).alias("t")).collect()
    assert made[0].t.translated_text == "Nie wykryto migracji w temperaturze 0,5 mg/kg"
    assert (made[1].t.confidence, made[1].t.uncertain_terms) == ("low", ["untranslated_or_unknown_segment"])


def test_language_index(spark):
    df = spark.createDataFrame([(" polish ",), ("Chinese  (Simplified)",), ("Klingon",)], "l string")
    assert [r.i for r in df.select(language_index(F.col("l"), 7).alias("i")).collect()] == [1, LANGUAGES.index("Chinese (Simplified)"), 7]
    assert len(LANGUAGES) == 91 and len(set(LANGUAGES)) == 91
