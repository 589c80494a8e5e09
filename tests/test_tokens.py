import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from segqa import fixtures as fx
from segqa.functions.locale import apply_locale, localize_decimals
from segqa.functions.text import casefold, normalize_ws
from segqa.functions.tokens import extract_tokens

TRICKY = [
    "Overall migration was < 10 mg/dm² at 40°C for 10 days. CAS 123-45-6, EN 1186, ND.",
    "MG/DM2 G/M2 EN 123-45-6 EN 1186.5 EC No. 1935/2004 Regulation (EU) No 10/2011",
    "2020-01-05-3 2020-01-05 1,234.56 1 234,5 12-34 C2H5OH H2O N/A n/a it's 5% ≤3 ≥4 ±1 éND ND LOQ",
    "ISO 9001:2015 DIN EN 71/3 ASTM 12 : 4 EN  77 a\x1fb EN\x1f12 \x1f9",
    "",
    "10,000,000.5 1,23 007 5kg 5 kg µg/kg μg 12 hrs 3 min s S's",
]


# The kinds once more, written apart from the engine for another engine, in priority order.
KINDS = [
    ("cas", r"\b\d{2,7}-\d{2}-\d\b"),
    ("regulation", r"(?i)\bRegulation\s*\((?:EU|EC)\)\s*No\.?\s*\d+/\d+\b"),
    ("standard", r"(?i)\b(?:EN|ISO|DIN|ASTM)\s*\d+(?:[-:/]\d+)*(?:\s*[:/]\s*\d+)?\b"),
    ("regulation", r"(?i)\b(?:EU|EC)\s*No\.?\s*\d+/\d+\b"),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("abbreviation", r"(?i)\b(?:ND|N/A|NA|LOQ|LOD|SML|OML)\b"),
    ("formula", r"\b(?=[A-Z0-9]*\d)(?:[A-Z][a-z]?\d*){2,}\b"),
    ("comparator", r"[≤≥<>=±]"),
    ("unit", r"(?i)\b(?:mg/dm[2²]|mg/kg|µg/kg|ug/kg|g/m[2²]|kg|mg|µg|ug|ppm|ppb|days?|hours?|hrs?|min|s)\b|°C|%"),
    ("number", r"(?<![A-Za-z0-9/-])(?:\d{1,3}(?:[ ,]\d{3})+|\d+)(?:[.,]\d+)?(?![A-Za-z0-9/-])"),
]


def _by_hand(text):
    kept = []
    for kind, pattern in KINDS:
        for match in re.finditer(pattern, text):
            if all(match.end() <= a or match.start() >= b for a, b, _, _ in kept):
                kept.append((match.start(), match.end(), kind, match.group()))
    return sorted(kept)


def test_tokens_equal_a_plain_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("t")).distinct()
    tricky = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    rows = lines.unionByName(tricky).select("t", extract_tokens(F.col("t")).alias("x")).collect()
    assert len(rows) > 1000
    for row in rows:
        assert [(k.start, k.end, k.kind, k.text) for k in row.x] == _by_hand(row.t), row.t


def test_golden_tokens(spark):
    row = spark.createDataFrame([(TRICKY[0],)], "t string").select(extract_tokens(F.col("t"), "S1").alias("x")).first()
    values = [(k.kind, k.normalized) for k in row.x]
    for pair in [("comparator", "<"), ("number", "10"), ("unit", "mg/dm2"), ("unit", "°c"), ("cas", "123-45-6"),
                 ("standard", "EN1186"), ("abbreviation", "ND")]:
        assert pair in values
    assert [k.token_id for k in row.x] == [f"S1_{i + 1}" for i in range(len(row.x))]


def test_localize_decimals(spark):
    cases = {
        "0.01 mg/kg and 1,234.56 ppm.": "0,01 mg/kg and 1 234,56 ppm.",
        "Section 1.2 and table 2.1 stay, but the result is 0.05 mg/kg.":
            "Section 1.2 and table 2.1 stay, but the result is 0,05 mg/kg.",
        "1,234,567.8": "1 234 567,8",
        "Version 2.0.": "Version 2.0.",
        "see rys.   3.4 and 1.2.3 and v1.5 and 5.0/2": "see rys.   3.4 and 1.2.3 and v1.5 and 5.0/2",
        "1.5 2.5": "1,5 2,5",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", localize_decimals(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases


def test_text_columns_agree_with_python(spark):
    texts = ["  A\n\nB   C\x1c", "Straße ŒUVRE ﬁn Σίσυφος ſ µ İ", "x y　", "ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", normalize_ws(F.col("t")).alias("n"), casefold(F.col("t")).alias("c")
    ).collect()
    for r in rows:
        assert r.n == " ".join(r.t.split())
        assert r.c == r.t.casefold()


def test_localizing_keeps_separator_characters(spark):
    text = "a\x1fb see Section 1.2"
    number = "x\x1f 1,234.5 \x1e 0.05\x1f"
    got = spark.createDataFrame([(text,), (number,)], "t string").select(apply_locale(F.col("t"), F.array(F.lit("n")), "Polish").alias("d")).collect()
    assert got[0].d.translated_text == text and got[0].d.translator_notes == ["n"]
    assert got[1].d.translated_text == "x\x1f 1 234,5 \x1e 0,05\x1f" and len(got[1].d.translator_notes) == 2


def test_token_queries_over_documents_equal_a_plain_scan(spark, sf_dir):
    lines = fx.doc_segments(spark, sf_dir).select("job_id", "segment_id", "source_text").collect()
    tokens = Counter()
    inventory = {}
    for r in lines:
        for _, _, kind, text in _by_hand(r.source_text):
            tokens[r.job_id, r.segment_id, kind] += 1
            inventory.setdefault(kind, []).append((r.job_id, r.segment_id))
    got = entry.queries()["t1_tokens_documents"](spark, sf_dir).collect()
    assert {(r.job_id, r.segment_id, r.kind): r.tokens for r in got} == tokens and len({k for _, _, k in tokens}) > 2
    rows = entry.queries()["t4_token_inventory_documents"](spark, sf_dir).collect()
    assert {r.kind for r in rows} == set(inventory)
    for kind, places in inventory.items():
        own = [r for r in rows if r.kind == kind]
        assert sum(r.occurrences for r in own) == len(places)
