"""Each stage of the pipeline on what the one before it kept, against brute force."""

import re
from collections import Counter

import pytest
from test_simhash import jaccard

import corpus_pipeline
from segqa.llm import quality, secret_scan


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    """Rows of documents, then of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs.collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        before, docs = docs, spark.read.parquet(f"{folder}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        found.append(docs.collect())
    return found


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_quality_rules_reject_whole_documents(outputs):
    before, after = {r.doc_id: r for r in outputs[0]}, {r.doc_id: r for r in outputs[1]}
    assert all(before[i] == r for i, r in after.items()) and 0 < len(after) < len(before)
    for i in before:
        if quality.judge(before[i].text, None)[5]:
            assert i not in after


def test_line_dedup_keeps_documents_and_every_line(outputs):
    before, after = {r.doc_id: r for r in outputs[1]}, {r.doc_id: r for r in outputs[2]}
    assert set(before) == set(after)
    assert {x.strip() for r in before.values() for x in r.text.split("\n")} == {x.strip() for r in after.values() for x in r.text.split("\n")} - (
        set() if any(not x.strip() for r in before.values() for x in r.text.split("\n")) else {""}
    )
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert sum(len(r.text) for r in after.values()) < sum(len(r.text) for r in before.values())


def test_near_dedup_leaves_one_of_each_group(outputs):
    before, after = {r.doc_id: r for r in outputs[2]}, {r.doc_id: r for r in outputs[3]}
    assert all(before[i] == r for i, r in after.items())
    gone = [i for i in before if i not in after]
    texts = Counter(" ".join(r.text.lower().split()) for r in after.values())
    assert max(texts.values()) == 1
    # Whatever goes is like a document with a smaller id, if only by way of others that go.
    for i in gone:
        assert any(j < i and jaccard(before[i].text, before[j].text) >= 0.8 for j in before) or any(
            j in gone and jaccard(before[i].text, before[j].text) >= 0.8 for j in before if j != i
        )


def test_secrets_are_replaced_where_they_are_live(outputs):
    before, after = {r.doc_id: r for r in outputs[3]}, {r.doc_id: r for r in outputs[4]}
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values())
    values, owners = {}, {}
    for r in before.values():
        for pattern, group, least in secret_scan.BASE.values():
            for m in re.finditer(pattern, r.text, re.A):
                if len(m[group]) >= least:
                    values.setdefault(r.doc_id, []).append((m.start(), m.end(), m[group]))
                    owners.setdefault(m[group], set()).add(r.source)
    for i, r in before.items():
        live = [(a, b) for a, b, v in values.get(i, []) if len(owners[v]) < 3 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)]
        text = list(r.text)
        for a, b in live:
            text[a:b] = ["\0"] * (b - a)
        assert after[i].text == re.sub("\0+", "[SECRET]", "".join(text))


def test_packing_holds_every_token_of_every_document(outputs, library):
    docs = {r.doc_id: r for r in outputs[4]}
    lengths = Counter()
    for r in outputs[5]:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in docs.items()}


def test_run_applies_all_stages(spark, sf_dir, outputs):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[k] for k in key) for r in rows) == sorted(tuple(r[k] for k in key) for r in outputs[-1])
