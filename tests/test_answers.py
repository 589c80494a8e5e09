import hashlib
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segqa import fixtures as fx
from segqa.operators import translation
from segqa.operators.answers import AnswerLog, patient
from segqa.sources import files


def counting_client(folder, dies_at=None):
    """Writes a file for every text it is sent; once, it kills its task at the text ``dies_at``."""

    def open_client():
        def call(batch):
            import os
            import uuid

            for text in batch["source_text"]:
                open(os.path.join(folder, f"{text}.{uuid.uuid4().hex}"), "w").close()
            if dies_at in set(batch["source_text"]) and not os.path.exists(f"{folder}/../died"):
                open(f"{folder}/../died", "w").close()
                os._exit(1)
            usage = {"operation": "translate", "provider": "p", "model": "m", "input_tokens": 7, "output_tokens": 3, "total_tokens": 10}
            return pd.DataFrame({
                "translated_text": "PL: " + batch["source_text"], "translator_notes": [["a", t] for t in batch["source_text"]],
                "confidence": "high", "token_usage": [usage for _ in range(len(batch))],
            })

        return call

    return open_client


def sent(folder):
    return sorted(p.name.split(".")[0] for p in folder.iterdir())


def test_requests_with_an_answer_are_not_sent_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(j, f"s{i}", f"t{i % 5}") for j in (1, 2) for i in range(10)], "job_id long, segment_id string, source_text string")
    log = AnswerLog(str(tmp_path / "log"), "model", buckets=3)
    first = translation.ClientTranslator(counting_client(str(calls)), "German", answers=log).translate(rows.where("source_text <> 't4'")).collect()
    assert sent(calls) == ["t0", "t1", "t2", "t3"] and len(first) == 16
    # A later run sends what is new; the answers are the same, usage and notes included.
    again = translation.ClientTranslator(counting_client(str(calls)), "German", answers=log).translate(rows).collect()
    assert sent(calls) == ["t0", "t1", "t2", "t3", "t4"]
    assert sorted(r for r in again if r.source_text != "t4") == sorted(first)
    row = next(r for r in again if r.source_text == "t4")
    assert row.translation.translator_notes == ["a", "t4"] and row.translation.token_usage.total_tokens == 10
    # Another model, or more that the client is told, is another request.
    other = AnswerLog(str(tmp_path / "log"), "other model", buckets=3)
    translation.ClientTranslator(counting_client(str(calls)), "German", answers=other).translate(rows.where("source_text = 't0'")).collect()
    translation.ClientTranslator(counting_client(str(calls)), "German", answers=log).translate(rows.where("source_text = 't0'").withColumn("instruction", F.lit("x"))).collect()
    assert sent(calls).count("t0") == 3
    assert translation.ClientTranslator(fx.refusing_client, "German", answers=log).translate(rows.limit(0)).count() == 0


def test_a_run_after_a_killed_task_sends_only_the_batch_that_was_lost(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(1, f"s{i}", f"t{i:02}") for i in range(40)], "job_id long, segment_id string, source_text string")
    log = AnswerLog(str(tmp_path / "log"), buckets=1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        client = translation.ClientTranslator(counting_client(str(calls), dies_at="t20"), "German", calls=1, answers=log)
        with pytest.raises(Exception, match="(?i)worker|crash|eof|abort"):
            client.translate(rows).collect()
        before = sent(calls)
        got = client.translate(rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(r.translation.translated_text for r in got) == [f"PL: t{i:02}" for i in range(40)]
    twice = [t for t in set(sent(calls)) if sent(calls).count(t) == 2]
    assert "t20" in twice and len(twice) <= 8 and set(twice) <= set(before) and len(sent(calls)) == 40 + len(twice)


def test_calls_are_made_again_after_errors_and_timeouts():
    tried = []

    def flaky(batch):
        tried.append(len(batch))
        if len(tried) == 1:
            raise ConnectionError
        return batch

    batch = pd.DataFrame({"source_text": ["x"]})
    assert patient(flaky)(batch) is batch and tried == [1, 1]
    with pytest.raises(ConnectionError):
        tried.clear()
        patient(flaky, retries=0)(batch)
    slow = []

    def hangs_once(batch):
        slow.append(1)
        if len(slow) == 1:
            time.sleep(2)
        return batch

    assert patient(hangs_once, timeout=0.3)(batch) is batch
    with pytest.raises(TimeoutError):
        patient(lambda b: time.sleep(1), timeout=0.1, retries=1)(batch)


def test_files_over_two_gigabytes_are_hashed_in_pieces(spark, tmp_path):
    (tmp_path / "some folder").mkdir()
    (tmp_path / "some folder" / "a b%20.pdf").write_bytes(b"abc")
    (tmp_path / "empty.pdf").write_bytes(b"")
    length = (2 << 30) + 4096
    with open(tmp_path / "large.pdf", "wb") as large:
        large.truncate(length)
    digest = hashlib.sha256()
    for _ in range(length // 4096):
        digest.update(bytes(4096))
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"a b%20.pdf": (3, hashlib.sha256(b"abc").hexdigest()), "large.pdf": (length, digest.hexdigest())}
    asked = [str(tmp_path / "empty.pdf"), f"file:{tmp_path}/large.pdf", str(tmp_path / "none.pdf"), str(tmp_path), None]
    rows = spark.createDataFrame([(p, "clash") for p in asked], "path string, sha256 string")
    assert {r.path: r.sha256 for r in files.with_file_hash(rows, "path").collect()} == dict(
        zip(asked, [hashlib.sha256(b"").hexdigest(), digest.hexdigest(), "missing", "missing", "missing"], strict=True)
    )


def test_texts_are_written_to_one_folder_where_tasks_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "zwei ö"), ("b", 1, None), ("a", 1, "eins")], "name string, at int, line string")
    for _ in range(2):  # a repeated run replaces the files
        files.write_texts(rows, str(tmp_path / "out"), "name", "at", "line")
    assert {p.name: p.read_text("utf-8") for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"a": "eins\nzwei ö\n", "b": "\n"}
