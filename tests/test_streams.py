"""Streams give the same rows however their input is cut into batches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from segqa import fixtures as fx
from segqa.config import JobConfig
from segqa.operators import phrases, translation
from segqa.streaming import jobs as stream
from segqa.streaming.keyed import KeyedLog

EVENTS = "k string, kind int, at long, note string"


def events(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None, "ź"]), rnd.choice([1, 2, None]), rnd.randrange(1000), f"n{rnd.randrange(50)}") for _ in range(n)]


@pytest.mark.parametrize("since", [None, 500])
def test_first_rows_do_not_depend_on_batches(spark, tmp_path, monkeypatch, since):
    monkeypatch.setattr(KeyedLog, "every", 3)
    rows, results = events(240, 5), []
    for parts in (1, 8):
        given, out, checkpoint = (str(tmp_path / f"{parts}-{x}") for x in ("in", "out", "cp"))
        for n in range(parts):
            spark.createDataFrame(rows[n::parts], EVENTS).coalesce(1).write.mode("append").parquet(given)
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(given)
        rule = None if since is None else F.col("at") >= since
        stream.write_first(source, out, checkpoint, ["k", "kind"], ["at"], rule).trigger(availableNow=True).start().awaitTermination()
        found = stream.read_first(spark, out, source.schema, ["k", "kind"], ["at"]).collect()
        assert len(list((tmp_path / f"{parts}-out" / "batch").glob("epoch=*"))) == parts
        results.append(sorted(map(tuple, found), key=repr))
    best = {}
    for row in rows:
        if since is None or row[2] >= since:
            best[row[:2]] = min(best.get(row[:2], row), row, key=lambda r: (r[2], r[3]))
    assert results[0] == results[1] == sorted(best.values(), key=repr)


def test_a_log_reads_its_own_buckets_and_not_its_own_batch(spark, tmp_path):
    root = str(tmp_path / "log")
    schema = spark.createDataFrame([], "k long, v string").schema
    log = KeyedLog(spark, root, schema, ["k"], ["v"], buckets=8, every=2)
    for epoch in range(5):
        log.compact(epoch)
        rows = spark.createDataFrame([(k, f"{epoch}-{k}") for k in range(epoch, 40)], schema)
        known = log.known(rows, epoch)
        assert (known is None) == (epoch == 0)
        if known is not None:
            assert {(r.k, r.v) for r in known.collect()} == {(k, f"0-{k}") for k in range(epoch, 40)}
        log.add(rows, epoch)
    one = log.known(spark.createDataFrame([(7, "")], schema), 5)
    assert [tuple(r) for r in one.collect()] == [(7, "0-7")]
    scanned = one.inputFiles()
    assert scanned and all("/base/epoch=4/" in f or "/batch/epoch=4/" in f for f in scanned)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().executedPlan().toString())


PAGES = "job_id bigint, page_number bigint, text string"


def texts(rows):
    return {(r.job_id, r.segment_id): (r.translation.translated_text, r.verdict) for r in rows}


def test_incremental_run_in_one_batch_and_in_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyedLog, "every", 2)
    pages = [(j, p, f"alpha {p}\n\nbeta\ngamma {j}\nThe migration was below 3 mg") for p in range(1, 6) for j in (1, 2, 3)]
    raw = spark.createDataFrame(
        [("English", "Polish", "", "beta", "delta", "", "j", "s")],
        "source_language string, target_language string, source_text string, replace_text string, preferred_text string, approved_text string, job_id string, segment_id string",
    )
    memory = phrases.phrase_rows(raw.withColumn("updated_at", F.timestamp_seconds(F.lit(1))))
    results = []
    for parts in (1, 5):
        given, out, checkpoint = (str(tmp_path / f"{parts}-{x}") for x in ("in", "out", "cp"))
        for n in range(parts):
            spark.createDataFrame(pages[n::parts] + pages[:1], PAGES).coalesce(1).write.mode("append").parquet(given)
        source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(given)
        stream.start_incremental(
            stream.stream_segments(source), out, checkpoint, fx.PrefixTranslator(), translation.RuleReviewer(), fx.terms(), JobConfig(),
            available_now=True, phrases=memory,
        ).awaitTermination()
        rows = stream.read_results(spark, out).collect()
        assert len(rows) == len({(r.job_id, r.segment_id) for r in rows}) == 15 * 4
        # Every text is translated once, in whatever batch it comes first.
        assert sum(r.route == "miss" for r in rows) == len({r.source_text for r in rows})
        results.append(texts(rows))
        assert all(any(f.category == "user_phrase_memory" for f in r.findings) for r in rows if r.source_text == "beta")
    assert results[0] == results[1]


def shuffled(spark):
    """Names of the shuffle files that are there."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().endswith(".data")}


def test_incremental_run_keeps_texts_once_in_its_logs_and_no_shuffle_files(spark, tmp_path):
    given, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in (1, 2):
        rows = [(j, p, f"alpha\nbeta {p}\nalpha\nbeta {p}\ngamma {n}") for p in (2 * n - 1, 2 * n) for j in (1, 2, 3)]
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(given)
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(given)
    before = shuffled(spark)
    stream.start_incremental(
        stream.stream_segments(source), out, checkpoint, fx.PrefixTranslator(), translation.RuleReviewer(), fx.terms(), JobConfig(), available_now=True
    ).awaitTermination()
    # They are removed in the background.
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert sorted(p.name for p in (tmp_path / "out").glob("log-*")) == ["log-segments", "log-translations"]
    assert spark.conf.get(stream.CLEANUP) == "false"
    found = stream.read_results(spark, out)
    assert found.count() == 60 and "leads" not in found.columns
    for epoch in (0, 1):
        kept = spark.read.parquet(f"{out}/log-translations/batch/epoch={epoch}")
        first = found.where(F.col("epoch") == epoch).groupBy("job_id", "key").agg(F.min("order_index").alias("order_index"))
        assert kept.count() == first.count() == kept.join(first, ["job_id", "key", "order_index"]).count()
    # A text of the first batch is known in the second one, in its own job before others.
    later = found.where("epoch = 1 and source_text = 'alpha'").collect()
    assert len(later) == 12 and {r.route for r in later} == {"memory"}


def test_logs_of_one_folder_are_looked_up_by_keys_of_their_own(spark, tmp_path):
    schema = spark.createDataFrame([], "job int, k string, at long").schema
    by_job = KeyedLog(spark, str(tmp_path / "log"), schema, ["job", "k"], ["at"], buckets=8, every=2, by=["k"])
    by_text = KeyedLog(spark, str(tmp_path / "log"), schema, ["k"], ["job", "at"], buckets=8, every=2, by=["k"])
    for epoch in range(3):
        by_job.compact(epoch)
        by_job.add(spark.createDataFrame([(j, k, 10 * epoch + j) for j in (1 + (epoch == 0), 3) for k in "abc"], schema), epoch)
    wanted = spark.createDataFrame([(3, "a", 0), (1, "c", 0), (9, "z", 0)], schema)
    assert sorted(map(tuple, by_job.known(wanted, 3).collect())) == [(1, "c", 11), (3, "a", 3)]
    assert sorted(map(tuple, by_text.known(wanted, 3).collect())) == [(1, "a", 11), (1, "c", 11)]
