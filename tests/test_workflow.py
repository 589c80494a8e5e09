import pytest
from pyspark.sql import functions as F

from segqa import fixtures as fx
from segqa.config import JobConfig
from segqa.functions.usage import extract_usage
from segqa.operators import decisions, memory, phrases, reports, translation
from segqa.operators import review as rev
from segqa.operators.layout import assemble_lines, page_lines, words_outside
from segqa.plans import workflow
from segqa.sources import files, job_store
from segqa.streaming import jobs as stream

KEYS = "job_id string, segment_id string"
CONFIG = JobConfig()


def _segments(spark, rows):
    return spark.createDataFrame(
        [("j", s, i, t, "paragraph") for i, (s, t) in enumerate(rows)],
        f"{KEYS}, order_index bigint, source_text string, block_type string",
    )


def _translations(spark, rows):
    return spark.createDataFrame([("j", s, t) for s, t in rows], f"{KEYS}, t string").select(
        "job_id", "segment_id", fx.as_translation(F.col("t")).alias("translation")
    )


def _no_cache(spark):
    return spark.createDataFrame([], memory.CACHE_COLUMNS)


def test_equal_texts_are_translated_once(spark):
    segs = _segments(spark, [("s1", "Declaration of compliance"), ("s2", "Declaration   of\ncompliance"), ("s3", "Other"), ("s4", " "), ("s5", " ")])
    none = _translations(spark, [("x", "x")])
    out = memory.translate_corpus(segs, none, _no_cache(spark), fx.PrefixTranslator(), CONFIG)
    rows = {r.segment_id: r for r in out.collect()}
    assert {k: r.route for k, r in rows.items()} == {"s1": "miss", "s2": "duplicate", "s3": "miss", "s4": "miss", "s5": "miss"}
    assert rows["s2"].translation.translated_text == "PL: Declaration of compliance"
    assert rows["s2"].translation.translator_notes == ["Reused exact-match translation from segment s1."]
    counters = memory.reuse_counters(out).first()
    assert (counters.memory_hits, counters.persistent_hits, counters.misses) == (1, 0, 4)


def test_known_translation_is_reused_even_when_later(spark):
    segs = _segments(spark, [("s1", "Repeated footer"), ("s2", "Repeated footer")])
    out = memory.translate_corpus(segs, _translations(spark, [("s2", "Stopka 0.5 kg")]), _no_cache(spark), fx.PrefixTranslator(), CONFIG)
    rows = {r.segment_id: r for r in out.collect()}
    assert (rows["s1"].route, rows["s2"].route) == ("memory", "existing")
    assert rows["s1"].translation.translated_text == "Stopka 0,5 kg"


def test_cache_is_reused_between_jobs(spark):
    scope = memory.cache_scope(CONFIG)
    usage = F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("translate").alias("operation"),
                     F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(3).alias("total_tokens"))
    first = _segments(spark, [("s1", "Repeated footer"), ("s2", "")]).withColumn(
        "translation", fx.as_translation(F.lit("Stopka"), usage=usage)
    )
    cache = memory.cache_upsert(_no_cache(spark), memory.cache_rows(first, scope, F.lit("2024-01-01").cast("timestamp")))
    assert cache.count() == 1
    second = _segments(spark, [("s9", "Repeated   footer"), ("s10", "Repeated footer")]).withColumn("job_id", F.lit("k"))
    out = memory.translate_corpus(second, _translations(spark, []), cache, fx.PrefixTranslator(), CONFIG)
    rows = {r.segment_id: r for r in out.collect()}
    assert (rows["s9"].route, rows["s10"].route) == ("persistent", "memory")
    assert rows["s9"].translation.token_usage is None
    assert rows["s10"].translation.translator_notes[-1] == "Reused exact-match translation from segment s9."


def _one_phrase(spark, replace="wysuszonej warstwie farby", preferred="wyschniętej powłoce farby"):
    raw = spark.createDataFrame(
        [("English", "Polish", "Text about dry ink film.", replace, preferred, "Tekst o wyschniętej powłoce farby.", "a", "s1")],
        "source_language string, target_language string, source_text string, replace_text string, preferred_text string, "
        "approved_text string, job_id string, segment_id string",
    ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    return phrases.phrase_rows(raw)


def _pair(spark, text="Tekst o Wysuszonej warstwie farby."):
    return _segments(spark, [("s1", "Text about dry ink film.")]).withColumn("translation", fx.as_translation(F.lit(text)))


def test_phrase_is_applied_or_becomes_a_finding(spark):
    memory_table = _one_phrase(spark)
    trusted = rev.review(_pair(spark), translation.RuleReviewer(), JobConfig(use_user_phrase_memory=True), memory_table).first()
    assert trusted.translation.translated_text == "Tekst o wyschniętej powłoce farby."
    assert trusted.translation.translator_notes[-1].startswith("Applied trusted user phrase memory")
    assert trusted.verdict == "accept" and len(trusted.applied) == 1
    asked = rev.review(_pair(spark), translation.RuleReviewer(), CONFIG, memory_table)
    row = asked.first()
    assert (row.verdict, row.findings[0].category) == ("human_review", "user_phrase_memory")
    assert row.findings[0].proposed_translation == "Tekst o wyschniętej powłoce farby."
    none = spark.createDataFrame([], f"{KEYS}, severity string")
    routes = rev.resolve(_pair(spark), none, rev.explode_findings(asked), spark.createDataFrame([], f"{KEYS}, n int"), CONFIG).first()
    assert routes.unresolved and not routes.revise


@pytest.mark.parametrize("old,new", [("a.b$c\\E(x", "$1 \\d 5"), ("a.b$c\\E(x", "0.5")])
def test_phrases_are_literal_text(spark, old, new):
    df = spark.createDataFrame([(f"Z {old.upper()} {old}", old, new)], "t string, o string, n string")
    got = df.select(phrases.replace_first(F.col("t"), F.col("o"), F.col("n")).alias("r")).first().r
    assert got == f"Z {new} {old}"


def test_decision_cases(spark):
    cases = [
        ("skip", "A", "A", None, None), ("skip", "B", "A", None, "edit"), ("accept", "A", "A", None, "accept"),
        ("accept", "B", "A", None, "edit"), ("skip", "A", "A", "note", "edit"), ("skip", "  A\n\nB ", "A B", None, None),
        ("keep_source", "B", "A", None, "keep_source"),
    ]
    raw = spark.createDataFrame(
        [("j", f"s{i}", *c[:4]) for i, c in enumerate(cases)], f"{KEYS}, action string, edited_text string, original_text string, note string"
    )
    got = {r.segment_id: r.action for r in decisions.build_decisions(raw).collect()}
    assert got == {f"s{i}": c[4] for i, c in enumerate(cases) if c[4]}


def test_edit_note_is_kept_and_undo_takes_it_back(spark):
    segs = _segments(spark, [("s1", "dry ink film"), ("s2", "b")])
    translations = _translations(spark, [("s1", "wysuszonej"), ("s2", "b")])
    unresolved = segs.select("job_id", "segment_id")
    chosen = spark.createDataFrame(
        [("j", "s1", "edit", "wyschnięta", "Fragment poprawiony przez użytkownika: x"), ("j", "s2", "edit", None, None)],
        f"{KEYS}, action string, text string, note string",
    )
    after, remaining = decisions.apply_decisions(segs, translations, unresolved, chosen)
    rows = {r.segment_id: r.translation for r in after.collect()}
    assert rows["s1"].translated_text == "wyschnięta"
    assert rows["s1"].translator_notes == ["Operator edited translation.", "Fragment poprawiony przez użytkownika: x"]
    assert rows["s2"].translated_text == "b" and rows["s2"].translator_notes == []
    assert remaining.count() == 0
    undone, reopened = decisions.undo_decisions(segs, after, remaining, chosen)
    back = {r.segment_id: r.translation for r in undone.collect()}
    assert (back["s1"].translated_text, back["s1"].translator_notes, back["s1"].confidence) == ("wyschnięta", [], "medium")
    assert reopened.count() == 2


def test_refinement_suggestions(spark):
    current = "Europejska informacja"
    translations = spark.createDataFrame([("j", s, current) for s in ("a", "b", "c", "d")], f"{KEYS}, translated_text string")
    issues = spark.createDataFrame(
        [("j", "a", 0, None, "Europejskie oświadczenie"), ("j", "b", 0, "lepsza fraza", current), ("j", "c", 0, None, current),
         ("j", "d", 0, current.upper(), "informacja"), ("j", "d", 1, "druga", None)],
        f"{KEYS}, pos int, proposed_translation string, translation_evidence string",
    )
    got = {r.segment_id: (r.replace_text, r.preferred_text) for r in phrases.suggest_refinement(translations, issues).collect()}
    assert got == {"a": (current, "Europejskie oświadczenie"), "b": (current, "lepsza fraza"), "c": (current, ""), "d": (current, "druga")}


@pytest.mark.parametrize("raw,expected", [
    ('{"usage_metadata":{"input_tokens":120,"output_tokens":30,"total_tokens":150}}', (120, 30, 150)),
    ('{"usage_metadata":null,"response_metadata":{"token_usage":{"prompt_tokens":40,"completion_tokens":12,"total_tokens":52}}}', (40, 12, 52)),
    ('{"response_metadata":{"usage":{"prompt_tokens":75,"completion_tokens":25}}}', (75, 25, 100)),
    ('{"usage_metadata":{"input_tokens":90,"output_tokens":15}}', (90, 15, 105)),
    ('{"usage":{"input_tokens":0}}', None),
])
def test_usage_shapes(spark, raw, expected):
    u = spark.createDataFrame([(raw,)], "r string").select(extract_usage(F.col("r"), "openai", "m", "translate").alias("u")).first().u
    assert (u and (u.input_tokens, u.output_tokens, u.total_tokens)) == expected


def test_stale_statuses(spark):
    rows = [("translating 1/2", 2, 2, 0, "segments_translated"), ("reviewing 1/2", 2, 2, 2, "translation_reviewed"),
            ("pipeline translated 2/2, reviewed 1/2", 2, 2, 2, "translation_reviewed"), ("translating 1/2", 2, 1, 0, "translating 1/2")]
    df = spark.createDataFrame(rows, "status string, segments int, translations int, reviews int, expected string")
    assert all(r.got == r.expected for r in df.select("expected", reports.normalize_status().alias("got")).collect())


def test_bad_payloads_are_skipped(spark):
    df = spark.createDataFrame([("a", "not json", "2024-01-01"), ("b", '{"job_id":"b","config":{"target_language":"Polish"},"status":"x",'
        '"segments":[{"segment_id":"s1","source_text":"q"}],"translations":{"s1":{"translated_text":"0.01 mg"}}}', "2024-01-01")],
        "job_id string, payload_json string, at string").withColumn("updated_at", F.col("at").cast("timestamp"))
    rows = job_store.restore_translations(df).collect()
    assert [(r.job_id, r.translation.translated_text) for r in rows] == [("b", "0,01 mg")]
    assert job_store.cache_backfill(df).count() == 1


def test_file_fingerprints(spark, tmp_path):
    import hashlib

    (tmp_path / "a.pdf").write_bytes(b"abc")
    found = files.file_fingerprints(spark, str(tmp_path)).first()
    assert found.sha256 == hashlib.sha256(b"abc").hexdigest()
    wanted = spark.createDataFrame([(found.path,), ("none",)], "path string")
    got = {r.path: r.sha256 for r in job_store.with_fingerprint(wanted, files.file_fingerprints(spark, str(tmp_path)), "path").collect()}
    assert got["none"] == "missing"


def test_lines_are_anchored_to_their_first_word(spark):
    tops = [10.0, 12.0, 13.0, 13.5, 16.4, 16.6]
    words = spark.createDataFrame(
        [(1, 1, f"w{i}", float(50 - i), 60.0, t, t + 5, 10.0 + i, "Arial-BOLD" if i == 0 else "Arial") for i, t in enumerate(tops)],
        "doc_id int, page_number int, word string, x0 double, x1 double, top double, bottom double, size double, fontname string",
    )
    lines = assemble_lines(words).orderBy("line_no").collect()
    # 13.5 is over 3 away from 10; 16.4 is within 3 of 13.5, 16.6 is not.
    assert [l.text for l in lines] == ["w2 w1 w0", "w4 w3", "w5"]
    assert [l.font_size for l in lines] == [11.0, 13.5, 15.0] and lines[0].is_bold and not lines[1].is_bold
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 13.0)], "doc_id int, page_number int, x0 double, top double, x1 double, bottom double")
    assert words_outside(words, boxes).count() == 5


def test_loop_revises_once_and_stops(spark):
    work = _segments(spark, [("s1", "Result 5 kg"), ("s2", "the unchanged")]).withColumns({
        "translation": F.when(F.col("segment_id") == "s1", fx.as_translation(F.lit("Wynik 6 kg"))).otherwise(fx.as_translation(F.col("source_text"))),
        "findings": F.when(F.col("segment_id") == "s1", F.expr(
            "array(named_struct('severity','major','category','c','source_evidence','','translation_evidence','','explanation','',"
            "'proposed_translation','Wynik 5 kg','confidence','high'))")).otherwise(rev.no_findings()),
        "verdict": F.lit("human_review"), "applied": F.expr("cast(array() as array<string>)"), "attempts": F.lit(0),
    })
    state = workflow.review_loop(work, fx.terms(), translation.RuleTranslator(fx.terms()), translation.RuleReviewer(), CONFIG)
    rows = {r.segment_id: r for r in state.work.collect()}
    assert (rows["s1"].translation.translated_text, rows["s1"].attempts, rows["s1"].verdict) == ("Wynik 5 kg", 1, "accept")
    assert [r.segment_id for r in state.unresolved.collect()] == ["s2"]


def test_stream_resumes_without_redoing_work(spark, tmp_path):
    pages, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "job_id bigint, page_number bigint, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(pages)
        stream.start_incremental(
            stream.stream_segments(spark.readStream.schema(schema).parquet(pages)), out, checkpoint, fx.PrefixTranslator(),
            translation.RuleReviewer(), fx.terms(), CONFIG, available_now=True,
        ).awaitTermination()

    add([(1, 1, "alpha\n\nbeta\nalpha")])
    add([(1, 2, "beta\ngamma"), (1, 1, "alpha\n\nbeta\nalpha"), (2, 1, "alpha")])
    rows = {(r.job_id, r.segment_id): r for r in stream.read_results(spark, out).collect()}
    assert len(rows) == stream.read_results(spark, out).count() == 6
    routes = {k: r.route for k, r in rows.items()}
    assert routes[(1, "p001-b0000")] == "miss" and routes[(1, "p001-b0003")] == "duplicate"
    assert routes[(1, "p002-b0000")] == "memory" and routes[(1, "p002-b0001")] == "miss" and routes[(2, "p001-b0000")] == "persistent"
    assert all(r.epoch == 0 for k, r in rows.items() if k[1].startswith("p001") and k[0] == 1)


def test_progress_sink_failure_does_not_stop(spark, tmp_path):
    def broken(batch, epoch):
        raise RuntimeError("display gone")

    source = str(tmp_path / "e")
    spark.range(3).selectExpr("id as job_id", "'s' as stage", "id as current", "3 as total").write.parquet(source)
    events = spark.readStream.schema("job_id bigint, stage string, current bigint, total int").parquet(source)
    query = stream.progress_stream(events).writeStream.outputMode("update").foreachBatch(stream.safe_sink(broken)).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_progress_windows(spark):
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 5), ("2024-01-01 01:10:00", "a", 2)]
    events = spark.createDataFrame(rows, "at string, stage string, current int").withColumn("ts", F.col("at").cast("timestamp"))
    got = stream.progress_windows(events).orderBy("window_start").collect()
    assert [(r.events, r.current) for r in got] == [(2, 5), (1, 2)]


def test_reports_are_written_as_json(spark, tmp_path):
    path = str(tmp_path / "reports")
    job_store.write_reports(spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, segments_total int"), path)
    back = spark.read.json(path)
    assert {(r.job_id, r.segments_total) for r in back.collect()} == {("a", 1), ("b", 2)}


def test_language_options():
    from segqa.sources.languages import LANGUAGES, options_with_current

    assert options_with_current("Klingon")[0] == "Klingon" and options_with_current("Polish") == LANGUAGES


def test_text_of_an_earlier_job_counts_as_persistent(spark):
    segs = spark.createDataFrame(
        [(j, f"s{i}", i, t) for j in (1, 2) for i, t in enumerate(["Same text", "Same  text", f"Own {j}"])],
        "job_id bigint, segment_id string, order_index bigint, source_text string",
    )
    known = segs.limit(0).select("job_id", "segment_id", fx.as_translation(F.lit("x")).alias("translation"))
    cache = spark.createDataFrame([], memory.CACHE_COLUMNS)
    done = memory.translate_corpus(segs, known, cache, fx.PrefixTranslator(), fx.REUSE_CONFIG)
    counted = {r.job_id: (r.memory_hits, r.persistent_hits, r.misses) for r in memory.reuse_counters(done).collect()}
    assert counted == {1: (1, 0, 2), 2: (1, 1, 1)}
    notes = {(r.job_id, r.segment_id): r.translation.translator_notes for r in done.collect()}
    assert "persistent cache job 1" in " ".join(notes[2, "s0"])


def test_clients_report_usage_and_see_what_they_revise(spark):
    usage = {"provider": "p", "model": "m", "operation": "translate", "input_tokens": 7, "output_tokens": 3, "total_tokens": 10}

    def open_translator():
        def call(batch):
            import pandas as pd

            told = [f"{c['translated_text']}|{'+'.join(f['explanation'] for f in fs)}|{i}" for c, fs, i in zip(
                batch.get("current_translation", []), batch.get("review_findings", []), batch.get("instruction", []), strict=True
            )]
            return pd.DataFrame({
                "translated_text": "PL: " + batch["source_text"], "translator_notes": [[t] for t in told] or [[] for _ in range(len(batch))],
                "confidence": "high", "uncertain_terms": [["u"] for _ in range(len(batch))], "token_usage": [usage for _ in range(len(batch))],
            })

        return call

    def open_reviewer():
        def call(batch):
            import pandas as pd

            return pd.DataFrame({"findings": [[] for _ in range(len(batch))], "token_usage": [usage | {"operation": "review"} for _ in range(len(batch))]})

        return call

    client = translation.ClientTranslator(open_translator, "German")
    segs = spark.createDataFrame([(1, "s1", 0, "One"), (1, "s2", 1, "Two")], "job_id bigint, segment_id string, order_index bigint, source_text string")
    done = client.translate(segs).select("job_id", "segment_id", "source_text", "translation")
    row = done.where("segment_id = 's1'").first().translation
    assert row.token_usage.total_tokens == 10 and row.uncertain_terms == ["u"] and row.source_terms_retained == []
    found = spark.createDataFrame(
        [(1, "s1", p, "major", "c", "", "", f"e{p}", None, "high") for p in (1, 0)],
        "job_id bigint, segment_id string, pos int, severity string, category string, source_evidence string, translation_evidence string, "
        "explanation string, proposed_translation string, confidence string",
    )
    again = translation.revise(done.withColumn("attempts", F.lit(0)), found.where("segment_id = 's1'"), client, "German").where("segment_id = 's1'").first()
    assert again.translation.translator_notes == ["PL: One|e0+e1|Revise only the material issues. Preserve protected tokens."]
    reviewed = rev.review(done, translation.ClientReviewer(open_reviewer), CONFIG)
    state = workflow.RunState(reviewed, None, None, None)
    usages = state.work.select("job_id", F.explode(F.array("translation.token_usage", "review_usage")).alias("token_usage"))
    totals = {r.operation: (r.requests, r.total_tokens) for r in reports.token_usage(usages, "operation").collect()}
    assert totals["translate"] == (2, 20) and totals["review"] == (2, 20)


def test_a_run_writes_back_and_finishes(spark):
    segs = _segments(spark, [("s1", "Result 5 kg"), ("s2", "was below 3 mg")])
    none = segs.limit(0).select("job_id", "segment_id", fx.as_translation(F.lit("x")).alias("translation"))
    cache = spark.createDataFrame([], memory.CACHE_COLUMNS)
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    for hits in (0, 1):
        state, routed = workflow.run_corpus(segs, none, cache, fx.terms(), fx.PrefixTranslator(), translation.RuleReviewer(), CONFIG, fx.phrase_memory(spark))
        cache = workflow.store_translations(routed, cache, CONFIG, now)
        assert [r.hits for r in cache.collect()] == [hits, hits]
        cache = spark.createDataFrame(cache.collect(), cache.schema)
    used = state.work.select(F.explode("applied").alias("k")).count()
    assert workflow.touch_phrases(state, fx.phrase_memory(spark), now).agg(F.sum("hits")).first()[0] == used
    assert workflow.remaining(segs, state.work.where("segment_id = 's1'")).select("segment_id").collect() == [("s2",)]
    outputs = spark.createDataFrame([("j", "PL: Result 5 kg PL: was below 3 mg")], "job_id string, text string")
    decided = state.work.select("job_id", "segment_id", F.lit("accept").alias("action"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("note"))
    rows = workflow.finish(segs, workflow.finalize(state, decided), routed, outputs).collect()
    assert len(rows) == 1 and rows[0].output_ok and rows[0].next_step == "render_pdf" and rows[0].persistent_translation_cache_hits == 2


def test_progress_of_many_batches_needs_no_state(spark, tmp_path):
    given, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "job_id bigint, stage string, current bigint, total bigint"
    for n in range(5):
        spark.createDataFrame([(1, "translate", n, 5), (n, "review", 1, 1)], schema).coalesce(1).write.mode("append").parquet(given)
        stream.write_progress(spark.readStream.schema(schema).parquet(given), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
        # A batch holds what came in since the last one only.
        assert spark.read.parquet(f"{out}/epoch={n}").agg(F.sum("events")).first()[0] == 2
    rows = {(r.job_id, r.stage): (r.current, r.total, r.events) for r in stream.read_progress(spark, out).collect()}
    assert rows == {(1, "translate"): (4, 5, 5)} | {(n, "review"): (1, 1, 1) for n in range(5)}


def test_closed_reports_name_files_status_and_verification(spark):
    report = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "job_id int, segments_total int")
    jobs = spark.createDataFrame([(1, "a", "x", "completed"), (2, "b", None, "translating"), (4, "d", None, None)], "job_id int, source_path string, output_path string, status string")
    prints = spark.createDataFrame([("a", "ha"), ("b", "hb")], "path string, sha256 string")
    texts = spark.createDataFrame([(1, "jeden dwa {{T_1}}")], "job_id int, text string")
    wanted = spark.createDataFrame([(1, "s1", "Jeden"), (1, "s2", "trzy"), (2, "s1", "x y z")], "job_id int, segment_id string, translated_text string")
    rows = {r.job_id: r for r in reports.close_reports(report, jobs, prints, texts, wanted).collect()}
    assert {j: (r.status, r.source_sha256, r.output_sha256) for j, r in rows.items()} == {
        1: ("completed", "ha", "missing"), 2: ("translating", "hb", None), 3: ("unknown", None, None),
    }
    check = rows[1].output_verification
    assert (check.ok, check.extracted_text_chars, check.missing_segments, check.placeholder_leaks, len(check.messages)) == (False, 17, 1, ["{{T_1}}"], 2)
    assert rows[2].output_verification is None and rows[3].output_verification is None


def test_page_rows_give_the_lines_of_word_rows_without_any_shuffle(spark):
    """Pages with words and boxes as one row: nulls, NaN, equal words and an empty page; nothing is exchanged."""
    nan = float("nan")
    words = [
        ("b", 1, 50.0, 60.0, 10.0, 15.0, None, None), ("a", 0, 50.0, 60.0, 10.04, 15.0, 9.0, "X-bold"), (None, 2, 10.0, 20.0, 11.0, 16.0, 0.0, "Y"),
        ("c", 3, None, 20.0, 40.25, 45.0, 8.0, "Y"), ("d", 4, nan, 20.0, 40.35, nan, 9.0, "Y"), ("same", 5, 5.0, 6.0, 90.0, 91.0, 7.0, "Z"),
        ("same", 5, 5.0, 6.0, 90.0, 91.0, 7.0, "A"), ("out", 6, 200.0, 210.0, 90.0, 91.0, 7.0, "Z"), ("last", 7, 1.0, 2.0, None, 1.0, 3.0, "Z"),
    ]
    kind = "array<struct<word:string,seq:bigint,x0:double,x1:double,top:double,bottom:double,size:double,fontname:string>>"
    boxes = [(150.0, 80.0, 300.0, 95.0), (150.0, 80.0, 301.0, 95.0)]
    pages = spark.createDataFrame(
        [(1, 1, words, boxes), (1, 2, [], []), (2, 1, words[:2], None)],
        f"doc_id int, page_number int, words {kind}, boxes array<struct<x0:double,top:double,x1:double,bottom:double>>",
    )
    lines = page_lines(pages)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r[2:]) for r in lines.where("doc_id = 1").orderBy("line_no").collect()]
    # Null tops come first and do not anchor; 10.04 rounds to 10.0; 40.25 and 40.35 round to even; missing words leave no blank.
    assert got[0][:2] == (0, "last") and got[0][3] is None
    assert got[1] == (1, "a b", 10.0, 10.0, 60.0, 16.0, 0.0, "Y", True, 3, 7.0)
    assert got[2][1] == "c d" and got[2][8] is False
    assert got[3][:2] == (3, "same same") and got[3][7] == "A" and len(got) == 4
    rows = pages.selectExpr("doc_id", "page_number", "inline(words)")
    flat = pages.where("boxes is not null").selectExpr("doc_id", "page_number", "inline(boxes)")
    by_row = assemble_lines(words_outside(rows, flat))
    assert sorted(map(repr, by_row.collect())) == sorted(map(repr, lines.collect()))
