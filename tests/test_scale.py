import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segqa import fixtures as fx
from segqa.operators import phrases, pieces, reports
from segqa.plans import scale
from segqa.config import JobConfig


def _jobs(spark, n=600):
    """Two thirds of the rows in one job."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7 + 1).alias("job_id"), F.col("id").alias("row"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_equals_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(scale, "HOT_FLOOR", 50)
    big = _jobs(spark)
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "job_id bigint, v string")
    assert scale.hot_keys(big.groupBy("job_id").agg(F.count("*").alias("n")), ["job_id"]).count() == 1
    salted = scale.skew_join(big, small, ["job_id"], how, spread_by=["row"])
    plain = big.join(small, ["job_id"], how)
    assert sorted(salted.collect()) == sorted(plain.select(*salted.columns).collect())
    if how == "left":
        # The hot job no longer sits behind one join key.
        text = salted._jdf.queryExecution().toString()
        assert "__salt" in text


def test_chunked_numbering_and_neighbours_equal_windows(spark):
    df = _jobs(spark)
    w = W.partitionBy("job_id").orderBy("row")
    numbered = scale.number_rows(df, ["job_id"], F.col("row"), ["row"], "n", chunk=16)
    expected = df.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    assert sorted(numbered.select("job_id", "row", "n").collect()) == sorted(expected.select("job_id", "row", "n").collect())
    near = scale.with_neighbours(numbered, ["job_id"], "n", "text", "p", "f", chunk=16)
    plain = expected.withColumn("p", F.lag("text").over(w)).withColumn("f", F.lead("text").over(w))
    key = ["job_id", "n", "p", "f"]
    assert sorted(near.select(*key).collect(), key=str) == sorted(plain.select(*key).collect(), key=str)


def test_running_offsets(spark):
    counts = spark.createDataFrame([(j, p, p % 3) for j in (1, 2) for p in range(100)], "job_id int, page int, n int")
    got = scale.running_offsets(counts, ["job_id"], "page", "n", chunk=8)
    assert {(r.job_id, r.page): r.offset for r in got.collect()} == {
        (j, p): sum(i % 3 for i in range(p)) for j in (1, 2) for p in range(100)
    }


def test_output_texts_of_any_length_equal_a_plain_search(spark, monkeypatch):
    long = " ".join(f"Wynik {i} mg" for i in range(400)) + " {{A_1}}"
    texts = spark.createDataFrame([(1, long), (2, "abc"), (4, "Źdźbło  ŻÓŁĆ ąę")], "job_id int, text string")
    wanted = spark.createDataFrame(
        [(1, f"s{i}", f"wynik  {i} mg Wynik {i + 1} mg wynik {i + 2} mg wynik {i + 3}") for i in range(0, 500, 7)]
        + [(1, "a", "MG W"), (1, "b", "xyz"), (1, "c", "zz"), (2, "d", "abc"), (2, "e", "abd"), (2, "f", "wynik 3 mg"), (3, "g", "no output")]
        + [(4, "h", "źdźbło żółć"), (4, "i", "żółć"), (4, "j", "żółw"), (4, "k", " ąę "), (4, "l", None), (1, "m", long), (1, "n", long[:200] + "x" * 300)],
        "job_id int, segment_id string, translated_text string",
    )
    plain = lambda t: " ".join((t or "").split()).lower()
    outputs = {r.job_id: plain(r.text) for r in texts.collect()}
    expected = sorted(
        (r.job_id, r.segment_id) for r in wanted.collect()
        if r.job_id in outputs and len(plain(r.translated_text)) > 2 and plain(r.translated_text)[:40] not in outputs[r.job_id]
    )
    assert sorted(map(tuple, reports.missing_segments(texts, wanted).collect())) == expected
    monkeypatch.setattr(reports, "PLACES", 3)
    monkeypatch.setattr(pieces, "STEP", 64)
    assert sorted(map(tuple, reports.missing_segments(texts, wanted).collect())) == expected
    assert {(1, "b"), (2, "e"), (2, "f"), (4, "j")} <= set(expected)
    done = {r.job_id: r for r in reports.verify_output(texts, wanted).collect()}
    assert done[1].placeholder_leaks == ["{{A_1}}"] and not done[1].ok


def test_large_phrase_memories_equal_a_plain_search(spark):
    words = ["fraza", "zwrot", "wynik", "próbka", "migracja", "ź", "ab"]
    rows = [("English", "Polish", f"src {i}" if i % 3 else "", f"{words[i % 7]} {i} ", f"nowy {i}", "", "j", f"s{i}", i) for i in range(20_000)]
    rows += [("English", "Polish", "", short, "krótki", "", "j", f"x{n}", 20_000 + n) for n, short in enumerate(["Ź", "q", "+"])]
    names = "source_language string, target_language string, source_text string, replace_text string, preferred_text string, " \
        "approved_text string, job_id string, segment_id string, at long"
    memory = phrases.phrase_rows(spark.createDataFrame(rows, names).withColumn("updated_at", F.timestamp_seconds("at"))).cache()
    texts = [(1, f"p{i}", f"src {i}", " ".join(f"{words[k % 7].title()}  {k}" for k in range(i, i + 1 + i % 9))) for i in range(0, 4000, 97)]
    texts += [(2, "long", "x", "Tekst " * 200 + "Migracja 4 " + "tekst " * 200), (2, "none", None, None), (2, "blank", "src 1", " "), (2, "short", "", "a + b")]
    pairs = spark.createDataFrame(texts, "job_id int, segment_id string, source_text string, translated_text string")
    found = phrases.phrase_matches(pairs, memory, JobConfig()).collect()
    assert len(found) == len(texts)
    got = {(r.job_id, r.segment_id): sorted(m.cache_key for m in r.matches) for r in found}
    stored = [(r.updated_at, r.cache_key, r.normalized_replace, r.normalized_preferred, r.normalized_source) for r in memory.collect()]
    for job, segment, source, text in texts:
        s, t = " ".join((source or "").split()).lower(), " ".join((text or "").split()).lower()
        applying = sorted(((at, key) for at, key, old, new, src in stored if t and new not in t and (old in t or (s and s == src))), reverse=True)
        assert got[job, segment] == sorted(key for _, key in applying[:5]), segment


def test_reports_in_parts_hold_every_entry_once(spark):
    issues = spark.createDataFrame(
        [(1, f"s{i}", "critical", "t", "a", "b", "m") for i in range(250)] + [(2, "x", "critical", "t", "a", "b", "m")],
        "job_id int, segment_id string, severity string, issue_type string, source_value string, translated_value string, message string",
    )
    findings = spark.createDataFrame(
        [], "job_id int, segment_id string, severity string, category string, source_evidence string, translation_evidence string, explanation string"
    )
    report = spark.createDataFrame([(1, 250, 0), (2, 1, 0), (3, 0, 0)], "job_id int, deterministic_issues int, review_findings int")
    parts = reports.nested_reports(report, issues, findings, part_size=100).collect()
    ids = [i.segment_id for r in parts if r.job_id == 1 for i in r.issues]
    assert len(ids) == len(set(ids)) == 250 and max(len(r.issues or []) for r in parts) <= 100
    assert sorted(r.job_id for r in parts if r.job_id > 1) == [2, 3]


def test_hot_text_is_routed_alike_with_and_without_salting(spark, monkeypatch):
    from segqa import fixtures as fx
    from segqa.operators import memory

    segs = spark.range(900).select(
        (F.col("id") % 2).alias("job_id"), F.format_string("s%04d", "id").alias("segment_id"), F.col("id").alias("order_index"),
        F.when(F.col("id") % 3 == 0, F.lit("Strona 1")).otherwise(F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).alias("source_text"),
    )
    known = segs.where("segment_id = 's0101'").select("job_id", "segment_id", fx.as_translation(F.lit("znane")).alias("translation"))

    def run():
        cache = spark.createDataFrame([], memory.CACHE_COLUMNS)
        out = memory.translate_corpus(segs, known, cache, fx.PrefixTranslator(), JobConfig())
        return sorted((r.segment_id, r.route, r.translation.translated_text, tuple(r.translation.translator_notes)) for r in out.collect())

    plain = run()
    monkeypatch.setattr(scale, "HOT_FLOOR", 50)
    assert run() == plain and len(plain) == 900
    # Fifty numbered texts per job and one page mark, which job 1 reuses; "t1" of job 1 is known already.
    assert sum(route == "miss" for _, route, _, _ in plain) == 2 * 50 + 1 - 1
    assert sum(route == "persistent" for _, route, _, _ in plain) == 1


def test_blank_and_null_outputs_hold_no_translation(spark):
    texts = spark.createDataFrame([(1, " " * 200), (2, None), (3, "Wynik 1 mg"), (4, "")], "job_id int, text string")
    wanted = spark.createDataFrame([(j, "s", "Wynik 1 mg") for j in (1, 2, 3, 4)], "job_id int, segment_id string, translated_text string")
    assert sorted(reports.missing_segments(texts, wanted).collect()) == [(1, "s"), (2, "s"), (4, "s")]
    done = {r.job_id: r for r in reports.verify_output(texts, wanted).collect()}
    assert [done[j].ok for j in (1, 2, 3, 4)] == [False, False, True, False]
    assert done[2].missing_segments == 1 and done[2].extracted_text_chars == 0


def test_salts_follow_the_rows_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_FLOOR", 50)
    counts = spark.createDataFrame([(0, 400), (1, 51), (2, 50)], "job_id bigint, n bigint")
    assert sorted(scale.hot_keys(counts, ["job_id"]).collect()) == [(0, 8), (1, 2)]


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.shared_dir(Session())


def test_found_prefixes_leave_the_task_in_bounded_parts(spark, monkeypatch):
    from segqa.operators import reports

    monkeypatch.setattr(reports, "HELD", 3)
    words = [f"wording number {i}" for i in range(40)]
    texts = spark.createDataFrame([(j, " ".join(words[j:])) for j in range(2)], "job_id int, text string").coalesce(1)
    made = spark.createDataFrame([(j, f"s{i}", w) for j in range(2) for i, w in enumerate(words)], "job_id int, segment_id string, translated_text string")
    assert [tuple(r) for r in reports.missing_segments(texts, made).collect()] == [(1, "s0")]


def test_reuse_moves_no_text_to_decide_routes(spark):
    """Routes by short keys: blank texts stay apart, and no exchange but the last join's carries the source text."""
    from segqa.operators import memory as mem

    texts = ["a  b", "a b", "", " ", "c", "c"]
    rows = [(1, f"s{i}", i, t) for i, t in enumerate(texts)] + [(2, "s0", 0, "a b"), (2, "s1", 1, "")]
    segments = spark.createDataFrame(rows, "job_id long, segment_id string, order_index long, source_text string")
    none = spark.createDataFrame([(1, "s4")], "job_id long, segment_id string").withColumn("translation", fx.as_translation(F.lit("C")))
    cache = spark.createDataFrame([], mem.CACHE_COLUMNS)
    routed = mem.route_reuse(segments, none, cache, fx.SCOPE, "German")
    got = {(r.job_id, r.segment_id): (r.route, r.norm) for r in routed.collect()}
    assert got == {
        (1, "s0"): ("miss", "a b"), (1, "s1"): ("duplicate", "a b"), (1, "s2"): ("miss", ""), (1, "s3"): ("miss", ""),
        (1, "s4"): ("existing", "c"), (1, "s5"): ("memory", "c"), (2, "s0"): ("miss", "a b"), (2, "s1"): ("miss", ""),
    }
    stated = mem.written(routed)
    assert stated.columns == routed.columns and sorted(map(repr, stated.collect())) == sorted(map(repr, routed.collect()))

    def joins(node):
        below = [joins(node.children().apply(i)) for i in range(node.children().length())]
        return sum(below) + (node.nodeName() == "Join" and "source_text#" in node.output().mkString(" "))

    # The texts enter one join; before, they went through the join of translations and through that of plans.
    assert joins(routed._jdf.queryExecution().optimizedPlan()) == 1
    made = mem.translate_distinct(stated, fx.PrefixTranslator(), "German")
    assert {(r.job_id, r.segment_id): r.route for r in made.collect()}[(2, "s0")] == "persistent"
