"""Operator phrase memory.

A phrase applies to a translation that contains its wording, or to a source text that equals
its own. Both are found by equality joins, whatever the size of the memory: a phrase is
filed under the short piece of its wording that is rarest in all texts, and a text is looked up
under those of its pieces that a filter of all filed ones lets through (:mod:`segqa.operators.pieces`).
What meets is verified. The newest few matches of a pair of texts then become one array, which the
rest of the work folds over inside the row. Matches depend on the two texts alone, so equal pairs
are matched once (:mod:`segqa.operators.pairs`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from segqa.config import JobConfig
from segqa.functions.glossary import strings
from segqa.functions.locale import apply_locale, with_note
from segqa.functions.rules import finding, merge_verdict, translation
from segqa.functions.text import casefold, clean_phrase, let, normalize_phrase, normalize_ws, strip_ws
from segqa.operators.memory import touch_by_key, upsert_by_key
from segqa.operators.pairs import KEY, SEGMENT, TEXTS, back_to_rows, distinct_pairs, keyed
from segqa.operators.pieces import key_filter, lookups, piece_counts, pieces_of
from segqa.operators.validation import pair_issues
from segqa.plans.scale import materialize, skew_join
from segqa.sources.glossary import Term

PHRASE_COLUMNS = (
    "cache_key string, source_language string, target_language string, normalized_source string, "
    "normalized_replace string, normalized_preferred string, source_text string, replace_text string, "
    "preferred_text string, approved_text string, origin_job_id string, origin_segment_id string, "
    "created_at timestamp, updated_at timestamp, last_used_at timestamp, hits bigint"
)
_REPLACED = [
    "normalized_source", "normalized_preferred", "source_text", "replace_text", "preferred_text", "approved_text",
    "origin_job_id", "origin_segment_id",
]
# The newest phrases that are tried on a segment.
MATCH_LIMIT = 5


def phrase_key(source_language: Column, target_language: Column, normalized_replace: Column) -> Column:
    return F.sha2(
        F.concat(casefold(source_language), F.lit("\0"), casefold(target_language), F.lit("\0"), normalized_replace), 256
    )


def phrase_rows(rows: DataFrame) -> DataFrame:
    """Storable phrases from ``rows(source_language, target_language, source_text, replace_text,
    preferred_text, approved_text, job_id, segment_id, updated_at)``; empty or unchanged ones drop out."""
    norm = rows.withColumns({
        "normalized_source": normalize_phrase(F.col("source_text")),
        "normalized_replace": normalize_phrase(F.col("replace_text")),
        "normalized_preferred": normalize_phrase(F.col("preferred_text")),
    })
    kept = norm.where(
        (F.col("normalized_replace") != "")
        & (F.col("normalized_preferred") != "")
        & (F.col("normalized_replace") != F.col("normalized_preferred"))
    )
    return kept.select(
        phrase_key(F.col("source_language"), F.col("target_language"), F.col("normalized_replace")).alias("cache_key"),
        "source_language",
        "target_language",
        "normalized_source",
        "normalized_replace",
        "normalized_preferred",
        *[normalize_ws(F.col(c)).alias(c) for c in ("source_text", "replace_text", "preferred_text", "approved_text")],
        F.col("job_id").cast("string").alias("origin_job_id"),
        F.col("segment_id").alias("origin_segment_id"),
        F.col("updated_at").alias("created_at"),
        "updated_at",
        F.col("updated_at").alias("last_used_at"),
        F.lit(0).cast("bigint").alias("hits"),
    )


def phrase_upsert(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """Store phrases (H1): the latest wording wins, usage history stays."""
    return upsert_by_key(memory, phrase_rows(rows), "cache_key", _REPLACED)


phrase_touch = touch_by_key


def phrase_count(memory: DataFrame) -> DataFrame:
    return memory.groupBy("source_language", "target_language").agg(F.count(F.lit(1)).alias("phrases"))


def _filed(phrases: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[int]]:
    """Phrases with ``key``: once under the rarest piece of their wording, once under their source text if they have one.

    Also the sizes of the pieces, at most ``PIECE`` different ones.
    """
    held = materialize(pieces_of(phrases, "cache_key", "normalized_replace"))
    sizes = sorted(r[0] for r in held.select("size").distinct().collect())
    counts = piece_counts(texts, "t", key_filter(held.select("key")), sizes)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("rarest")
    # A phrase with a piece that no text has is in no text, and its key meets nothing.
    anchors = held.join(counts, "key", "left").groupBy("id").agg(rarest).select(F.col("id").alias("cache_key"), F.col("rarest.key").alias("key"))
    worded = phrases.join(anchors, "cache_key").withColumn("reason", F.lit("target_phrase"))
    sourced = phrases.where("normalized_source <> ''").withColumns({"key": _source_key(F.col("normalized_source")), "reason": F.lit("source_exact")})
    return materialize(worded.unionByName(sourced)), sizes


def _source_key(source: Column) -> Column:
    return F.xxhash64(F.lit("source"), source)


def _met(keyed_pairs: DataFrame, memory: DataFrame, config: JobConfig, limit: int) -> tuple[DataFrame, DataFrame]:
    """All distinct pairs, and ``(pair_key, matches)`` of those that a phrase applies to."""
    same_pair = (F.col("source_language") == config.source_language) & (F.col("target_language") == config.target_language)
    usable = (F.col("normalized_replace") != "") & (F.col("normalized_preferred") != "")
    phrases = memory.where(same_pair & usable)
    # Written before anything is filtered: a filter on a normalized text would normalize it once more.
    pairs = materialize(distinct_pairs(keyed_pairs).withColumns(
        {"s": normalize_phrase(F.col("source_text")), "t": normalize_phrase(F.col("translated_text"))}
    ))
    # Read twice: for the counts of pieces and for the look-up.
    texts = pairs.where("t <> ''").select(KEY, "s", "t")
    filed, sizes = _filed(phrases, texts)
    met = lookups(texts, "t", _source_key(F.col("s")), key_filter(filed.select("key")), sizes).join(filed, "key")

    # A pair that meets by wording and by source counts once, by wording.
    holds = F.contains("t", "normalized_replace")
    same = (F.col("s") != "") & (F.col("s") == F.col("normalized_source"))
    applying = met.where(F.when(F.col("reason") == "target_phrase", holds).otherwise(same & ~holds) & ~F.contains("t", "normalized_preferred"))
    newest = W.partitionBy(KEY).orderBy(F.desc("updated_at"), F.desc("cache_key"))
    kept = applying.withColumn("pos", F.row_number().over(newest) - 1).where(F.col("pos") < limit)
    match = F.struct(
        F.when(F.col("reason") == "target_phrase", 0).otherwise(1).alias("reason_rank"),
        (-F.length("replace_text")).alias("neg_len"),
        F.col("pos").cast("int").alias("pos"),
        "updated_at", "cache_key", "reason", "replace_text", "preferred_text", "approved_text",
    )
    return pairs, kept.groupBy(KEY).agg(F.sort_array(F.collect_list(match)).alias("matches"))


def phrase_matches(pairs: DataFrame, memory: DataFrame, config: JobConfig, limit: int = MATCH_LIMIT) -> DataFrame:
    """Pairs with ``matches``, an ordered array of the newest ``limit`` applying phrases (H2).

    Target phrases and long ones go first. Only usable phrases of the language pair count.
    """
    rows = keyed(pairs)
    distinct, found = _met(rows, memory, config, limit)
    nothing = F.expr(f"cast(array() as array<{_MATCH_FULL}>)")
    return back_to_rows(rows, found, distinct, "left").withColumn("matches", F.coalesce("matches", nothing))


_MATCH_FULL = (
    "struct<reason_rank:int,neg_len:int,pos:int,updated_at:timestamp,cache_key:string,reason:string,"
    "replace_text:string,preferred_text:string,approved_text:string>"
)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first case-insensitive occurrence of ``old``."""
    quoted = F.concat(
        F.lit(r"(?ius)\A(?<head>.*?)\Q"), F.replace(old, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )
    escaped = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit(r"\$"))
    return F.regexp_replace(text, quoted, F.concat(F.lit("${head}"), escaped))


def apply_match(text: Column, match: Column) -> Column:
    """What one phrase makes of a text (H3)."""
    approved = match["approved_text"]
    whole = F.when(approved != "", approved).otherwise(match["preferred_text"])

    def build(replaced: Column) -> Column:
        return (
            F.when((match["reason"] == "source_exact") & (approved != ""), approved)
            .when(replaced != text, replaced)
            .when(normalize_phrase(text) == normalize_phrase(match["replace_text"]), whole)
            .otherwise(text)
        )

    def replaced(words: Column) -> Column:
        usable = (words["old"] != "") & (words["new"] != "")
        return F.when(usable, replace_first(text, words["old"], words["new"])).otherwise(text)

    words = F.struct(strip_ws(match["replace_text"]).alias("old"), strip_ws(match["preferred_text"]).alias("new"))
    return let(let(words, replaced), build)


def phrase_note(match: Column) -> Column:
    return F.concat(
        F.lit("Applied trusted user phrase memory: "), match["replace_text"], F.lit(" -> "),
        match["preferred_text"], F.lit("."),
    )


def phrase_apply(matched: DataFrame) -> DataFrame:
    """Apply ``matches`` one after the other to ``translation`` (H3).

    Adds ``applied`` (cache keys of the phrases that changed the text). Untouched
    translations stay as they are.
    """
    value = F.col("translation")
    start = F.struct(value["translated_text"].alias("text"), value["translator_notes"].alias("notes"), strings([]).alias("used"))

    def step(acc: Column, match: Column) -> Column:
        def build(new: Column) -> Column:
            changed = new != acc["text"]
            return F.struct(
                new.alias("text"),
                F.when(changed, with_note(acc["notes"], phrase_note(match))).otherwise(acc["notes"]).alias("notes"),
                F.when(changed, F.array_append(acc["used"], match["cache_key"])).otherwise(acc["used"]).alias("used"),
            )

        return let(apply_match(acc["text"], match), build)

    folded = F.when(F.size("matches") > 0, F.aggregate("matches", start, step))
    out = matched.withColumn("__f", folded)
    applied = F.size("__f.used") > 0
    done = translation(
        F.col("__f.text"), F.col("__f.notes"), F.lit("high"), value["uncertain_terms"],
        value["source_terms_retained"], value["token_usage"],
    )
    return out.withColumn("translation", F.when(applied, done).otherwise(value)).withColumn(
        "applied", F.coalesce(F.col("__f.used"), strings([]))
    ).drop("__f")


def _repr(text: Column) -> Column:
    """Quoted form used in explanations: single quotes unless only those occur inside."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    only_single = F.contains(body, F.lit("'")) & ~F.contains(body, F.lit('"'))
    return F.when(only_single, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit(r"\'")), F.lit("'"))
    )


def phrase_finding_array(matches: Column, source: Column, translated: Column) -> Column:
    """A major finding per match that would change the text, each against the original (H4)."""
    def one(match: Column) -> Column:
        def build(proposal: Column) -> Column:
            evidence = F.when(match["reason"] == "target_phrase", match["replace_text"]).otherwise(translated)
            # The wording of the explanation.
            explanation = F.concat(
                F.lit("Pamięć fraz operatora ma zatwierdzoną podmianę: użyj "), _repr(match["preferred_text"]),
                F.lit(" zamiast "), _repr(match["replace_text"]), F.lit("."),
            )
            return F.when(proposal != translated, finding(
                F.lit("major"), F.lit("user_phrase_memory"), source, evidence, explanation, proposal
            ))

        return let(apply_match(translated, match), build)

    return F.array_compact(F.transform(matches, one))


def _exploded(rows: DataFrame, found: Column) -> DataFrame:
    # The outer form keeps the planner from computing the array a second time to test it.
    return rows.select(*SEGMENT, F.inline_outer(found)).where(F.col("category").isNotNull())


def phrase_findings(matched: DataFrame) -> DataFrame:
    """Findings of the rows of :func:`phrase_matches`, one row each (H4)."""
    return _exploded(matched, phrase_finding_array(F.col("matches"), *map(F.col, TEXTS)))


def pair_findings(pairs: DataFrame, memory: DataFrame, config: JobConfig, limit: int = MATCH_LIMIT) -> DataFrame:
    """The same straight from pairs: phrases are matched and tried on equal pairs once (H4)."""
    rows = keyed(pairs.select(*SEGMENT, *TEXTS))
    distinct, matches = _met(rows, memory, config, limit)
    tried = distinct.select(KEY, *TEXTS).join(matches, KEY)
    found = tried.select(KEY, phrase_finding_array(F.col("matches"), *map(F.col, TEXTS)).alias("found"))
    found = materialize(found).where(F.size("found") > 0)
    return _exploded(back_to_rows(rows.select(*SEGMENT, KEY), found, distinct, "inner"), F.col("found"))


def add_phrase_findings(reviewed: DataFrame) -> DataFrame:
    """Append phrase findings to ``findings`` and merge the verdict (H4, H5)."""
    extra = phrase_finding_array(F.col("matches"), F.col("source_text"), F.col("translated_text"))
    joined = reviewed.withColumn("__extra", extra)
    merged = F.concat("findings", "__extra")
    judged = F.when(F.size("__extra") > 0, merge_verdict(merged, F.col("verdict"))).otherwise(F.col("verdict"))
    return joined.withColumn("verdict", judged).withColumn("findings", merged).drop("__extra")


def phrases_from_decisions(
    decisions: DataFrame, segments: DataFrame, refinements: DataFrame, config: JobConfig, now: Column
) -> DataFrame:
    """Phrases to store from decisions (H8): not keep_source, and all three texts given."""
    keys = ["job_id", "segment_id"]
    rows = (
        decisions.where(F.col("action") != "keep_source")
        .join(refinements.select(*keys, "replace_text", "preferred_text"), keys)
        .join(segments.select(*keys, "source_text"), keys)
        .withColumn("approved_text", strip_ws(F.coalesce("text", F.lit(""))))
        .withColumn("replace_text", strip_ws(F.col("replace_text")))
        .withColumn("preferred_text", strip_ws(F.col("preferred_text")))
    )
    given = (F.col("approved_text") != "") & (F.col("replace_text") != "") & (F.col("preferred_text") != "")
    return phrase_rows(rows.where(given).withColumns({
        "source_language": F.lit(config.source_language),
        "target_language": F.lit(config.target_language),
        "updated_at": now,
    }))


def phrase_rewrite(
    requests: DataFrame, terms: Sequence[Term], config: JobConfig
) -> DataFrame:
    """Rewrite ``translation`` with the operator's phrase and re-validate it (H9).

    ``requests(job_id, segment_id, source_text, translation, replace_text, preferred_text)`` gain
    ``issues`` and ``memory_saved`` (no critical issue and a storable phrase).
    """
    cur = F.col("translation")
    old = F.coalesce("replace_text", F.lit(""))
    text = F.when(old != "", replace_first(cur["translated_text"], old, F.col("preferred_text"))).otherwise(
        cur["translated_text"]
    )
    notes = F.array_append(
        cur["translator_notes"], F.concat(F.lit("Operator local phrase refinement: "), F.col("preferred_text"))
    )
    done = let(
        apply_locale(text, notes, config.target_language),
        lambda d: translation(
            d["translated_text"], d["translator_notes"], F.lit("medium"), cur["uncertain_terms"],
            cur["source_terms_retained"], cur["token_usage"],
        ),
    )
    out = requests.withColumn("translation", done)
    issues = pair_issues(F.col("source_text"), F.col("translation.translated_text"), terms, config.target_language)
    critical = F.exists("issues", lambda i: i["severity"] == "critical")
    new, gone = normalize_phrase(F.col("preferred_text")), normalize_phrase(F.col("replace_text"))
    storable = (new != "") & (gone != "") & (new != gone)
    return out.withColumn("issues", issues).withColumn("memory_saved", ~critical & storable)


def suggest_refinement(
    translations: DataFrame, issues: DataFrame, matches: DataFrame | None = None, text_chars: int = 1000, phrase_chars: int = 600,
) -> DataFrame:
    """Defaults of the refinement form.

    ``issues(job_id, segment_id, pos, proposed_translation, translation_evidence)`` are read in
    ``pos`` order: the first proposal that differs from the current text wins, else the
    first evidence unrelated to it. With ``matches`` (best phrase per segment) the memory
    takes precedence. Texts longer than ``text_chars`` and phrases longer than ``phrase_chars``
    are none, as in a form.
    """
    keys = ["job_id", "segment_id"]
    current = translations.select(*keys, "translated_text").withColumn(
        "current_low", F.lower(clean_phrase(F.col("translated_text"), text_chars))
    )
    # A segment may have any number of issues, but only one current text.
    # One join for both: segments without issues come out of it too, and copies of a current text that salting makes fall into one group.
    rows = skew_join(issues, current, keys, "right", spread_by=["pos"]).withColumns({
        "proposal": clean_phrase(F.col("proposed_translation"), phrase_chars),
        "evidence": clean_phrase(F.col("translation_evidence"), phrase_chars),
    })
    low = F.lower("evidence")
    proposal_ok = (F.col("proposal") != "") & (F.lower("proposal") != F.col("current_low"))
    # contains() also rules out equality, and an empty current text is contained in anything.
    evidence_ok = (F.col("evidence") != "") & ~F.contains(F.col("current_low"), low) & ~F.contains(low, F.col("current_low"))
    best = rows.groupBy(*keys).agg(
        F.min_by(F.when(proposal_ok, F.col("proposal")), F.when(proposal_ok, F.col("pos"))).alias("p"),
        F.min_by(F.when(evidence_ok, F.col("evidence")), F.when(evidence_ok, F.col("pos"))).alias("e"),
        F.first("translated_text").alias("translated_text"),
    )
    suggested = best.withColumns({
        "replace_text": clean_phrase(F.col("translated_text"), phrase_chars),
        "preferred_text": F.coalesce("p", "e", F.lit("")),
    })
    if matches is not None:
        best_match = matches.select(*keys, F.get("matches", F.lit(0)).alias("m"))
        suggested = suggested.join(best_match, keys, "left").withColumns({
            "replace_text": F.when(F.col("m.reason") == "target_phrase", F.col("m.replace_text")).otherwise(F.col("replace_text")),
            "preferred_text": F.coalesce(F.col("m.preferred_text"), F.col("preferred_text")),
        })
    return suggested.select(*keys, "replace_text", "preferred_text")


def legacy_evidence(issues: DataFrame, limit: int = 120) -> DataFrame:
    """First short evidence (translation_evidence, else translated_value) per segment."""
    text = F.coalesce(F.when(F.col("translation_evidence") != "", F.col("translation_evidence")), F.col("translated_value"))
    clean = clean_phrase(text, limit)
    return issues.withColumn("__t", clean).where(F.col("__t") != "").groupBy("job_id", "segment_id").agg(
        F.min_by("__t", "pos").alias("replace_text")
    )
