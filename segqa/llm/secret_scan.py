"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns and hashed. A value that many owners have was copied from
documentation; one that belongs to few owners and looks random is a live credential. Base
kinds are reported either way; values of the wide kind only where ownership says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segqa.plans.scale import materialize

# The base kinds in their order, with the group that holds the value and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
# Keys by the public prefixes of providers; documentation is full of them, so they are only
# reported where ownership says that they are live.
WIDE = {"provider": (r"(?:sk|pk|rk)[_-][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}", 0, 15)}
KINDS = list(BASE | WIDE)
# From this many distinct owners on, a value is an example that people copy.
EXAMPLE_OWNERS = 3


def _hits(text: Column, kind: str) -> Column:
    """Matches of a kind and the length of the text before each, since the match before."""
    pattern, _, _ = (BASE | WIDE)[kind]
    # Matches are never empty, so there is one gap more than matches.
    pairs = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found")
    )
    found = F.transform(F.filter(pairs, lambda p: p["found"].isNotNull()), lambda p: F.struct(F.lit(kind).alias("kind"), p["gap"].alias("gap"), p["found"].alias("found")))
    return F.when(text.rlike(pattern), found)


def _looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"(.)\1\1\1\1")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, findings)``: every row of ``docs`` under a number, and all candidates found in its whole text.

    rows: row, id, owner. findings: row, kind, start, end (code points, end exclusive), value_hash,
    n_repositories, n_owners, live. Repositories are distinct ids, owners distinct values of the owner
    column; nulls count as one each. Null and empty texts have no findings. Matches of a kind are
    leftmost and do not overlap; those of a value too short are dropped. Repeated rows are
    scanned each for itself, or once for each value of ``row`` if that is given.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing = F.array().cast("array<struct<kind:string,gap:int,found:string>>")
    scanned = materialize(docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(id_col).alias("id"),
        F.col(owner_col).alias("owner"), F.array(*[F.coalesce(_hits(text, k), nothing) for k in KINDS]).alias("hits"),
    ))
    if row is not None:
        scanned = materialize(scanned.dropDuplicates(["row"]))
    each = scanned.where(reduce(lambda a, b: a | b, (F.size(F.col("hits")[i]) > 0 for i in range(len(KINDS)))))
    each = each.select("row", "id", "owner", F.explode("hits").alias("hits")).select("row", "id", "owner", F.posexplode("hits").alias("at", "hit"))
    # Where a match ends is the sum of all gaps and matches so far: of one kind in one text.
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    flat = each.select("row", "id", "owner", "at", "hit.*")
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(so_far)).withColumn("start", F.col("end") - F.length("found"))
    value = reduce(
        lambda rest, k: F.when(F.col("kind") == k, F.regexp_extract("found", (BASE | WIDE)[k][0], (BASE | WIDE)[k][1])).otherwise(rest),
        KINDS, F.lit(None).cast("string"),
    )
    least = reduce(lambda rest, k: F.when(F.col("kind") == k, (BASE | WIDE)[k][2]).otherwise(rest), KINDS, F.lit(0))
    valued = flat.withColumn("value", value).where(F.length("value") >= least)
    found = materialize(valued.select(
        "row", "kind", "start", "end", F.sha2("value", 256).alias("value_hash"), _looks_random(F.col("value")).alias("random"), "id", "owner"
    ))

    # Distinct first, so that a value that many rows have is counted from one row an owner or id.
    def distinct_of(column: str, name: str) -> DataFrame:
        pairs = found.select("value_hash", column).distinct()
        return pairs.groupBy("value_hash").agg(F.count(F.lit(1)).alias(name))

    counts = materialize(distinct_of("id", "n_repositories").join(distinct_of("owner", "n_owners"), "value_hash"))
    # Both sides are shuffled from tables, so the rows of a frequent value can be split.
    known = found.join(counts, "value_hash")
    live = F.col("random") & (F.col("n_owners") < EXAMPLE_OWNERS)
    findings = known.select("row", "kind", "start", "end", "value_hash", "n_repositories", "n_owners", live.alias("live"))
    return scanned.select("row", "id", "owner"), findings


def reported(findings: DataFrame) -> DataFrame:
    """Base findings, and the wide ones that are live and not within a base finding of the same text."""
    base = findings.where(F.col("kind").isin(*BASE))
    wide = findings.where(~F.col("kind").isin(*BASE) & F.col("live"))
    spans = base.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("__base"))
    inside = F.exists("__base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    added = wide.join(spans, "row", "left").where(F.col("__base").isNull() | ~inside).drop("__base")
    return base.unionByName(added)


def spans_by_row(findings: DataFrame, name: str) -> DataFrame:
    """``(row, name)``: the findings of a text as kind:start:end by start, then kind, comma-joined."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    sorted_ = F.sort_array(F.collect_list(F.struct("start", order.alias("k"), "end", "kind")))
    text = F.array_join(F.transform(sorted_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return findings.groupBy("row").agg(text.alias(name))


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live credential replaced by ``mark``; same rows and columns.

    What many owners have in common stays, and so does what does not look random. Overlapping
    findings are one. Null texts stay null.
    """
    # Rows alike in all that the verdict looks at share it.
    key = F.struct(F.col(id_col), F.col(owner_col), F.xxhash64(text_col))
    _, findings = scan(docs, id_col, text_col, owner_col, key)
    live = materialize(reported(findings).where("live").select("row", "start", "end"))
    # Merge what overlaps: a span opens where no earlier one of its text reaches.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opened = live.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = opened.withColumn("n", F.sum("opens").over(so_far)).groupBy("row", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    joined = docs.withColumn("__row", key).join(materialize(spans.withColumnRenamed("row", "__row")), "__row", "left")
    text = F.col(text_col)

    def before_span(span: Column, i: Column) -> Column:
        last = F.when(i == 0, F.lit(0)).otherwise(F.col("__spans")[i - 1]["end"])
        return F.concat(text.substr(last + 1, span["start"] - last), F.lit(mark))

    kept = F.transform("__spans", before_span)
    rest = text.substr(F.element_at("__spans", F.lit(-1))["end"] + 1, F.length(text))
    clean = F.when(F.col("__spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    return joined.withColumn(text_col, clean).select(*docs.columns)
