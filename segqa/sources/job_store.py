"""Job table, payload restore, report sink and file fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segqa.functions.rules import FINDING_TYPE, TRANSLATION_TYPE, relocale
from segqa.functions.text import let, normalize_ws, uses_decimal_comma
from segqa.operators.memory import cache_key, scope_hash_of, source_hash
from segqa.operators.reports import normalize_status

JOB_COLUMNS = (
    "job_id string, status string, source_path string, output_path string, payload_json string, updated_at timestamp"
)
_SEGMENT = (
    "struct<segment_id:string,page_number:int,order_index:bigint,block_type:string,source_text:string>"
)
_ISSUE = (
    "struct<segment_id:string,severity:string,issue_type:string,source_value:string,translated_value:string,message:string>"
)
PAYLOAD = (
    "struct<job_id:string,status:string,config:struct<source_language:string,target_language:string,domain:string,"
    "translator_provider:string,translator_model:string>,translation_cache_scope:map<string,string>,"
    f"segments:array<{_SEGMENT}>,translations:map<string,{TRANSLATION_TYPE}>,deterministic_issues:array<{_ISSUE}>,"
    f"review_results:map<string,struct<verdict:string,findings:array<{FINDING_TYPE}>>>,"
    "operator_decisions:map<string,struct<action:string,text:string,note:string>>>"
)


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge job rows (S10): the latest state wins, the source path never changes after insert.

    Map-side maxima keep a job that is saved at every checkpoint to one row per task.
    """
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = F.struct("updated_at", "__new")
    merged = rows.groupBy("job_id").agg(
        F.max_by(F.struct("status", "output_path", "payload_json", "updated_at"), order).alias("l"),
        F.min_by("source_path", F.struct("__new", "updated_at")).alias("source_path"),
    )
    return merged.select("job_id", "l.*", "source_path").select(*old.columns)


def load_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def latest_job(jobs: DataFrame) -> DataFrame:
    """The job saved last."""
    return jobs.orderBy(F.desc("updated_at"), F.desc("job_id")).limit(1)


def latest_per(rows: DataFrame, key: str, order: str = "updated_at") -> DataFrame:
    """Latest row per key of an append-only log, by map-side maxima."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("l")).select(key, "l.*").select(*rows.columns)


def swap_in(df: DataFrame, root: str, version: str) -> str:
    """Write a table as a new version folder; readers move on when they are given its path."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def parse_payloads(jobs: DataFrame) -> DataFrame:
    """Jobs with their payload parsed; unreadable payloads drop out."""
    parsed = jobs.withColumn("p", F.from_json("payload_json", PAYLOAD, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("p").isNotNull() & (F.col("p.segments").isNotNull() | F.col("p.job_id").isNotNull()))


def _formatted(value: Column, target_language: Column) -> Column:
    polish = let(value, lambda v: relocale(v, "Polish"))
    return F.when(F.coalesce(uses_decimal_comma(target_language), F.lit(False)), polish).otherwise(value)


def restore_translations(jobs: DataFrame) -> DataFrame:
    """Translations of stored jobs with locale formatting applied again."""
    rows = parse_payloads(jobs).select(
        "job_id", F.col("p.config.target_language").alias("target"), F.explode("p.translations").alias("segment_id", "raw")
    )
    return rows.select("job_id", "segment_id", _formatted(F.col("raw"), F.col("target")).alias("translation"))


def restore_jobs(jobs: DataFrame) -> DataFrame:
    """Stored jobs with counts and a corrected status."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    counted = parse_payloads(jobs).select(
        "job_id",
        F.col("p.status").alias("status"),
        size("p.segments").alias("segments"),
        size("p.translations").alias("translations"),
        size("p.review_results").alias("reviews"),
    )
    return counted.withColumn("status", normalize_status())


def cache_backfill(jobs: DataFrame) -> DataFrame:
    """Cache rows of every stored translation, each under its own job's scope (M9).

    Without jobs the result is empty; :func:`segqa.operators.memory.cache_upsert` merges it.
    """
    parsed = parse_payloads(jobs).where(F.col("p.config").isNotNull())
    config = F.col("p.config")
    name = lambda c: F.lower(normalize_ws(c))
    own = F.create_map(
        F.lit("schema_version"), F.lit("1"),
        F.lit("source_language"), name(config["source_language"]),
        F.lit("target_language"), name(config["target_language"]),
        F.lit("domain"), normalize_ws(config["domain"]),
        F.lit("translator_provider"), F.coalesce(config["translator_provider"], F.lit("mock")),
        F.lit("translator_model"), F.coalesce(config["translator_model"], F.lit("mock")),
        F.lit("glossary_sha256"), F.lit("missing"),
        F.lit("translator_prompt_sha256"), F.lit("missing"),
    )
    scope = F.coalesce(F.col("p.translation_cache_scope"), own)
    base = parsed.select(
        "job_id", "updated_at", config["source_language"].alias("source_language"),
        config["target_language"].alias("target_language"),
        F.coalesce(config["translator_provider"], F.lit("mock")).alias("translator_provider"),
        F.coalesce(scope["translator_model"], F.lit("")).alias("translator_model"),
        scope_hash_of(scope).alias("scope_hash"), "p",
    )
    segments = base.select(*[c for c in base.columns if c != "p"], F.inline("p.segments"))
    translations = base.select("job_id", F.explode("p.translations").alias("segment_id", "translation"))
    norm = normalize_ws(F.col("source_text"))
    rows = segments.join(translations, ["job_id", "segment_id"]).withColumn("normalized_source", norm).where(
        (F.col("normalized_source") != "") & (normalize_ws(F.col("translation.translated_text")) != "")
    )
    return rows.select(
        cache_key(F.col("normalized_source"), F.col("scope_hash")).alias("cache_key"),
        source_hash(F.col("normalized_source")).alias("source_hash"),
        "source_language", "target_language", "translator_provider", "translator_model", "scope_hash",
        "normalized_source", "translation", F.col("job_id").cast("string").alias("origin_job_id"),
        F.col("segment_id").alias("origin_segment_id"), F.col("updated_at").alias("created_at"), "updated_at",
        F.col("updated_at").alias("last_used_at"), F.lit(0).cast("bigint").alias("hits"),
    )


def write_reports(reports: DataFrame, path: str, folders: int = 256) -> None:
    """Audit reports as JSON lines (S13), spread over a fixed number of folders by job."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(folders))
    reports.withColumn("bucket", bucket).write.mode("errorifexists").partitionBy("bucket").json(path)


def read_reports(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Reports written by :func:`write_reports`, with the columns they were written from."""
    return spark.read.schema(schema).json(path).select(*schema.fieldNames())


def with_fingerprint(rows: DataFrame, fingerprints: DataFrame, key: str) -> DataFrame:
    """Fingerprint per row, "missing" where there is no file."""
    found = fingerprints.select(key, "sha256")
    return rows.join(found, key, "left").withColumn("sha256", F.coalesce("sha256", F.lit("missing")))
