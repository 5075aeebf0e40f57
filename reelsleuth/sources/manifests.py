"""Job manifests: one JSON document a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, bytes bigint, sha256 string, title string, migrated_to string"
JOB = (
    "id string, created_at bigint, stage string, device string, error string, backend string, adopted_from string, selected_titles array<int>, reclaimed array<string>, "
    "titles array<struct<index: int, duration_secs: bigint, estimated_bytes: bigint, chapters: int, output_name: string>>, "
    "artifacts array<struct<relative_path: string, bytes: bigint, sha256: string, hashed_at: bigint>>, "
    "identification struct<matched_on: string, confidence: string, source: string, identified_at: bigint, superseded: array<string>, files: array<struct<path: string, bytes: bigint, sha256: string, title: string>>>, "
    "_corrupt string"
)
# Stages of a job, in order.
STAGES = ("probed", "ripping", "ripped", "identified", "migrated", "failed")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """All manifests below `path` (…/JOB/job.json), with `_corrupt` set where one can't be read."""
    return spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "job.json").json(path).withColumn("file", F.col("_metadata.file_path"))


def readable(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("_corrupt").isNull() & F.col("id").isNotNull() & F.col("stage").isin(*STAGES))


def unreadable(jobs: DataFrame) -> DataFrame:
    """(file, why) of manifests to warn about."""
    why = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("id").isNull(), "no id").when(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "unknown stage")
    return jobs.select("file", why.alias("why")).where("why IS NOT NULL")


def listing(jobs: DataFrame) -> DataFrame:
    """(id, stage, artifacts, bytes, estimated_bytes), by id: what is there, and what the selected titles were expected to take."""
    selected = F.filter("titles", lambda t: F.array_contains("selected_titles", t["index"]))
    total = lambda items, field: F.coalesce(F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0))), F.lit(0))
    return readable(jobs).select("id", "stage", F.coalesce(F.size("artifacts"), F.lit(0)).alias("artifacts"), total(F.col("artifacts"), "bytes").alias("bytes"), total(selected, "estimated_bytes").alias("estimated_bytes")).orderBy("id")


def artifacts(jobs: DataFrame) -> DataFrame:
    """(id, relative_path, bytes, sha256): one row an artifact."""
    return readable(jobs).select("id", F.explode("artifacts").alias("a")).select("id", "a.relative_path", "a.bytes", "a.sha256")


def mark_filed(jobs: DataFrame, path: str) -> DataFrame:
    """`jobs` with the artifact `path` moved to reclaimed, where it is listed once."""
    has = F.exists("artifacts", lambda a: a["relative_path"] == path)
    return jobs.withColumn("reclaimed", F.when(has, F.array_union(F.coalesce("reclaimed", F.array().cast("array<string>")), F.array(F.lit(path)))).otherwise(F.col("reclaimed"))).withColumn("artifacts", F.filter("artifacts", lambda a: a["relative_path"] != path))


def save_snapshot(jobs: DataFrame, path: str) -> None:
    """Writes all manifests as a new snapshot; a snapshot is there whole or not at all."""
    jobs.drop("_corrupt", "file").write.mode("errorifexists").json(path)
