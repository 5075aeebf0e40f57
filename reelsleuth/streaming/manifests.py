"""An extension: manifests as they arrive. What is rebuilt here reads them once; the transformations are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsleuth.sources.manifests import JOB, readable


def watch_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of readable manifests, one row for each job.json that appears below `path`/JOB."""
    raw = spark.readStream.schema(JOB).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "job.json").json(path)
    return readable(raw)


def stage_counts(jobs: DataFrame) -> DataFrame:
    """(stage, jobs): how many manifests have been seen at each stage."""
    return jobs.groupBy("stage").agg(F.count(F.lit(1)).alias("jobs"))
