"""Registration of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Tables with timestamps in them are left out of nothing; these are all that the driver has.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir), and SQL with the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return add


def sql_query(key: str, spark_sql: str, oracle: str | None = None) -> None:
    """Registers a query in Spark SQL, its tables in braces; without `oracle` the text serves DuckDB too."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {n for n in re.findall(r"\{(\w+)\}", spark_sql) if n in TABLES}
        return spark.sql(spark_sql, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[key] = run
    ORACLES[key] = oracle if oracle is not None else re.sub(r"\{(\w+)\}", r"\1", spark_sql)
