"""Tables of a folder, as the queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelens.schemas import nan_to_null


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with NaN as NULL."""
    return nan_to_null(table(spark, folder, "candidates"))


#: The same in DuckDB, as the table c.
C = (
    "WITH c AS (SELECT * REPLACE (CASE WHEN isnan(readability_score) THEN NULL ELSE readability_score END AS "
    "readability_score) FROM candidates)"
)
