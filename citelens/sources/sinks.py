"""Writers: tables, extracts, raw caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Replace a parquet table and return it as it reads."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace_view(df: DataFrame, name: str) -> int:
    """Replace a SQL view; returns its number of rows."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name).count()


def append_rows(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't hold yet: a run that is repeated adds nothing."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)


def metrics_json(**tables: DataFrame) -> str:
    """Aggregated tables (few rows each) as one JSON document."""
    return json.dumps({k: [r.asDict(recursive=True) for r in t.collect()] for k, t in tables.items()}, indent=2, sort_keys=True, default=str)
