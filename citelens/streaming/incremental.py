"""Streams: incremental collection with a batch finalise, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citelens.operators.relational import impute_median
from citelens.sources.sinks import append_rows


def collect_responses(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append each new response file of ``folder`` to ``table`` once; stops when all present files are in.

    What fails in one file stays in that file's row (the body is stored as it is); a repeated file adds nothing.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    rows = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("query_id"), F.col("value").alias("body"))
    return (
        rows.writeStream.foreachBatch(lambda df, _: append_rows(df.dropDuplicates(["query_id"]), table, "query_id"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finalise(raw: DataFrame, columns: list[str], zero: list[str], domain: str, label: str) -> DataFrame:
    """The global step over all collected rows: rate of each domain and medians for missing numbers.

    Neither can be kept exact row by row, so it runs as a batch over the whole table.
    """
    rates = raw.groupBy(domain).agg(F.round(F.avg(label), 3).alias("domain_citation_rate"))
    known = raw.drop("domain_citation_rate")
    joined = known.join(rates.withColumnRenamed(domain, "_d"), F.col(domain).eqNullSafe(F.col("_d"))).drop("_d")
    return impute_median(joined, columns, zero)


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", step: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with a stream, rows later than ``late`` are left out and state is bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = F.window("ts", length, step) if step else F.window("ts", length)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def latest(written: DataFrame, key: list[str], batch: str) -> DataFrame:
    """Of each key the row of its last batch, without the batch's number."""
    others = [c for c in written.columns if c not in key and c != batch]
    last = written.groupBy(*key).agg(F.max_by(F.struct(*others), batch).alias("x"))
    return last.select(*key, "x.*")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a pause of ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return timed.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n"
    )
