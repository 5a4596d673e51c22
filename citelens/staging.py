"""Tables written between the stages of an operator.

A staged table lies in the folder that all executors share (``spark.checkpoint.dir``), so that a lost executor
costs no more than the tasks it was running, and the lineage before the table is cut.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster; a folder of our own only where none is named, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="citelens-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it; everything later starts from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/citelens/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def gather(jobs: Sequence[Callable[[], DataFrame]], label: str, threads: int = 8) -> DataFrame:
    """The union of what independent jobs make, all of one schema; jobs are submitted together and written each to its own folder."""

    def one(job: Callable[[], DataFrame]) -> DataFrame:
        return stage(job(), label)

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, jobs))
    paths = [x for part in parts for x in part.inputFiles()]
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths) if paths else parts[0]


def release_staged() -> None:
    """Delete all staged tables of this process; call it when no result that reads them is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended: then the cluster's own cleaning applies
            pass


atexit.register(release_staged)


def spread(df: DataFrame) -> DataFrame:
    """Input with fewer splits than cores is dealt out over them; larger input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
