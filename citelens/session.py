"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def build_session(app: str = "citelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` overrides any setting.

    No master is set unless given, so that ``spark-submit`` decides on a cluster.
    """
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",  # valid JSON may repeat a name
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
