"""Session settings and the shared folder for reliable checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pillflow", **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: that of ``spark.checkpoint.dir``, or one below the warehouse if it is unset."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/pillflow-checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder: for what several results are built on.

    Its plan is cut off, and a lost executor does not take it away.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a written table in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
