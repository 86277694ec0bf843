"""Figures that are carried on with a stream.

The state of such a figure is one row, whatever the log holds, so no watermark is needed to bound it and entries that
come late count like others. Each micro-batch publishes the figure in a folder of its own version; one that is handed
over again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pillflow.plans.log_views import failure_span, mean_time_of
from pillflow.sources.action_log import with_moments
from pillflow.sources.folders import newest_published, numbered, remove

_SPAN = "n long, first timestamp_ntz, last timestamp_ntz"
#: Figures that stay beside the newest, for readers that began with them.
KEPT = 10


def follow_failures(log: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Carry on number, first and last time of critical failures over a stream of log entries."""
    def put(span: DataFrame, batch_id: int) -> None:
        span.coalesce(1).write.mode("overwrite").json(f"{target}/version={batch_id}")
        for version in numbered(span.sparkSession, target, "version"):
            if version < batch_id - KEPT:
                remove(span.sparkSession, f"{target}/version={version}")

    return (
        failure_span(with_moments(log)).writeStream.outputMode("complete").foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def running_mean_time(spark: SparkSession, target: str) -> DataFrame:
    """Mean hours between critical failures, as of the newest micro-batch; no failures before the first."""
    version = newest_published(spark, target)
    if version is None:
        span = spark.createDataFrame([(0, None, None)], _SPAN)
    else:
        span = spark.read.schema(_SPAN).json(f"{target}/version={version}").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return mean_time_of(span)
