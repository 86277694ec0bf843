"""Continuous ingest of the action log into parquet by day.

Micro-batches write folders of their own. Compaction brings the entries of a day together in one folder and publishes,
with one small file, which folder holds each day and up to which micro-batch; what came later lies beside it until
the next compaction. So a day has one folder and those of the latest micro-batches, however many there have been, and
an entry that arrives days late is merged like any other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pillflow.schemas import ACTION_LOG
from pillflow.sources.action_log import with_moments
from pillflow.sources.folders import names, newest_published, numbered, remove

STORED_LOG = T.StructType([*ACTION_LOG.fields, T.StructField("ts", T.TimestampNTZType()), T.StructField("tag", T.DateType())])
_ENTRY = "folder string, upto long"


@dataclass(frozen=True)
class Compacted:
    """``folders`` hold all entries of the micro-batches up to ``upto``, one folder per day."""

    version: int = 0
    folders: tuple[str, ...] = ()
    upto: int = -1


def by_day(log: DataFrame) -> DataFrame:
    """Entries with their time and day."""
    return with_moments(log).withColumn("tag", F.to_date("ts"))


def _write_days(entries: DataFrame, path: str) -> None:
    """Entries of a day are brought together before they are written, so that there are few files; a large day is cut again."""
    entries.hint("rebalance", "tag").write.mode("overwrite").partitionBy("tag").parquet(path)


def ingest_log(log: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of log entries to ``target``: a folder per micro-batch, and in it one per day.

    A micro-batch that is handed over once more after a failure replaces its own folder. A target belongs to one
    checkpoint.
    """
    def put(entries: DataFrame, batch_id: int) -> None:
        _write_days(entries, f"{target}/batches/batch={batch_id}")

    return (
        by_day(log).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def compacted(spark: SparkSession, target: str) -> Compacted:
    """What the last compaction published."""
    version = newest_published(spark, f"{target}/published")
    if version is None:
        return Compacted()
    rows = spark.read.schema(_ENTRY).json(f"{target}/published/version={version}").collect()  # one per day, and one
    return Compacted(version, tuple(r.folder for r in rows if r.folder), rows[0].upto)


def _days(spark: SparkSession, target: str, folders: tuple[str, ...]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], STORED_LOG)
    paths = [f"{target}/days/{f}" for f in folders]
    return spark.read.schema(STORED_LOG).option("basePath", f"{target}/days").parquet(*paths).drop("made")


def _batches(spark: SparkSession, target: str, numbers: list[int]) -> DataFrame:
    paths = [f"{target}/batches/batch={n}" for n in numbers]
    if not paths:
        return spark.createDataFrame([], STORED_LOG)
    return spark.read.schema(STORED_LOG).option("basePath", f"{target}/batches").parquet(*paths).drop("batch")


def _waiting(spark: SparkSession, target: str, after: int) -> list[int]:
    return [n for n in numbered(spark, f"{target}/batches", "batch") if n > after]


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """All entries: the compacted days and the micro-batches since."""
    old = compacted(spark, target)
    recent = _batches(spark, target, _waiting(spark, target, old.upto))
    return _days(spark, target, old.folders).unionByName(recent) if old.folders else recent


def compact_days(spark: SparkSession, target: str, whole: bool = False) -> Compacted:
    """Merge all micro-batches but the last into one folder per day. Days without new entries stay as they are.

    The last one may be handed over again and then replaces its folder; with ``whole``, for a stream that has ended,
    it is merged as well. Old folders stay, for readers that began with them, until ``drop_merged``.
    """
    old = compacted(spark, target)
    waiting = _waiting(spark, target, old.upto)
    merged = waiting if whole else waiting[:-1]
    if not merged:
        return old
    fresh = _batches(spark, target, merged)
    touched = {f"tag={r.tag}" for r in fresh.select("tag").distinct().collect()}  # days, not entries
    again = tuple(f for f in old.folders if f.rsplit("/", 1)[1] in touched)
    made = f"made={uuid.uuid4().hex}"
    _write_days(_days(spark, target, again).unionByName(fresh) if again else fresh, f"{target}/days/{made}")
    folders = [f for f in old.folders if f not in again]
    folders += [f"{made}/{n}" for n in names(spark, f"{target}/days/{made}") if n.startswith("tag=")]
    new = Compacted(old.version + 1, tuple(folders), merged[-1])
    rows = [(None, new.upto), *((f, new.upto) for f in new.folders)]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("overwrite").json(f"{target}/published/version={new.version}")
    return new


def drop_merged(spark: SparkSession, target: str) -> None:
    """Remove what the last compaction has made needless: merged micro-batches, replaced days, older pointers."""
    now = compacted(spark, target)
    for n in numbered(spark, f"{target}/batches", "batch"):
        if n <= now.upto:
            remove(spark, f"{target}/batches/batch={n}")
    for made in names(spark, f"{target}/days"):
        for day in names(spark, f"{target}/days/{made}"):
            if day.startswith("tag=") and f"{made}/{day}" not in now.folders:
                remove(spark, f"{target}/days/{made}/{day}")
    for version in numbered(spark, f"{target}/published", "version"):
        if version < now.version:
            remove(spark, f"{target}/published/version={version}")
