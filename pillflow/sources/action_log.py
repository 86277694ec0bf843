"""The action log: CSV without header, quotes doubled."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pillflow.functions.scalars import customer_or_unknown, parse_moment
from pillflow.schemas import ACTION_LOG

# Blanks belong to the text. A field without anything is an empty text, as it is to other readers of the file.
_FORMAT = {"quote": '"', "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _texts(log: DataFrame) -> DataFrame:
    return log.withColumns({c: F.coalesce(c, F.lit("")) for c in ("kundennummer", "aktion")})


def read_log(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All entries as text; no file, or an empty one, gives no rows.

    Folders below the log's, such as those of micro-batches, are read as well.
    ``multi_line`` is for files whose texts hold line breaks; such files cannot be split among tasks.
    """
    try:
        return _texts(spark.read.schema(ACTION_LOG).options(multiLine=multi_line, recursiveFileLookup=True, **_FORMAT).csv(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ACTION_LOG)
        raise


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of files."""
    return _texts(spark.readStream.schema(ACTION_LOG).options(recursiveFileLookup=True, **_FORMAT).csv(path))


def with_moments(log: DataFrame) -> DataFrame:
    """Entries with a real time in ``ts``; those without are dropped."""
    return log.withColumn("ts", parse_moment(F.col("zeitstempel"))).where(F.col("ts").isNotNull())


def append_log(rows: DataFrame, path: str) -> None:
    """Add entries to the log; line breaks in a text become blanks so that an entry stays one line."""
    write_log(rows, path, "append")


def write_log(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Entries as a folder of their own; one below the folder of a log belongs to that log (see ``read_log``)."""
    rows.select(
        "zeitstempel", customer_or_unknown(F.col("kundennummer")).alias("kundennummer"),
        F.regexp_replace("aktion", r"[\r\n]+", " ").alias("aktion"),
    ).write.mode(mode).options(**_FORMAT).csv(path)
