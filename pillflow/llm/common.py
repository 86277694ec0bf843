"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pillflow.session import scratch_path

#: What a Python task is given at once in jobs of many steps, where Spark's 64 MB and each copy of them add up.
BATCH = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def worker_cache(name: str) -> dict:
    """A dictionary for things that are dear to load, which the Python worker keeps until it asks for another one."""
    held = _held()
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def drop_worker_cache() -> None:
    """For steps without a dictionary of their own: what steps before have loaded would lie beside their data.

    What is free now goes back to the system; by themselves neither Arrow nor the C library would return most of it.
    """
    _held().clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)


def _held() -> dict[str, dict]:
    module = sys.modules.setdefault("_pillflow_worker", types.ModuleType("_pillflow_worker"))
    return module.__dict__.setdefault("held", {})


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python tasks in batches of ``BATCH``, by Spark's measure of them, unless the session says otherwise.

    A batch is held several times over, in the JVM, as it is sent and in Python. Results don't depend on its size.
    """
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: its plan is cut, and executors may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_of(column: str) -> Column:
    """crc32 of a column's value as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores more as it takes to differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text_id(documents: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` and further columns, ``doc_id`` as a text: numbers beside a null one would lose digits in pandas."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), *columns)


def with_own_id(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``rows`` with ``doc_id`` brought back from text to the type it has in ``documents``."""
    return rows.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def texts_of(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """Batches in which a missing text is empty."""
    for batch in batches:
        batch[column] = [t if isinstance(t, str) else "" for t in batch[column]]
        yield batch
