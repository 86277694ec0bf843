"""Stored tables as parquet with a fixed schema."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from pillflow.schemas import DISPENSER, TABLES, with_defaults


# Tables that may be stored in buckets. Each key occurs once, so the buckets are of one size; a bucket is read by
# one task, which is why tables with keys that may be hot are not here.
BUCKET_KEYS = {"stock": "barcode", "warnings": "barcode"}

#: Options of written tables.
COMPACT = {"compression": "zstd"}


def read_table(spark: SparkSession, table: str, path: str, buckets: int = 0) -> DataFrame:
    """Scan of ``stock``, ``warnings``, ``orders`` or ``users``; buckets as they were written."""
    schema = TABLES[table]
    if not (buckets and table in BUCKET_KEYS):
        return spark.read.schema(schema).parquet(path)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    name = f"pillflow_{table}_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    key = BUCKET_KEYS[table]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def stored_form(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a table. Defaults are filled in here, so that reading can filter in the scan."""
    columns = [f.name for f in TABLES[table].fields]
    return with_defaults(df.select(*columns).to(TABLES[table]), table)


def write_table(df: DataFrame, table: str, path: str, buckets: int = 0) -> None:
    """Write a table to a new folder. In buckets, it need not be shuffled when requests are joined to it."""
    rows = stored_form(df, table)
    if not (buckets and table in BUCKET_KEYS):
        rows.write.options(**COMPACT).mode("errorifexists").parquet(path)
        return
    key, name = BUCKET_KEYS[table], f"pillflow_new_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.options(path=path, **COMPACT).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the entry in the catalog only; the files stay


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def dispenser_stock(stock: DataFrame) -> DataFrame:
    """Dispenser stock is a view of the stock."""
    return stock.where(stock.ort == DISPENSER).select("barcode", "name", "menge", "verfallsdatum", "ort")
