"""Data-quality and reliability figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.schemas import ADMIN, DISPENSER, OK


def faulty_rate(stock: DataFrame) -> DataFrame:
    """Faulty stock rows per hundred pieces in stock; 0 for an empty stock."""
    bad = P.faulty_stock(F.col("barcode"), F.col("menge"), F.col("verfallsdatum"))
    sums = stock.agg(F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.sum("menge").alias("total"))
    rate = F.when(F.col("total") > 0, F.col("bad").cast("double") / F.col("total") * 100.0).otherwise(0.0)
    return sums.select(F.coalesce("bad", F.lit(0)).alias("fehlerhaft"), F.col("total").alias("menge"),
                       rate.alias("rate"))


def outcome_rates(outcomes: DataFrame) -> DataFrame:
    """Success and error rate, in percent, of each kind of operation in ``vorgang``, from outcomes with ``code``."""
    return rates_of(outcomes.groupBy("vorgang").agg(F.count("*").alias("anzahl"), F.count_if(F.col("code") == OK).alias("ok")))


def rates_of(counted: DataFrame) -> DataFrame:
    """The same from ``anzahl`` and ``ok`` of each ``vorgang``."""
    share = F.col("ok").cast("double") / F.col("anzahl") * 100.0
    return counted.select("vorgang", "anzahl", share.alias("erfolg"), (F.lit(100.0) - share).alias("fehler"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("code").agg(F.count("*").alias("anzahl"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; none, if the key is one."""
    return df.groupBy(*keys).agg(F.count("*").alias("anzahl")).where("anzahl > 1")


def channels_per_name(stock: DataFrame) -> DataFrame:
    """How many dispenser channels hold a medicine name; filling keeps this at one."""
    held = stock.where((F.col("ort") == DISPENSER) & F.col("kanal").isNotNull()).select("name", "kanal").distinct()
    return held.groupBy("name").agg(F.count("*").alias("kanaele"))


def admin_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("role") == ADMIN).alias("administratoren"))
