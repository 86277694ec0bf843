"""Stock lists, article totals, channels and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, channel_name
from pillflow.operators.expiry import refresh_warnings
from pillflow.operators.lookups import channel_numbers, held_channels
from pillflow.operators.ranking import free_numbers
from pillflow.schemas import DISPENSER


def stock_list(stock: DataFrame, barcode: str | None = None, location: str | None = None,
               channel: str | None = None) -> DataFrame:
    """Stock for display, optionally of one place, one channel, or with a barcode part."""
    wanted = (P.barcode_contains(F.col("barcode"), barcode) & P.at_location(F.col("ort"), location)
              & P.in_channel(F.col("kanal"), channel))
    return stock.where(wanted).select(
        F.col("barcode").alias("Barcode"), F.col("name").alias("Name"), F.col("menge").alias("Menge"),
        F.col("verfallsdatum").alias("Verfallsdatum"), F.col("ort").alias("Ort"), F.col("kanal").alias("Kanal"))


def article_totals(stock: DataFrame, article: str | None = None) -> DataFrame:
    """Quantity per article name; goods without a name are a group of their own."""
    return stock.where(P.article_is(F.col("name"), article)).groupBy(F.col("name").alias("Name")).agg(
        F.sum("menge").alias("Menge"))


def article_names(stock: DataFrame) -> DataFrame:
    return stock.select("name").distinct()


def occupied_channels(stock: DataFrame) -> DataFrame:
    return stock.where((F.col("ort") == DISPENSER) & F.col("kanal").isNotNull()).select("kanal").distinct()


def free_channels(stock: DataFrame, needed: int = 1) -> DataFrame:
    """The lowest channels nobody is in."""
    numbers = free_numbers(channel_numbers(held_channels(stock)), needed)
    return numbers.select("rang", channel_name(F.col("nummer")).alias("kanal"))


def channel_fill(stock: DataFrame) -> DataFrame:
    """Stock rows in each occupied channel."""
    held = stock.where((F.col("ort") == DISPENSER) & F.col("kanal").isNotNull())
    return held.groupBy("kanal").agg(F.count("*").alias("anzahl"))


def stock_count(stock: DataFrame) -> DataFrame:
    return stock.agg(F.count("*").alias("anzahl"))


def random_stock_row(stock: DataFrame, seed: int) -> DataFrame:
    """One stock row by chance, the same for the same seed; a top-1, so nothing is sorted as a whole."""
    return stock.orderBy(F.md5(F.concat(F.lit(str(seed)), "barcode")), "barcode").limit(1)


def warning_list(warnings: DataFrame, stock: DataFrame, as_of: AsOf, location: str | None = None) -> DataFrame:
    """Warnings for display, brought up to date first."""
    current = refresh_warnings(warnings, stock, as_of)
    return current.where(P.at_location(F.col("ort"), location)).select(
        F.col("barcode").alias("Barcode"), F.col("name").alias("Name"),
        F.col("verfallsdatum").alias("Verfallsdatum"), F.col("ort").alias("Ort"), F.col("status").alias("Status"))


def warning_count(warnings: DataFrame, stock: DataFrame, as_of: AsOf, location: str | None = None) -> DataFrame:
    """How many warnings there are."""
    current = refresh_warnings(warnings, stock, as_of)
    return current.where(P.at_location(F.col("ort"), location)).agg(F.count("*").alias("anzahl"))


def cart_list(cart_lines: DataFrame) -> DataFrame:
    """Cart contents with capitalised column names."""
    shown = cart_lines.select("cart_id", "barcode", "name", "verfallsdatum")
    return shown.toDF(*[c.capitalize() for c in shown.columns])
