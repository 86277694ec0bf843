"""Order lines joined to one row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import order_label
from pillflow.operators.ranking import rank_rows
from pillflow.schemas import OPEN, STATUSES


def joined_names(lines: DataFrame, keys: list[str], lowest: dict[str, str] | None = None,
                 by: tuple[str, ...] = ("barcode", "id")) -> DataFrame:
    """``namen``: the names of each group of order lines, joined in the order of ``by``; NULL names are left out.

    ``lowest`` maps new columns to the columns whose lowest value they take. Lines are range partitioned by group
    and order, so that a large group is cut into slices among tasks; the names of a slice are joined first, and then
    the few texts of a group.
    """
    lowest = lowest or {}
    joined = "listagg({what}, ', ') WITHIN GROUP (ORDER BY {order})"
    sliced = lines.repartitionByRange(*keys, *by).withColumn("_slice", F.spark_partition_id())
    pieces = sliced.groupBy(*keys, "_slice").agg(
        F.expr(joined.format(what="name", order=", ".join(by))).alias("_piece"),
        *[F.min(c).alias(new) for new, c in lowest.items()])
    return pieces.groupBy(*keys).agg(
        F.expr(joined.format(what="_piece", order="_slice")).alias("namen"), *[F.min(new).alias(new) for new in lowest])


_ONCE = {"datum": "bestelldatum", "stand": "status"}


def order_overview(orders: DataFrame, group_part: str | None = None, customer_part: str | None = None,
                   status: tuple[str, ...] = STATUSES) -> DataFrame:
    """All orders for the administrator, newest first."""
    lines = orders.where(P.status_in(F.col("status"), status) & P.digits_contain(F.col("bestellgruppe_id"), group_part)
                         & P.digits_contain(F.col("kundennummer"), customer_part))
    grouped = joined_names(lines, ["bestellgruppe_id", "kundennummer"], _ONCE)
    return grouped.select(
        F.col("bestellgruppe_id").alias("Bestell-ID"), F.col("kundennummer").alias("Kundennummer"),
        F.col("namen").alias("Medikamente"), F.col("datum").alias("Bestelldatum"),
        F.col("stand").alias("Status")).orderBy(F.desc("Bestelldatum"), "Bestell-ID", "Kundennummer")


def customer_orders(orders: DataFrame, customer: str, status: str = OPEN) -> DataFrame:
    """Orders of one customer with one status, newest first."""
    lines = orders.where(P.order_of(F.col("kundennummer"), F.col("status"), customer, status))
    grouped = joined_names(lines, ["bestellgruppe_id"], _ONCE)
    return grouped.select(
        F.col("bestellgruppe_id").alias("Bestell-ID"), F.col("namen").alias("Medikamente"),
        F.col("datum").alias("Bestelldatum"), F.col("stand").alias("Status")).orderBy(F.desc("Bestelldatum"), "Bestell-ID")


def order_labels(orders: DataFrame, customer: str) -> DataFrame:
    """Selection texts of a customer's open orders, from their open lines."""
    lines = orders.where(P.order_of(F.col("kundennummer"), F.col("status"), customer, OPEN))
    grouped = joined_names(lines, ["bestellgruppe_id"])
    return grouped.select(F.col("bestellgruppe_id").alias("Bestell-ID"),
                          order_label(F.col("bestellgruppe_id"), F.col("namen")).alias("Auswahl"))


def newest_orders(orders: DataFrame) -> DataFrame:
    """Order lines, newest first, with their place in that order, 1, 2, 3, ..., in ``rang``."""
    return rank_rows(orders, F.desc("bestelldatum"), "bestellgruppe_id", "id")
