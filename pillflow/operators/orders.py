"""Cancelling orders and setting their status."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, one_year_after
from pillflow.operators import lookups as L
from pillflow.schemas import CANCELLED, CONFLICT, MISSING_ARG, NOT_OPEN, OK, STORE
from pillflow.session import keep

_PAIR = ["bestellgruppe_id", "kundennummer"]


@dataclass(frozen=True)
class Cancellation:
    """Cancel whole orders and put their goods back into the store room, all or nothing per order.

    The first request for an order counts; later ones find nothing open. An order whose goods have meanwhile
    been put anywhere but into the store room cannot be cancelled. Cancelling never changes what is elsewhere,
    so requests for different orders do not depend on each other.
    """

    stock_before: DataFrame
    orders_before: DataFrame
    requests: DataFrame
    as_of: AsOf

    @cached_property
    def _usable(self):
        group = F.col("bestellgruppe_id")
        return P.filled(F.col("kundennummer")) & F.coalesce(group != 0, F.lit(False))

    @cached_property
    def _open_lines(self) -> DataFrame:
        firsts = self.requests.where(self._usable).groupBy(*_PAIR).agg(F.min("seq").alias("first_seq"))
        return keep(L.open_lines_of(firsts, self.orders_before))

    @cached_property
    def _verdicts(self) -> DataFrame:
        """Requested orders with open lines, and whether something stands in the way."""
        elsewhere = self.stock_before.where(~F.col("ort").eqNullSafe(STORE)).select(
            "barcode", F.lit(True).alias("elsewhere"))
        lines = L.hot_join(self._open_lines, elsewhere, ["barcode"])
        clash = F.min(F.when(F.col("elsewhere"), F.struct("id", "barcode", "name")))
        # Outcomes, stock and orders are all built on them.
        return keep(lines.groupBy(*_PAIR, "first_seq").agg(clash.alias("clash"), F.count("*").alias("n_lines")).withColumn(
            "conflict", F.col("clash").isNotNull()))

    @cached_property
    def cancelled(self) -> DataFrame:
        return self._verdicts.where(~F.col("conflict")).select(*_PAIR, "first_seq")

    @cached_property
    def outcomes(self) -> DataFrame:
        judged = L.with_facts(self.requests, self._verdicts, _PAIR, self._usable)
        code = (
            F.when(~self._usable, MISSING_ARG)
            .when(F.col("conflict").isNull(), NOT_OPEN)
            .when(F.col("conflict"), CONFLICT)
            .when(F.col("seq") == F.col("first_seq"), OK)
            .otherwise(NOT_OPEN)
        )
        detail = F.when(code == OK, F.col("n_lines").cast("string")).otherwise(F.col("clash.barcode"))
        return judged.select("seq", *_PAIR, code.alias("code"), F.when(code != NOT_OPEN, detail).alias("detail"),
                             F.when(code == CONFLICT, F.col("clash.name")).alias("name"))

    @cached_property
    def returned_lines(self) -> DataFrame:
        return L.hot_join(self._open_lines, self.cancelled.drop("first_seq"), _PAIR, "left_semi")

    @cached_property
    def stock(self) -> DataFrame:
        """A barcode in the store room gains one per returned line; any other is entered anew."""
        back = self.returned_lines.groupBy("barcode").agg(
            F.count("*").alias("n"), F.min(F.struct("first_seq", "id", "name")).alias("first"))
        old = self.stock_before.withColumn("old", F.lit(True))
        new = F.col("old").isNull()
        return old.join(back, "barcode", "full").select(
            "barcode",
            F.when(new, F.col("first.name")).otherwise(F.col("name")).alias("name"),
            F.when(F.col("n").isNull(), F.col("menge"))
            .otherwise(F.coalesce("menge", F.lit(0)) + F.col("n")).cast("int").alias("menge"),
            F.when(new, one_year_after(self.as_of)).otherwise(F.col("verfallsdatum")).alias("verfallsdatum"),
            F.when(new, STORE).otherwise(F.col("ort")).alias("ort"), "kanal")

    @cached_property
    def orders(self) -> DataFrame:
        """All lines of a cancelled order, whatever their status was."""
        marks = self.cancelled.select(*_PAIR, F.lit(CANCELLED).alias("neu"))
        return L.hot_join(self.orders_before, marks, _PAIR).select(
            "id", *_PAIR, "barcode", "name", "bestelldatum", F.coalesce("neu", "status").alias("status"))


def set_order_status(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Orders after the status requests: the last one per order group counts, with no check."""
    last = requests.groupBy("bestellgruppe_id").agg(F.max(F.struct("seq", "status")).alias("last"))
    marks = last.select("bestellgruppe_id", F.lit(True).alias("set"), F.col("last.status").alias("neu"))
    return L.hot_join(orders, marks, ["bestellgruppe_id"]).select(
        "id", "bestellgruppe_id", "kundennummer", "barcode", "name", "bestelldatum",
        F.when(F.col("set"), F.col("neu")).otherwise(F.col("status")).alias("status"))
