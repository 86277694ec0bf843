"""Stock intake and removal."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, parse_date
from pillflow.operators import lookups as L
from pillflow.schemas import (BAD_BARCODE, BAD_EXPIRY, DISPENSER, IN_DISPENSER, IN_OPEN_ORDER, IN_STOCK,
                              MISSING_FIELD, NOT_FOUND, OK, STORE)


@dataclass(frozen=True)
class Intake:
    """Receive goods.

    All requests are judged against the stock as it is. The first good one per barcode is taken in; whatever
    comes after it and is well formed finds the barcode in stock, a bad expiry date notwithstanding, because
    the stock is looked at before the date.
    """

    stock_before: DataFrame
    orders: DataFrame
    requests: DataFrame
    as_of: AsOf

    @cached_property
    def _checked(self) -> DataFrame:
        complete = P.filled(F.col("barcode"), F.col("name"), F.col("verfallsdatum_raw"))
        well_formed = complete & P.valid_barcode(F.col("barcode"))
        return self.requests.withColumns({
            "complete": complete,
            "well_formed": well_formed,
            "good_date": P.acceptable_expiry(F.col("verfallsdatum_raw"), self.as_of),
        })

    @cached_property
    def outcomes(self) -> DataFrame:
        checked = self._checked
        asked = checked.where("well_formed").groupBy("barcode").agg(
            F.min(F.when(F.col("good_date"), F.col("seq"))).alias("first_seq"))
        facts = (
            asked.join(L.open_order_barcodes(self.orders), "barcode", "left")
            .join(L.stocked_barcodes(self.stock_before), "barcode", "left")
        )
        judged = L.with_facts(checked, facts, ["barcode"], F.col("well_formed"))
        code = (
            F.when(~F.col("complete"), MISSING_FIELD)
            .when(~F.col("well_formed"), BAD_BARCODE)
            .when(F.col("in_open_order"), IN_OPEN_ORDER)
            .when(F.col("in_stock") | (F.col("seq") > F.col("first_seq")), IN_STOCK)
            .when(F.col("seq") == F.col("first_seq"), OK)
            .otherwise(BAD_EXPIRY)
        )
        return judged.select("seq", "barcode", code.alias("code"), F.col("name").alias("detail"))

    @cached_property
    def accepted(self) -> DataFrame:
        """The new stock rows."""
        row = F.struct("seq", "name", parse_date(F.col("verfallsdatum_raw")).alias("verfallsdatum"), "ort")
        firsts = (
            self._checked.where("well_formed and good_date")
            .groupBy("barcode").agg(F.min(row).alias("row"))
            .join(L.open_order_barcodes(self.orders), "barcode", "left_anti")
            .join(L.stocked_barcodes(self.stock_before), "barcode", "left_anti")
        )
        return firsts.select(
            "barcode", F.col("row.name").alias("name"), F.lit(1).cast("int").alias("menge"),
            F.col("row.verfallsdatum").alias("verfallsdatum"),
            F.coalesce("row.ort", F.lit(STORE)).alias("ort"), F.lit(None).cast("string").alias("kanal"))

    @cached_property
    def stock(self) -> DataFrame:
        return self.stock_before.unionByName(self.accepted)


@dataclass(frozen=True)
class Removal:
    """Take goods out of stock for good; what is in the dispenser stays."""

    stock_before: DataFrame
    requests: DataFrame

    @cached_property
    def _asked(self) -> DataFrame:
        return L.first_per_barcode(self.requests, P.valid_barcode(F.col("barcode")))

    @cached_property
    def outcomes(self) -> DataFrame:
        usable = P.valid_barcode(F.col("barcode"))
        places = self.stock_before.select("barcode", "name", "ort")
        # What is not in stock has no facts, so only goods there are go on to the requests.
        judged = L.with_facts(self.requests, self._asked.join(places.withColumn("in_stock", F.lit(True)), "barcode"), ["barcode"], usable)
        code = (
            F.when(~usable, BAD_BARCODE)
            .when(F.col("in_stock").isNull(), NOT_FOUND)
            .when(F.col("ort") == DISPENSER, IN_DISPENSER)
            .when(F.col("seq") == F.col("first_seq"), OK)
            .otherwise(NOT_FOUND)
        )
        return judged.select("seq", "barcode", code.alias("code"), F.col("name").alias("detail"))

    @cached_property
    def stock(self) -> DataFrame:
        asked = self._asked.select("barcode", F.lit(True).alias("asked"))
        kept = F.col("asked").isNull() | F.col("ort").eqNullSafe(DISPENSER)
        return self.stock_before.join(asked, "barcode", "left").where(kept).select(*self.stock_before.columns)
