"""Filling carts and checking them out."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, moment
from pillflow.operators import lookups as L
from pillflow.operators.ranking import rank_rows
from pillflow.schemas import (BAD_BARCODE, DISPENSER, DUPLICATE, EMPTY_BARCODE, EMPTY_CART, EXPIRED, LINE_UNAVAILABLE,
                              NO_CUSTOMER, NOT_IN_DISPENSER, OK, OPEN)
from pillflow.session import keep

log = logging.getLogger(__name__)

FIRST_GROUP = 100000  # order groups are six-digit numbers from here on


@dataclass(frozen=True)
class CartScans:
    """Judge what is scanned into carts: in the dispenser, not expired, not yet in the same cart.

    Whether goods may be had depends on the barcode alone, so the first scan of good goods in a cart is in and
    the later ones are duplicates, while goods that may not be had get the same answer every time. Goods
    without an expiry date count as expired.
    """

    stock: DataFrame
    scans: DataFrame
    as_of: AsOf

    @cached_property
    def outcomes(self) -> DataFrame:
        barcode = F.col("barcode")
        usable = P.valid_barcode(barcode)
        firsts = self.scans.where(usable).groupBy("cart_id", "barcode").agg(F.min("line_no").alias("first_line"))
        held = self.stock.where(F.col("ort") == DISPENSER).select(
            "barcode", "name", "verfallsdatum",
            F.coalesce(P.expired(F.col("verfallsdatum"), self.as_of), F.lit(True)).alias("spoiled"))
        # Goods that are not in the dispenser get one answer, wherever they are scanned.
        facts = firsts.join(held, "barcode")
        own = self.scans.withColumn("_scan", F.concat_ws(":", "cart_id", "line_no"))
        judged = L.with_facts(own, facts, ["cart_id", "barcode"], usable, unique="_scan")
        code = (
            F.when(~P.filled(barcode), EMPTY_BARCODE)
            .when(~usable, BAD_BARCODE)
            .when((F.col("spoiled") == F.lit(False)) & (F.col("line_no") > F.col("first_line")), DUPLICATE)
            .when(F.col("spoiled").isNull(), NOT_IN_DISPENSER)
            .when(F.col("spoiled"), EXPIRED)
            .otherwise(OK)
        )
        return judged.select("cart_id", "line_no", "barcode", code.alias("code"), F.col("name").alias("detail"),
                             "verfallsdatum")

    @cached_property
    def cart_lines(self) -> DataFrame:
        """What is in the carts afterwards."""
        return self.outcomes.where(F.col("code") == OK).select(
            "cart_id", "line_no", "barcode", F.col("detail").alias("name"), "verfallsdatum")


def _fates(undecided: DataFrame) -> DataFrame:
    """Each cart with the cart at the end of its links, whether that one is settled, and the parity of the way there."""
    lowest = undecided.groupBy("barcode").agg(F.min("cart_id").alias("first"))
    placed = L.hot_join(undecided, lowest, ["barcode"], "inner")
    second = placed.where("cart_id > first").groupBy("barcode").agg(F.min("cart_id").alias("second"))
    placed = L.hot_join(placed, second, ["barcode"])
    behind = F.col("cart_id") > F.col("first")
    carts = placed.groupBy("cart_id").agg(
        F.count_if(behind).alias("behind"), F.count_if(F.col("cart_id") == F.col("second")).alias("next"),
        F.min(F.when(behind, F.col("first"))).alias("rival"))
    linked = (F.col("behind") == 1) & (F.col("next") == 1)
    links = keep(carts.select(
        "cart_id", F.when(linked, F.col("rival")).otherwise(F.col("cart_id")).alias("end"),
        linked.cast("int").alias("parity"), (F.col("behind") == 0).alias("settled")))
    while True:
        ends = links.select(F.col("cart_id").alias("end"), F.col("end").alias("further"),
                            F.col("parity").alias("more"), F.col("settled").alias("there"))
        links = keep(L.hot_join(links, ends, ["end"], "inner").select(
            "cart_id", F.col("further").alias("end"), F.col("parity").bitwiseXOR(F.col("more")).alias("parity"),
            F.col("there").alias("settled"), (F.col("further") != F.col("end")).alias("moved")))
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


@dataclass(frozen=True)
class Checkout:
    """Turn carts into orders, all or nothing per cart, earlier carts first.

    A cart that cannot have all its goods takes none of them, so whether it gets them depends on the carts
    before it, and theirs on the carts before them. Carts without customer or lines, or with a line that is not
    in the dispenser, never take anything. The others are settled in rounds: a cart that is the lowest for
    every one of its barcodes gets them, the carts that share a barcode with it do not, and both leave. The
    lowest cart of all is settled in every round, so the rounds end; following links (``_fates``) keeps them few.

    New orders are numbered on from ``last_order`` and ``last_group`` where these are given, else from the highest
    numbers in ``orders_before``.
    """

    stock_before: DataFrame
    orders_before: DataFrame | None
    carts: DataFrame
    cart_lines: DataFrame
    as_of: AsOf
    last_order: int | None = None
    last_group: int | None = None

    @cached_property
    def _held(self) -> DataFrame:
        return self.stock_before.where(F.col("ort") == DISPENSER).select("barcode", "name", F.lit(True).alias("held"))

    @cached_property
    def _goods(self) -> DataFrame:
        """One row per cart and barcode, summed up first so that neither a large cart nor a hot barcode is gathered."""
        scanned = F.min("name") if "name" in self.cart_lines.columns else F.lit(None).cast("string")
        lines = self.cart_lines.groupBy("cart_id", "barcode").agg(
            F.count("*").alias("times"), F.min("line_no").alias("line_no"), scanned.alias("scanned"))
        # A cart may name goods that are no longer in the dispenser.
        return keep(L.hot_join(lines, self._held, ["barcode"]).withColumn("name", F.coalesce("scanned", "name")).drop("scanned"))

    @cached_property
    def _carts(self) -> DataFrame:
        """Carts with their number of lines and whether they may take anything at all."""
        facts = self._goods.groupBy("cart_id").agg(
            F.count("*").alias("n"),
            F.max((F.col("times") > 1) | F.col("held").isNull()).alias("hopeless"))
        return self.carts.join(facts, "cart_id", "left").withColumn("has_customer", P.filled(F.col("kundennummer")))

    @cached_property
    def _eligible_lines(self) -> DataFrame:
        eligible = self._carts.where("has_customer and not hopeless").select("cart_id")
        return keep(L.hot_join(self._goods.select("cart_id", "barcode"), eligible, ["cart_id"], "inner"))

    @cached_property
    def rounds(self) -> list[DataFrame]:
        """The eligible carts that do not get their goods, by round: ``cart_id``."""
        wanted = self._eligible_lines.groupBy("barcode").agg(F.count("*").alias("n")).where("n > 1").select("barcode")
        undecided = keep(L.hot_join(self._eligible_lines, wanted, ["barcode"], "left_semi"))
        lost = []
        while not undecided.isEmpty():
            fates = _fates(undecided)
            won = fates.where("settled and parity = 0").select("cart_id")
            taken = L.hot_join(undecided, won, ["cart_id"], "left_semi").select("barcode")
            touched = L.hot_join(undecided, taken, ["barcode"], "left_semi").select("cart_id").distinct()
            losers = keep(touched.join(won, "cart_id", "left_anti"))
            done = won.unionByName(losers)
            undecided = keep(L.hot_join(undecided, done, ["cart_id"], "left_anti"))
            lost.append(losers)
            log.info("checkout round %d done", len(lost))
        return lost

    @cached_property
    def owners(self) -> DataFrame:
        """Which cart gets which barcode."""
        if not self.rounds:
            return self._eligible_lines
        return L.hot_join(self._eligible_lines, reduce(DataFrame.unionByName, self.rounds), ["cart_id"], "left_anti")

    @cached_property
    def groups(self) -> DataFrame:
        """Accepted carts with their order group, numbered on from the highest there is."""
        highest = self.orders_before.agg(F.max("bestellgruppe_id")).first()[0] if self.last_group is None else self.last_group
        base = max(highest or 0, FIRST_GROUP - 1)
        accepted = self.owners.select("cart_id").distinct()
        return rank_rows(accepted, "cart_id").select("cart_id", (F.col("rang") + base).alias("bestellgruppe_id"))

    @cached_property
    def _first_gap(self) -> DataFrame:
        """Per cart the barcode, and the name if known, of the first line that is not there when its turn comes."""
        goods = L.hot_join(self._goods, self.owners.select("barcode", F.col("cart_id").alias("owner")), ["barcode"])
        gap = F.col("held").isNull() | (F.col("owner") < F.col("cart_id"))
        place = F.struct((~F.coalesce(gap, F.lit(False))).alias("only_twice"), "line_no", "barcode", "name")
        missing = F.coalesce(gap, F.lit(False)) | (F.col("times") > 1)
        return goods.where(missing).groupBy("cart_id").agg(F.min(place).alias("gap")).select(
            "cart_id", F.col("gap.barcode").alias("gap"), F.col("gap.name").alias("name"))

    @cached_property
    def outcomes(self) -> DataFrame:
        judged = self._carts.join(self.groups, "cart_id", "left").join(self._first_gap, "cart_id", "left")
        accepted = F.col("bestellgruppe_id").isNotNull()
        code = (
            F.when(~F.col("has_customer"), NO_CUSTOMER)
            .when(F.col("n").isNull(), EMPTY_CART)
            .when(accepted, OK)
            .otherwise(LINE_UNAVAILABLE)
        )
        detail = F.when(code == OK, F.col("bestellgruppe_id").cast("string")).when(code == LINE_UNAVAILABLE, F.col("gap"))
        return judged.select("cart_id", "kundennummer", code.alias("code"), detail.alias("detail"),
                             F.when(code == LINE_UNAVAILABLE, F.col("name")).alias("name"))

    @cached_property
    def new_orders(self) -> DataFrame:
        """One order line per item, in the order of carts and lines."""
        highest = self.orders_before.agg(F.max("id")).first()[0] if self.last_order is None else self.last_order
        sold = self.owners.select("cart_id", "barcode").join(
            self.cart_lines.select("cart_id", "line_no", "barcode"), ["cart_id", "barcode"])
        ranked = rank_rows(sold.select("cart_id", "line_no", "barcode"), "cart_id", "line_no")
        customers = self.groups.join(self.carts.select("cart_id", "kundennummer"), "cart_id")
        named = L.hot_join(ranked, customers, ["cart_id"], "inner").join(self._held.select("barcode", "name"), "barcode")
        return named.select(
            (F.col("rang") + (highest or 0)).alias("id"), "bestellgruppe_id", "kundennummer", "barcode", "name",
            moment(self.as_of).alias("bestelldatum"), F.lit(OPEN).alias("status"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.orders_before.unionByName(self.new_orders)

    @cached_property
    def stock(self) -> DataFrame:
        return self.stock_before.join(self.owners.select("barcode"), "barcode", "left_anti")
