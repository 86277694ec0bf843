"""Moving goods into the dispenser and back."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, channel_name, channel_number
from pillflow.operators import lookups as L
from pillflow.operators.ranking import free_numbers, number_slices, sorted_slices, take_lowest
from pillflow.schemas import (BAD_BARCODE, DISPENSER, EMPTY_BARCODE, EXPIRED, NOT_FOUND, NOT_IN_DISPENSER, OK, STORE)
from pillflow.session import keep


_BEFORE_ALL = -(1 << 63)


def _barcode_code():
    barcode = F.col("barcode")
    return F.when(~P.filled(barcode), EMPTY_BARCODE).when(~P.valid_barcode(barcode), BAD_BARCODE)


@dataclass(frozen=True)
class Fill:
    """Move goods into the dispenser.

    Goods join the channel that already holds their name. Names without a channel take free numbers, lowest
    first, in the order in which they first succeed. If a name has several channels its goods go to the lowest, and one
    that is left empty is free for the requests that follow. Goods without a name are never matched to a channel: each
    barcode takes one of its own. Moving the same goods twice succeeds twice.

    ``stock_before`` may be a part of the stock that holds all barcodes asked for; ``dispenser`` is then the stock in
    which channels are in use.
    """

    stock_before: DataFrame
    requests: DataFrame
    as_of: AsOf
    dispenser: DataFrame | None = None

    @cached_property
    def _asked(self) -> DataFrame:
        """Each barcode asked for that is in stock, with whether it is still good; without a date it is not."""
        asked = L.first_per_barcode(self.requests, P.valid_barcode(F.col("barcode")))
        rows = self.stock_before.select("barcode", "name", "verfallsdatum")
        spoiled = F.coalesce(P.expired(F.col("verfallsdatum"), self.as_of), F.lit(True))
        return keep(asked.join(rows, "barcode").select("barcode", "first_seq", "name", spoiled.alias("spoiled")))

    @cached_property
    def _held(self) -> DataFrame:
        """Channels in use, one row per channel and name: a small part of the stock that is looked at thrice."""
        return keep(L.held_channels(self.stock_before if self.dispenser is None else self.dispenser))

    @cached_property
    def channels(self) -> DataFrame:
        """Channel per name, or per barcode for goods without a name: ``einheit`` -> ``kanal``."""
        nameless = F.lit(None).cast("string").alias("barcode")
        known = L.lowest_channels(self._held).select(F.struct("name", nameless).alias("einheit"), "kanal")
        return known.unionByName(self._new_channels)

    @cached_property
    def _new_channels(self) -> DataFrame:
        moved = self._asked.where(~F.col("spoiled"))
        known = L.lowest_channels(self._held).select(F.col("name").alias("known"))
        wanted = (
            moved.groupBy(_unit().alias("einheit")).agg(F.min("first_seq").alias("first_seq"))
            .join(known, F.col("einheit.name") == F.col("known"), "left_anti")
        )
        in_order = sorted_slices(wanted, "first_seq")
        numbers = free_numbers(L.channel_numbers(self._held), in_order.count())
        if self._released.isEmpty():
            named = number_slices(in_order).join(numbers, "rang")
        else:
            free = numbers.select("nummer", F.lit(_BEFORE_ALL).alias("since")).unionByName(self._released)
            taken = take_lowest(in_order.select(F.col("first_seq").alias("at")), free)
            named = in_order.join(taken.withColumnRenamed("at", "first_seq"), "first_seq")
        return named.select("einheit", channel_name(F.col("nummer")).alias("kanal"))

    @cached_property
    def _released(self) -> DataFrame:
        """Channels in use that the batch empties, ``nummer``, with the request that does so, ``since``.

        Goods leave their channel when they are refilled and their name has a lower one, or when they have no name.
        Nothing comes into such a channel before it is free: only the lowest of a name takes goods in.
        """
        inside = self.stock_before if self.dispenser is None else self.dispenser
        inside = inside.where((F.col("ort") == DISPENSER) & (F.col("kanal") != "")).select("barcode", "kanal")
        target = L.lowest_channels(self._held).select("name", F.col("kanal").alias("ziel"))
        moved = L.hot_join(self._asked.where(~F.col("spoiled")), target, ["name"])
        leaving = inside.join(moved.select("barcode", "first_seq", "ziel"), "barcode").where(~F.col("ziel").eqNullSafe(F.col("kanal")))
        leaving = leaving.groupBy("kanal").agg(F.count("*").alias("gone"), F.max("first_seq").alias("since"))
        size = L.hot_join(inside, leaving.select("kanal"), ["kanal"], "left_semi").groupBy("kanal").agg(F.count("*").alias("n"))
        emptied = leaving.join(size, "kanal").where("gone = n").withColumn("nummer", channel_number(F.col("kanal")))
        return keep(emptied.where(F.col("nummer").isNotNull()).groupBy("nummer").agg(F.max("since").alias("since")))

    @cached_property
    def _placed(self) -> DataFrame:
        """Each barcode asked for with the channel it goes to; NULL where it is spoiled."""
        at = self.channels.select(F.col("einheit.name").alias("u_name"), F.col("einheit.barcode").alias("u_barcode"),
                                  F.col("kanal").alias("ziel"))
        unit = _unit()
        same = (unit["name"].eqNullSafe(F.col("u_name"))) & (unit["barcode"].eqNullSafe(F.col("u_barcode")))
        placed = self._asked.join(at, same, "left")
        return placed.select("barcode", "first_seq", "name", "spoiled",
                             F.when(~F.col("spoiled"), F.col("ziel")).alias("ziel"))

    @cached_property
    def outcomes(self) -> DataFrame:
        judged = L.with_facts(self.requests, self._placed, ["barcode"], P.valid_barcode(F.col("barcode")))
        code = (
            _barcode_code()
            .when(F.col("spoiled").isNull(), NOT_FOUND)
            .when(F.col("spoiled"), EXPIRED)
            .otherwise(OK)
        )
        return judged.select("seq", "barcode", code.alias("code"), F.col("ziel").alias("detail"), "name")

    @cached_property
    def stock(self) -> DataFrame:
        moves = self._placed.where(F.col("ziel").isNotNull()).select("barcode", "ziel")
        moved = F.col("ziel").isNotNull()
        return self.stock_before.join(moves, "barcode", "left").select(
            "barcode", "name", "menge", "verfallsdatum",
            F.when(moved, DISPENSER).otherwise(F.col("ort")).alias("ort"),
            F.coalesce("ziel", "kanal").alias("kanal"))


def _unit():
    """What shares a channel: the name, or the single barcode if there is no name."""
    return F.struct(F.col("name"), F.when(F.col("name").isNull(), F.col("barcode")).alias("barcode"))


@dataclass(frozen=True)
class Return:
    """Move goods from the dispenser back to the store room. A channel nobody is left in is free again."""

    stock_before: DataFrame
    requests: DataFrame

    @cached_property
    def _asked(self) -> DataFrame:
        asked = L.first_per_barcode(self.requests, P.valid_barcode(F.col("barcode")))
        held = self.stock_before.where(F.col("ort") == DISPENSER).select(
            "barcode", "kanal", "name", F.lit(True).alias("held"))
        return asked.join(held, "barcode")

    @cached_property
    def outcomes(self) -> DataFrame:
        judged = L.with_facts(self.requests, self._asked, ["barcode"], P.valid_barcode(F.col("barcode")))
        code = _barcode_code().when(F.col("held") & (F.col("seq") == F.col("first_seq")), OK).otherwise(NOT_IN_DISPENSER)
        return judged.select("seq", "barcode", code.alias("code"),
                             F.when(code == OK, F.col("kanal")).alias("detail"), "name")

    @cached_property
    def stock(self) -> DataFrame:
        moves = self._asked.select("barcode", "held")
        back = F.col("held").isNotNull()
        return self.stock_before.join(moves, "barcode", "left").select(
            "barcode", "name", "menge", "verfallsdatum",
            F.when(back, STORE).otherwise(F.col("ort")).alias("ort"),
            F.when(~back, F.col("kanal")).alias("kanal"))
