"""Lookups that a single request makes by hand, as joins over whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pillflow.functions.scalars import channel_number
from pillflow.schemas import DISPENSER, OPEN


def open_order_barcodes(orders: DataFrame) -> DataFrame:
    """Barcodes in open orders, once each, with the flag ``in_open_order``."""
    return orders.where(F.col("status") == OPEN).select("barcode").distinct().withColumn("in_open_order", F.lit(True))


def stocked_barcodes(stock: DataFrame) -> DataFrame:
    """Barcodes in stock, anywhere, with the flag ``in_stock``."""
    return stock.select("barcode", F.lit(True).alias("in_stock"))


def stock_row_of(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """Requests with the columns of their stock row; ``in_stock`` tells whether there is one."""
    return requests.join(stock.withColumn("in_stock", F.lit(True)), "barcode", "left").withColumn(
        "in_stock", F.coalesce("in_stock", F.lit(False)))


def held_channels(stock: DataFrame) -> DataFrame:
    """Each channel in use with the names in it."""
    used = (F.col("ort") == DISPENSER) & (F.col("kanal") != "")
    return stock.where(used).select("name", "kanal").distinct().withColumn("nummer", channel_number(F.col("kanal")))


def lowest_channels(held: DataFrame) -> DataFrame:
    """The channel of each name: the lowest, should there be several; one without number comes last."""
    place = F.struct(F.col("nummer").isNull().alias("unnumbered"), "nummer", "kanal")
    return held.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(place).alias("lowest")).select(
        "name", F.col("lowest.kanal").alias("kanal"))


def channel_of_name(stock: DataFrame) -> DataFrame:
    """The dispenser channel that holds a medicine name."""
    return lowest_channels(held_channels(stock))


def channel_numbers(held: DataFrame) -> DataFrame:
    """Numbers of the channels in use."""
    return held.where(F.col("nummer").isNotNull()).select("nummer").distinct()


def user_by_name(users: DataFrame, username: str) -> DataFrame:
    return users.where(F.col("username") == username).select("kundennummer", "role")


def taken_flags(requests: DataFrame, users: DataFrame) -> DataFrame:
    """User requests with ``taken``: the name is already registered."""
    names = users.select("username", F.lit(True).alias("taken")).distinct()
    return hot_join(requests, names, ["username"]).withColumn("taken", F.coalesce("taken", F.lit(False)))


def taken_numbers(customers: DataFrame, users: DataFrame) -> DataFrame:
    """Customers, by ``kundennummer``, with ``taken``: the number belongs to a registered user."""
    numbers = users.select("kundennummer", F.lit(True).alias("taken")).distinct()
    return hot_join(customers, numbers, ["kundennummer"]).withColumn("taken", F.coalesce("taken", F.lit(False)))


def open_lines_of(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """Open order lines of the requested (order group, customer) pairs; requests must name each pair once."""
    return hot_join(orders.where(F.col("status") == OPEN), requests, ["bestellgruppe_id", "kundennummer"], "inner")


def first_per_barcode(requests: DataFrame, usable: Column) -> DataFrame:
    """Lowest ``seq`` of the usable requests for each barcode, summed up before the shuffle."""
    return requests.where(usable).groupBy("barcode").agg(F.min("seq").alias("first_seq"))


def _wrapped(key: Column, dtype: str) -> Column:
    """A value that stands for the key and is not the key."""
    return F.concat(F.lit("="), key) if dtype == "string" else F.bitwise_not(key.cast("long"))


def _unwrapped(key: Column, dtype: str) -> Column:
    return F.substr(key, F.lit(2)) if dtype == "string" else F.bitwise_not(key).cast(dtype)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join for a left side in which single keys may be hot; the right side has each key once.

    Adaptive execution splits a hot partition only where both sides come straight from a shuffle made for the
    join. A right side that has been grouped by the key already would be joined as it is, and the hot key stay
    in one task. So the keys are wrapped: the right side, which is the small one, is shuffled once more.
    """
    types = dict(left.dtypes)
    wrapped = {f"_k{i}": _wrapped(F.col(k), types[k]) for i, k in enumerate(keys)}
    facts = right.select(*[c.alias(k) for k, c in wrapped.items()], *[c for c in right.columns if c not in keys])
    # A key goes through the shuffle once, as it is wrapped.
    joined = left.withColumns(wrapped).drop(*keys).join(facts, list(wrapped), how)
    back = {k: _unwrapped(F.col(f"_k{i}"), types[k]).alias(k) for i, k in enumerate(keys)}
    return joined.select(*[back.get(c, F.col(c)) for c in left.columns], *[c for c in joined.columns if c not in {*left.columns, *wrapped}])


def with_facts(requests: DataFrame, facts: DataFrame, keys: list[str], usable: Column, unique: str = "seq") -> DataFrame:
    """Requests with the facts on their key, as in ``hot_join``.

    A request that fails its own checks needs no facts. It joins under a key of its own, so that bad scans are
    spread and do not pile up in one task.
    """
    own = F.concat(F.lit("#"), F.col(unique).cast("string"))
    wrapped = {f"_k{i}": F.concat(F.lit("="), F.col(k).cast("string")) for i, k in enumerate(keys)}
    asked = requests.withColumns({k: F.when(usable, c).otherwise(own) for k, c in wrapped.items()})
    known = facts.select(*[c.alias(k) for k, c in wrapped.items()], *[c for c in facts.columns if c not in keys])
    # Text that is in its wrapped key goes through the shuffle but once.
    types = dict(requests.dtypes)
    texts = {k: F.col(f"_k{i}") for i, k in enumerate(keys) if types[k] == "string"}
    asked = asked.withColumns({k: F.when(~F.coalesce(c.startswith("="), F.lit(False)), F.col(k)) for k, c in texts.items()})
    back = {k: F.when(c.startswith("="), F.substr(c, F.lit(2))).otherwise(F.col(k)) for k, c in texts.items()}
    return asked.join(known, list(wrapped), "left").withColumns(back).drop(*wrapped)
