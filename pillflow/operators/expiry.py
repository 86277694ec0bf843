"""Expiry warnings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, day
from pillflow.schemas import EXPIRED_STATUS
from pillflow.session import keep
from pillflow.sources.snapshots import Rewrite, Snapshots


def orphaned_warnings(warnings: DataFrame, stock: DataFrame) -> DataFrame:
    """Warnings whose goods have left the stock."""
    return warnings.join(stock.select("barcode"), "barcode", "left_anti")


def refresh_warnings(warnings: DataFrame, stock: DataFrame, as_of: AsOf) -> DataFrame:
    """Warnings after a look at the stock.

    Orphans go. A warning there is keeps its name and date and takes place and status from expired goods; it
    stays even if the goods are not expired. Expired goods without a warning get one. Every result row has a
    stock row, so one left join from the stock does all of it.
    """
    spoiled = F.coalesce(P.expired(F.col("verfallsdatum"), as_of), F.lit(False))
    goods = stock.select("barcode", "name", "verfallsdatum", "ort", spoiled.alias("spoiled"))
    old = warnings.select("barcode", F.struct("name", "verfallsdatum", "ort", "status").alias("alt"))
    warned = F.col("alt").isNotNull()
    return goods.join(old, "barcode", "left").where(warned | F.col("spoiled")).select(
        "barcode",
        F.when(warned, F.col("alt.name")).otherwise(F.col("name")).alias("name"),
        F.when(warned, F.col("alt.verfallsdatum")).otherwise(F.col("verfallsdatum")).alias("verfallsdatum"),
        F.when(F.col("spoiled"), F.col("ort")).otherwise(F.col("alt.ort")).alias("ort"),
        F.when(F.col("spoiled"), EXPIRED_STATUS).otherwise(F.col("alt.status")).alias("status"))


def newly_expired(stock: DataFrame, since: AsOf, as_of: AsOf) -> DataFrame:
    """Goods that were good on the day ``since`` and are expired on ``as_of``; the dates can be looked for in the scan."""
    date = F.col("verfallsdatum")
    return stock.where((date >= day(since)) & P.expired(date, as_of)).select("barcode", "name", "verfallsdatum", "ort")


def add_warnings(warnings: DataFrame, expired: DataFrame) -> DataFrame:
    """Warnings with those of expired goods: there already, they take place and status; else they are new."""
    new = expired.select("barcode", F.struct("name", "verfallsdatum", "ort").alias("neu"))
    old = warnings.select("barcode", F.struct("name", "verfallsdatum", "ort", "status").alias("alt"))
    warned, spoiled = F.col("alt").isNotNull(), F.col("neu").isNotNull()
    return old.join(new, "barcode", "full").select(
        "barcode",
        F.when(warned, F.col("alt.name")).otherwise(F.col("neu.name")).alias("name"),
        F.when(warned, F.col("alt.verfallsdatum")).otherwise(F.col("neu.verfallsdatum")).alias("verfallsdatum"),
        F.when(spoiled, F.col("neu.ort")).otherwise(F.col("alt.ort")).alias("ort"),
        F.when(spoiled, EXPIRED_STATUS).otherwise(F.col("alt.status")).alias("status"))


def refresh_stored(tables: Snapshots, as_of: AsOf) -> int:
    """The stored warnings brought up to a day; gives the version published.

    Pieces of stock or warnings that have been changed since the last refresh are refreshed as a whole. Of all others
    only goods that expired since then are looked at, which lie together, and only the warnings beside them written.
    The day and the version of the refresh are published with it. The first refresh, and one that goes back in time,
    looks at everything.
    """
    known = tables.counters()
    today = (dt.date.fromisoformat(str(as_of)[:10]) - dt.date(1970, 1, 1)).days
    last = known.get("warnings_day")
    everything = set(range(tables.pieces))
    if last is None or last > today:
        changed = everything
    else:
        since = known["warnings_version"]
        changed = tables.changed("stock", since) | tables.changed("warnings", since)
    rows = refresh_warnings(tables.read("warnings", changed), tables.read("stock", changed), as_of)
    written = changed
    if changed != everything:
        then = dt.date(1970, 1, 1) + dt.timedelta(days=last)
        expired = keep(newly_expired(tables.read("stock", everything - changed), then, as_of))
        beside = set(tables.touched("warnings", expired))
        rows = rows.unionByName(add_warnings(tables.read("warnings", beside), expired))
        written = changed | beside
    done = {"warnings_day": today, "warnings_version": (tables.version() or 0) + 1}
    return tables.commit({"warnings": Rewrite(rows, tuple(sorted(written)))} if written else {}, counters=done)
