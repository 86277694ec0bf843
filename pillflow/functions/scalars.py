"""Scalar helpers on columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from pillflow.schemas import CHANNEL_PREFIX, UNKNOWN_CUSTOMER

AsOf = dt.date | dt.datetime | str


def day(as_of: AsOf) -> Column:
    """The processing day as a literal."""
    return F.lit(str(as_of)[:10]).cast("date")


def moment(as_of: AsOf) -> Column:
    """The processing time, to the second, as a literal."""
    return F.lit(str(as_of)[:19].replace("T", " ")).cast("timestamp_ntz")


def parse_date(raw: Column) -> Column:
    """Year-month-day, month and day with or without leading zero; NULL if it is no date."""
    shaped = F.when(raw.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), raw)
    return shaped.try_cast("date")


def parse_moment(raw: Column) -> Column:
    """A timestamp, or NULL if the text is none."""
    return raw.try_cast("timestamp_ntz")


def time_of_day(moment_col: Column) -> Column:
    """The clock time as HH:mm:ss text, which sorts like the time itself."""
    return F.substring(moment_col.cast("string"), 12, 8)


def one_year_after(as_of: AsOf | Column) -> Column:
    """Twelve months on; 29 February becomes 28 February."""
    return F.add_months(as_of if isinstance(as_of, Column) else day(as_of), 12)


def hours_between(start: Column, end: Column) -> Column:
    """Time between two moments in hours, by the clock, whatever the session's time zone."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(3600.0)


def channel_number(channel: Column) -> Column:
    """Number of a dispenser channel; NULL if the text is not of the usual form."""
    usual = channel.rlike(rf"\A{CHANNEL_PREFIX}[1-9][0-9]{{0,17}}\z")
    return F.when(usual, F.substring(channel, len(CHANNEL_PREFIX) + 1, 18).cast("long"))


def channel_name(number: Column) -> Column:
    return F.concat(F.lit(CHANNEL_PREFIX), number.cast("string"))


def customer_or_unknown(customer: Column) -> Column:
    return F.coalesce(customer, F.lit(UNKNOWN_CUSTOMER))


def order_label(group_id: Column, names: Column) -> Column:
    """Text of one order in a selection list."""
    return F.format_string("Bestellung %d: %s", group_id, names)
