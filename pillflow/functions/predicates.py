"""Row conditions.

Those that only filter are left bare so that they reach the scan; NULL then means no match.
Those that also occur negated are made sure never to be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pillflow.functions.scalars import AsOf, day, parse_date, time_of_day
from pillflow.schemas import ANY, DISPENSER, OPEN, STORE

# Words that mark a log entry as a critical failure.
CRITICAL_WORDS = (
    "App-Absturz", "Systemfehler", "Datenbankfehler", "nicht reagiert",
    "Timeout", "unbehandelte Ausnahme", "500", "kritischer Fehler",
)


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _everything() -> Column:
    return F.lit(True)


def filled(*columns: Column) -> Column:
    """All values present and not empty."""
    condition = _everything()
    for column in columns:
        condition = condition & _sure(column != "")
    return condition


def valid_barcode(barcode: Column) -> Column:
    """Eight to thirteen ASCII digits and nothing else."""
    return _sure(barcode.rlike(r"\A[0-9]{8,13}\z"))


def acceptable_expiry(raw: Column, as_of: AsOf) -> Column:
    """Text that is a date after the processing day; a product expiring today is refused."""
    return _sure(parse_date(raw) > day(as_of))


def expired(expiry: Column, as_of: AsOf) -> Column:
    """Expired at use: before the processing day, so today still counts as good."""
    return expiry < day(as_of)


def at_location(location: Column, wanted: str | None) -> Column:
    """Store room or dispenser; any other word means no filter."""
    return location == wanted if wanted in (STORE, DISPENSER) else _everything()


def barcode_contains(barcode: Column, part: str | None) -> Column:
    """Substring match; the part itself must be a valid barcode."""
    if not part:
        return _everything()
    if not (part.isascii() and part.isdigit() and 8 <= len(part) <= 13):
        raise ValueError("barcode filter must have 8 to 13 digits")
    return barcode.contains(part)


def status_in(status: Column, wanted: tuple[str, ...]) -> Column:
    return status.isin(*wanted) if wanted else F.lit(False)


def digits_contain(value: Column, part: str | int | None) -> Column:
    """Substring of an order or customer number."""
    return value.cast("string").contains(str(part)) if part else _everything()


def name_contains(name: Column, part: str | None) -> Column:
    """Substring, upper and lower case alike, without wildcards."""
    return F.lower(name).contains(F.lower(F.lit(part))) if part else _everything()


def article_is(name: Column, wanted: str | None) -> Column:
    return name == wanted if wanted and wanted != ANY else _everything()


def action_matches(action: Column, pattern: str | None) -> Column:
    """Regular expression anywhere in the action text, upper and lower case alike."""
    if not pattern or pattern == ANY:
        return _everything()
    return _sure(action.rlike(f"(?iu){pattern}"))


def dated(moment_text: Column, wanted: AsOf) -> Column:
    """Entries whose time, as text, begins with a day."""
    return moment_text.startswith(str(wanted)[:10])


def within_clock(moment_col: Column, start: str, end: str) -> Column:
    """Clock time between two HH:mm:ss bounds, both included."""
    return time_of_day(moment_col).between(start, end)


def in_channel(channel: Column, wanted: str | None) -> Column:
    return channel == wanted if wanted and wanted != ANY else _everything()


def order_of(customer: Column, status: Column, number: str, wanted: str = OPEN) -> Column:
    return (customer == number) & (status == wanted)


def is_open(status: Column) -> Column:
    return status == OPEN


def faulty_stock(barcode: Column, quantity: Column, expiry: Column) -> Column:
    """Empty barcode, nothing there, or no expiry date."""
    return _sure(barcode == "") | _sure(quantity <= 0) | expiry.isNull()


def critical(action: Column) -> Column:
    """Log entry that tells of a critical failure."""
    return _sure(action.rlike("(?iu)" + "|".join(CRITICAL_WORDS)))


def barcode_starts(barcode: Column, prefix: str) -> Column:
    return barcode.startswith(prefix)
