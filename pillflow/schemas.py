"""Schemas of the stored tables and the codes that occur in them.

Dates and times carry no zone: they are what a person at the counter reads off the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOCK = T.StructType([
    T.StructField("barcode", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("menge", T.IntegerType()),
    T.StructField("verfallsdatum", T.DateType()),
    T.StructField("ort", T.StringType()),
    T.StructField("kanal", T.StringType()),
])

WARNINGS = T.StructType([
    T.StructField("barcode", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("verfallsdatum", T.DateType()),
    T.StructField("ort", T.StringType()),
    T.StructField("status", T.StringType()),
])

ORDERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("bestellgruppe_id", T.LongType()),
    T.StructField("kundennummer", T.StringType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("bestelldatum", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("kundennummer", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("role", T.StringType()),
])

ACTION_LOG = T.StructType([
    T.StructField("zeitstempel", T.StringType()),
    T.StructField("kundennummer", T.StringType()),
    T.StructField("aktion", T.StringType()),
])

INTAKE_REQUESTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("verfallsdatum_raw", T.StringType()),
    T.StructField("ort", T.StringType()),
])

BARCODE_REQUESTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("barcode", T.StringType()),
])

CARTS = T.StructType([
    T.StructField("cart_id", T.LongType()),
    T.StructField("kundennummer", T.StringType()),
])

CART_LINES = T.StructType([
    T.StructField("cart_id", T.LongType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("barcode", T.StringType()),
])

CANCEL_REQUESTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("bestellgruppe_id", T.LongType()),
    T.StructField("kundennummer", T.StringType()),
])

STATUS_REQUESTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("bestellgruppe_id", T.LongType()),
    T.StructField("status", T.StringType()),
])

USER_REQUESTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("role", T.StringType()),
])

TABLES = {"stock": STOCK, "warnings": WARNINGS, "orders": ORDERS, "users": USERS}

# Stored words.
STORE = "Lager"
DISPENSER = "Automat"
ANY = "Alle"
OPEN = "Offen"
APPROVED = "Genehmigt"
CANCELLED = "Storniert"
STATUSES = (OPEN, APPROVED, CANCELLED)
EXPIRED_STATUS = "Medikament abgelaufen"
ADMIN = "admin"
USER = "user"
UNKNOWN_CUSTOMER = "Unbekannt"
CHANNEL_PREFIX = "Kanal "

# Values a column takes when a stored row leaves it empty.
DEFAULTS = {
    "stock": {"ort": STORE},
    "warnings": {"status": OPEN},
    "orders": {"status": OPEN},
    "users": {"role": USER},
}

# Outcome codes.
OK = "OK"
MISSING_FIELD = "MISSING_FIELD"
BAD_BARCODE = "BAD_BARCODE"
EMPTY_BARCODE = "EMPTY_BARCODE"
IN_OPEN_ORDER = "IN_OPEN_ORDER"
IN_STOCK = "IN_STOCK"
BAD_EXPIRY = "BAD_EXPIRY"
NOT_FOUND = "NOT_FOUND"
IN_DISPENSER = "IN_DISPENSER"
NOT_IN_DISPENSER = "NOT_IN_DISPENSER"
EXPIRED = "EXPIRED"
DUPLICATE = "DUPLICATE"
NO_CUSTOMER = "NO_CUSTOMER"
EMPTY_CART = "EMPTY_CART"
LINE_UNAVAILABLE = "LINE_UNAVAILABLE"
MISSING_ARG = "MISSING_ARG"
NOT_OPEN = "NOT_OPEN"
CONFLICT = "CONFLICT"
TAKEN = "TAKEN"


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the columns that have a default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS[table].items()})
