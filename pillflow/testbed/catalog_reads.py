"""Registered queries that only read, each with its SQL counterpart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions import scalars as S
from pillflow.operators import expiry
from pillflow.operators import lookups as L
from pillflow.plans import log_views, order_views, quality, stock_views, user_views
from pillflow.sources import action_log, tables
from pillflow.session import scratch_path
from pillflow.testbed.mapping import AS_OF, Domain

DAY = "2024-01-15"
CUSTOMER = "10000042"


def _stored(d: Domain, table: str, df):
    """A table after a trip through storage."""
    path = scratch_path(d.spark, table)
    tables.write_table(df, table, path)
    return tables.read_table(d.spark, table, path)


def _log(d: Domain):
    return action_log.with_moments(d.action_log)


def _stored_log(d: Domain, df):
    path = scratch_path(d.spark, "log")
    action_log.append_log(df, path)
    return action_log.read_log(d.spark, path)


def _garbled(log):
    """The log with the times of some entries spoilt."""
    return log.withColumn("zeitstempel", F.when(log.aktion.startswith("Registrierung"), F.concat(F.lit("?"), "zeitstempel"))
                          .otherwise(F.col("zeitstempel")))


_SHOWN_STOCK = """barcode AS "Barcode", name AS "Name", menge AS "Menge", verfallsdatum AS "Verfallsdatum", ort AS "Ort", kanal AS "Kanal" """
_SHOWN_LOG = """zeitstempel AS "Zeitstempel", kundennummer AS "Benutzer", aktion AS "Aktion" """
_SHOWN_USERS = """id AS "ID", kundennummer AS "Kundennummer", username AS "Benutzername", role AS "Rolle" """
_CRITICAL = """regexp_matches(aktion, '(?i)App-Absturz|Systemfehler|Datenbankfehler|nicht reagiert|Timeout|unbehandelte Ausnahme|500|kritischer Fehler')"""
_FLAG = "regexp_full_match(barcode, '[0-9]{{8,13}}')"

_OVERVIEW = """SELECT bestellgruppe_id AS "Bestell-ID", kundennummer AS "Kundennummer",
    string_agg(name, ', ' ORDER BY barcode, id) AS "Medikamente", min(bestelldatum) AS "Bestelldatum",
    min(status) AS "Status" FROM bestellungen {where} GROUP BY bestellgruppe_id, kundennummer"""
_MINE = """SELECT bestellgruppe_id AS "Bestell-ID", string_agg(name, ', ' ORDER BY barcode, id) AS "Medikamente",
    min(bestelldatum) AS "Bestelldatum", min(status) AS "Status" FROM bestellungen
    WHERE kundennummer = '10000042' AND status = '{status}' GROUP BY bestellgruppe_id"""

_REFRESHED = """fresh AS (
    SELECT s.barcode, CASE WHEN w.barcode IS NULL THEN s.name ELSE w.name END AS name,
           CASE WHEN w.barcode IS NULL THEN s.verfallsdatum ELSE w.verfallsdatum END AS verfallsdatum,
           s.ort, 'Medikament abgelaufen' AS status
    FROM stock s LEFT JOIN warnungen w ON s.barcode = w.barcode WHERE s.verfallsdatum < DATE '2000-01-01'
    UNION ALL
    SELECT w.* FROM warnungen w WHERE w.barcode IN (SELECT barcode FROM stock WHERE NOT verfallsdatum < DATE '2000-01-01'))"""

_KEYS = [("stock", "stock", "barcode"), ("warnungen", "warnungen", "barcode"), ("users", "users", "id"), ("users", "users", "kundennummer"),
         ("users", "users", "username"), ("bestellungen", "bestellungen", "id")]
_REPEATED_KEYS = " UNION ALL ".join(
    f"SELECT '{shown}' AS tabelle, '{key}' AS spalte, CAST({key} AS VARCHAR) AS wert, count(*) AS anzahl FROM {table} GROUP BY {key} HAVING count(*) > 1"
    for shown, table, key in _KEYS)


def _repeated_keys(d: Domain):
    """Values that occur more than once in a column that is a key."""
    found = [quality.repeated_keys(getattr(d, table), key).select(
        F.lit(shown).alias("tabelle"), F.lit(key).alias("spalte"), F.col(key).cast("string").alias("wert"), "anzahl")
        for shown, table, key in _KEYS]
    return reduce(DataFrame.unionByName, found)


# name: (Spark query, SQL body, further expressions of the SQL)
READS = {
    # Scans and the log source
    "a1_stock_scan": (lambda d: tables.read_table(d.spark, "stock", d.path_of("stock")), "SELECT * FROM stock", ""),
    "a2_order_scan": (lambda d: tables.read_table(d.spark, "orders", d.path_of("bestellungen")), "SELECT * FROM bestellungen", ""),
    "a3_warning_scan": (lambda d: tables.read_table(d.spark, "warnings", d.path_of("warnungen")), "SELECT * FROM warnungen", ""),
    "a4_user_scan": (lambda d: tables.read_table(d.spark, "users", d.path_of("users")), "SELECT * FROM users", ""),
    "a5_action_log": (lambda d: _stored_log(d, d.action_log), "SELECT * FROM action_log", ""),
    "a6_clean_log": (
        lambda d: action_log.with_moments(_stored_log(d, _garbled(d.action_log))),
        """SELECT *, CAST(zeitstempel AS TIMESTAMP) AS ts FROM action_log WHERE aktion NOT LIKE 'Registrierung%'""", ""),
    "a8_defaults": (
        lambda d: _stored(d, "stock", d.stock.withColumn("ort", F.when(F.col("ort") == "Automat", F.col("ort")))),
        "SELECT * FROM stock", ""),
    "a8_dispenser_view": (
        lambda d: tables.dispenser_stock(d.stock),
        "SELECT barcode, name, menge, verfallsdatum, ort FROM stock WHERE ort = 'Automat'", ""),

    # Predicates
    "b1_barcode_check": (
        lambda d: d.barcode_req.select("seq", "barcode", P.valid_barcode(F.col("barcode")).alias("gueltig")),
        f"SELECT seq, barcode, {_FLAG} AS gueltig FROM barcode_req", ""),
    "b2_required_fields": (
        lambda d: d.intake_req.select("seq", P.filled(F.col("barcode"), F.col("name"), F.col("verfallsdatum_raw")).alias("vollstaendig")),
        "SELECT seq, coalesce(barcode, '') <> '' AND coalesce(name, '') <> '' AND coalesce(verfallsdatum_raw, '') <> '' AS vollstaendig FROM intake_req", ""),
    "b3_expiry_check": (
        lambda d: d.intake_req.select("seq", P.acceptable_expiry(F.col("verfallsdatum_raw"), AS_OF).alias("haltbar")),
        "SELECT seq, coalesce(TRY_CAST(verfallsdatum_raw AS DATE) > DATE '2000-01-01', false) AS haltbar FROM intake_req", ""),
    "b4_expired_stock": (
        lambda d: d.stock.where(P.expired(F.col("verfallsdatum"), AS_OF)).select("barcode", "name", "verfallsdatum", "ort"),
        "SELECT barcode, name, verfallsdatum, ort FROM stock WHERE verfallsdatum < DATE '2000-01-01'", ""),
    "b5_location_filter": (
        lambda d: stock_views.stock_list(d.stock, location="Lager"), f"SELECT {_SHOWN_STOCK} FROM stock WHERE ort = 'Lager'", ""),
    "b6_barcode_filter": (
        lambda d: stock_views.stock_list(d.stock, barcode="10000026"),
        f"SELECT {_SHOWN_STOCK} FROM stock WHERE contains(barcode, '10000026')", ""),
    "b7_status_filter": (
        lambda d: d.bestellungen.where(P.status_in(F.col("status"), ("Offen", "Genehmigt"))),
        "SELECT * FROM bestellungen WHERE status IN ('Offen', 'Genehmigt')", ""),
    "b8_group_filter": (
        lambda d: order_views.order_overview(d.bestellungen, group_part="42"),
        _OVERVIEW.format(where="WHERE contains(CAST(bestellgruppe_id AS VARCHAR), '42')"), ""),
    "b9_customer_filter": (
        lambda d: order_views.order_overview(d.bestellungen, customer_part="77"),
        _OVERVIEW.format(where="WHERE contains(kundennummer, '77')"), ""),
    "b10_username_filter": (
        lambda d: user_views.user_list(d.users, "cUSTOMER#0000001"),
        f"SELECT {_SHOWN_USERS} FROM users WHERE contains(lower(username), 'customer#0000001')", ""),
    "b11_article_filter": (
        lambda d: stock_views.article_totals(d.stock, "red bolt"),
        """SELECT name AS "Name", CAST(sum(menge) AS BIGINT) AS "Menge" FROM stock WHERE name = 'red bolt' GROUP BY name""", ""),
    "b12_action_filter": (
        lambda d: log_views.log_search(d.action_log, "medikament|lagerbestand"),
        f"SELECT {_SHOWN_LOG} FROM action_log WHERE regexp_matches(aktion, '(?i)medikament|lagerbestand')", ""),
    "b13_day_filter": (
        lambda d: log_views.log_review(_log(d), DAY),
        f"SELECT {_SHOWN_LOG} FROM action_log WHERE starts_with(zeitstempel, '2024-01-15')", ""),
    "b14_clock_filter": (
        lambda d: log_views.log_list(_log(d).where(P.within_clock(F.col("ts"), "08:00:00", "17:30:00"))),
        f"SELECT {_SHOWN_LOG} FROM action_log WHERE CAST(CAST(zeitstempel AS TIMESTAMP) AS TIME) BETWEEN TIME '08:00:00' AND TIME '17:30:00'", ""),
    "b15_channel_stock": (
        lambda d: stock_views.stock_list(d.stock, location="Automat", channel="Kanal 6"),
        f"SELECT {_SHOWN_STOCK} FROM stock WHERE ort = 'Automat' AND kanal = 'Kanal 6'", ""),
    "b16_customer_status": (
        lambda d: d.bestellungen.where(P.order_of(F.col("kundennummer"), F.col("status"), CUSTOMER, "Genehmigt")),
        "SELECT * FROM bestellungen WHERE kundennummer = '10000042' AND status = 'Genehmigt'", ""),
    "b17_open_orders": (
        lambda d: d.bestellungen.where(P.is_open(F.col("status"))), "SELECT * FROM bestellungen WHERE status = 'Offen'", ""),
    "b18_faulty_stock": (
        lambda d: d.stock.withColumn("menge", F.col("menge") - 1)
        .where(P.faulty_stock(F.col("barcode"), F.col("menge"), F.col("verfallsdatum"))),
        "SELECT * REPLACE (menge - 1 AS menge) FROM stock WHERE barcode = '' OR menge - 1 <= 0 OR verfallsdatum IS NULL", ""),
    "b19_critical_entries": (
        lambda d: log_views.log_list(d.action_log.where(P.critical(F.col("aktion")))),
        f"SELECT {_SHOWN_LOG} FROM action_log WHERE {_CRITICAL}", ""),
    "b20_barcode_prefix": (
        lambda d: d.stock.where(P.barcode_starts(F.col("barcode"), "1000")), "SELECT * FROM stock WHERE barcode LIKE '1000%'", ""),

    # Projections
    "c1_stock_list": (lambda d: stock_views.stock_list(d.stock), f"SELECT {_SHOWN_STOCK} FROM stock", ""),
    "c5_user_list": (lambda d: user_views.user_list(d.users), f"SELECT {_SHOWN_USERS} FROM users", ""),
    "c6_log_list": (lambda d: log_views.log_list(_log(d)), f"SELECT {_SHOWN_LOG} FROM action_log", ""),
    "c8_order_labels": (
        lambda d: order_views.order_labels(d.bestellungen, CUSTOMER),
        """SELECT "Bestell-ID", 'Bestellung ' || CAST("Bestell-ID" AS VARCHAR) || ': ' || "Medikamente" AS "Auswahl" FROM ("""
        + _MINE.format(status="Offen") + ") o", ""),

    # Lookups
    "d1_open_order_barcodes": (
        lambda d: L.open_order_barcodes(d.bestellungen),
        "SELECT DISTINCT barcode, true AS in_open_order FROM bestellungen WHERE status = 'Offen'", ""),
    "d2_stocked_requests": (
        lambda d: d.barcode_req.join(L.stocked_barcodes(d.stock), "barcode", "left")
        .select("seq", F.coalesce("in_stock", F.lit(False)).alias("in_stock")),
        "SELECT seq, barcode IN (SELECT barcode FROM stock) AS in_stock FROM barcode_req", ""),
    "d3_stock_row": (
        lambda d: L.stock_row_of(d.barcode_req, d.stock),
        "SELECT r.seq, r.barcode, s.* EXCLUDE (barcode), s.barcode IS NOT NULL AS in_stock FROM barcode_req r LEFT JOIN stock s ON r.barcode = s.barcode", ""),
    "d4_orphaned_warnings": (
        lambda d: expiry.orphaned_warnings(d.warnungen, d.stock),
        "SELECT * FROM warnungen w WHERE NOT EXISTS (SELECT 1 FROM stock s WHERE s.barcode = w.barcode)", ""),
    "d7_channel_of_name": (
        lambda d: L.channel_of_name(d.stock),
        "SELECT name, 'Kanal ' || CAST(min(CAST(substring(kanal, 7) AS BIGINT)) AS VARCHAR) AS kanal FROM stock WHERE ort = 'Automat' GROUP BY name", ""),
    "d8_taken_usernames": (
        lambda d: L.taken_flags(d.user_req, d.users),
        "SELECT *, username IN (SELECT username FROM users) AS taken FROM user_req", ""),
    "d8_taken_customer_numbers": (
        lambda d: L.taken_numbers(d.cancel_req.select("seq", "kundennummer"), d.users),
        "SELECT seq, kundennummer, coalesce(kundennummer IN (SELECT kundennummer FROM users), false) AS taken FROM cancel_req", ""),
    "d9_user_by_name": (
        lambda d: L.user_by_name(d.users, "Customer#000000007"),
        "SELECT kundennummer, role FROM users WHERE username = 'Customer#000000007'", ""),
    "d10_open_lines": (
        lambda d: L.open_lines_of(d.cancel_req.select("bestellgruppe_id", "kundennummer").distinct(), d.bestellungen),
        """SELECT b.* FROM bestellungen b WHERE status = 'Offen' AND EXISTS (SELECT 1 FROM cancel_req c
           WHERE c.bestellgruppe_id = b.bestellgruppe_id AND c.kundennummer = b.kundennummer)""", ""),

    # Aggregations
    "e1_article_totals": (
        lambda d: stock_views.article_totals(d.stock),
        """SELECT name AS "Name", CAST(sum(menge) AS BIGINT) AS "Menge" FROM stock GROUP BY name""", ""),
    "e3_customer_orders": (
        lambda d: order_views.customer_orders(d.bestellungen, CUSTOMER, "Genehmigt"), _MINE.format(status="Genehmigt"), ""),
    "e5_stock_count": (lambda d: stock_views.stock_count(d.stock), "SELECT count(*) AS anzahl FROM stock", ""),
    "e6_channel_fill": (
        lambda d: stock_views.channel_fill(d.stock),
        "SELECT kanal, count(*) AS anzahl FROM stock WHERE ort = 'Automat' AND kanal IS NOT NULL GROUP BY kanal", ""),
    "e7_expired_count": (
        lambda d: stock_views.warning_count(d.warnungen, d.stock, AS_OF), "SELECT count(*) AS anzahl FROM fresh", _REFRESHED),
    "e8_faulty_rate": (
        lambda d: quality.faulty_rate(d.stock.withColumn("menge", F.col("menge") - 1)),
        """SELECT CAST(count(*) FILTER (WHERE menge - 1 <= 0) AS BIGINT) AS fehlerhaft, CAST(sum(menge - 1) AS BIGINT) AS menge,
           CAST(count(*) FILTER (WHERE menge - 1 <= 0) AS DOUBLE) / sum(menge - 1) * CAST(100 AS DOUBLE) AS rate FROM stock""", ""),
    "e10_mtbf": (
        lambda d: log_views.mean_time_between_failures(_log(d)),
        f"""SELECT count(*) AS ausfaelle, CAST(date_diff('second', min(t), max(t)) AS DOUBLE) / CAST(3600 AS DOUBLE) / (count(*) - 1) AS mtbf_stunden
           FROM (SELECT CAST(zeitstempel AS TIMESTAMP) AS t FROM action_log WHERE {_CRITICAL}) f""", ""),
    "e11_admin_count": (
        lambda d: quality.admin_count(d.users), "SELECT count(*) AS administratoren FROM users WHERE role = 'admin'", ""),

    # Gaps, orders, distinct values
    "f1_failure_gaps": (
        lambda d: log_views.failure_gaps(_log(d)),
        f"""SELECT ts, kundennummer, aktion, CAST(date_diff('second', lag(ts) OVER (ORDER BY ts, kundennummer, aktion), ts) AS DOUBLE) / CAST(3600 AS DOUBLE) AS abstand_stunden
           FROM (SELECT *, CAST(zeitstempel AS TIMESTAMP) AS ts FROM action_log WHERE {_CRITICAL}) f""", ""),
    "g1_newest_orders": (
        lambda d: order_views.newest_orders(d.bestellungen),
        "SELECT *, row_number() OVER (ORDER BY bestelldatum DESC, bestellgruppe_id, id) AS rang FROM bestellungen", ""),
    "g2_log_by_time": (
        lambda d: log_views.log_by_time(_log(d)),
        """SELECT *, CAST(zeitstempel AS TIMESTAMP) AS ts, row_number() OVER (ORDER BY CAST(zeitstempel AS TIMESTAMP), kundennummer, aktion) AS rang
           FROM action_log""", ""),
    "g3_random_row": (
        lambda d: stock_views.random_stock_row(d.stock, 7), "SELECT * FROM stock ORDER BY md5('7' || barcode), barcode LIMIT 1", ""),
    "h1_article_names": (lambda d: stock_views.article_names(d.stock), "SELECT DISTINCT name FROM stock", ""),
    "h2_channels": (
        lambda d: stock_views.occupied_channels(d.stock),
        "SELECT DISTINCT kanal FROM stock WHERE ort = 'Automat' AND kanal IS NOT NULL", ""),
    "h3_free_channels": (
        lambda d: stock_views.free_channels(d.stock, 50),
        """SELECT rang, 'Kanal ' || CAST(n AS VARCHAR) AS kanal FROM (
             SELECT n, row_number() OVER (ORDER BY n) AS rang
             FROM (SELECT unnest(range(1, 51 + (SELECT count(*) FROM stock))) AS n) x
             WHERE 'Kanal ' || CAST(n AS VARCHAR) NOT IN (SELECT kanal FROM stock WHERE kanal IS NOT NULL)) y WHERE rang <= 50""", ""),

    # Scalar functions
    "i4_parsed_dates": (
        lambda d: d.intake_req.select("seq", S.parse_date(F.col("verfallsdatum_raw")).alias("datum")),
        "SELECT seq, TRY_CAST(verfallsdatum_raw AS DATE) AS datum FROM intake_req", ""),
    "i6_parsed_times": (
        lambda d: _garbled(d.action_log).select("aktion", S.parse_moment(F.col("zeitstempel")).alias("ts")),
        "SELECT aktion, CASE WHEN aktion NOT LIKE 'Registrierung%' THEN CAST(zeitstempel AS TIMESTAMP) END AS ts FROM action_log", ""),
    "i7_time_of_day": (
        lambda d: _log(d).select("aktion", "kundennummer", S.time_of_day(F.col("ts")).alias("uhrzeit")),
        "SELECT aktion, kundennummer, substring(zeitstempel, 12) AS uhrzeit FROM action_log", ""),
    "i8_one_year_after": (
        lambda d: d.stock.select("barcode", S.one_year_after(F.col("verfallsdatum")).alias("ein_jahr_spaeter")),
        "SELECT barcode, CAST(verfallsdatum + INTERVAL 12 MONTH AS DATE) AS ein_jahr_spaeter FROM stock", ""),
    "i12_channel_numbers": (
        lambda d: d.stock.select("barcode", S.channel_number(F.col("kanal")).alias("nummer")),
        "SELECT barcode, CAST(substring(kanal, 7) AS BIGINT) AS nummer FROM stock", ""),
    "i13_known_customers": (
        lambda d: d.cancel_req.select("seq", S.customer_or_unknown(F.col("kundennummer")).alias("kundennummer")),
        "SELECT seq, coalesce(kundennummer, 'Unbekannt') AS kundennummer FROM cancel_req", ""),

    # Composite queries
    "k1_stock_list": (
        lambda d: stock_views.stock_list(d.stock, location="Automat"), f"SELECT {_SHOWN_STOCK} FROM stock WHERE ort = 'Automat'", ""),
    "k2_warnings": (
        lambda d: stock_views.warning_list(d.warnungen, d.stock, AS_OF, "Automat"),
        """SELECT barcode AS "Barcode", name AS "Name", verfallsdatum AS "Verfallsdatum", ort AS "Ort", status AS "Status"
           FROM fresh WHERE ort = 'Automat'""", _REFRESHED),
    "k3_order_overview": (lambda d: order_views.order_overview(d.bestellungen), _OVERVIEW.format(where=""), ""),
    "k4_customer_orders": (
        lambda d: order_views.customer_orders(d.bestellungen, CUSTOMER), _MINE.format(status="Offen"), ""),
    "k5_log_review": (
        lambda d: log_views.log_review(_log(d), DAY, "06:00:00", "18:00:00"),
        f"SELECT {_SHOWN_LOG} FROM action_log WHERE zeitstempel BETWEEN '2024-01-15 06:00:00' AND '2024-01-15 18:00:00'", ""),
    "k6_log_search": (
        lambda d: log_views.log_search(d.action_log, "bestellung"),
        f"SELECT {_SHOWN_LOG} FROM action_log WHERE contains(lower(aktion), 'bestellung')", ""),
    "k7_user_search": (
        lambda d: user_views.user_list(d.users, "customer#"),
        f"SELECT {_SHOWN_USERS} FROM users WHERE contains(lower(username), 'customer#')", ""),
    "k8_article_totals": (
        lambda d: stock_views.article_totals(d.stock, stock_views.article_names(d.stock).agg(F.min("name")).first()[0]),
        """SELECT name AS "Name", CAST(sum(menge) AS BIGINT) AS "Menge" FROM stock WHERE name = (SELECT min(name) FROM stock) GROUP BY name""", ""),
    "q1_key_check": (_repeated_keys, _REPEATED_KEYS, ""),
    "q1_channels_per_name": (
        lambda d: quality.channels_per_name(d.stock),
        "SELECT name, count(DISTINCT kanal) AS kanaele FROM stock WHERE ort = 'Automat' AND kanal IS NOT NULL GROUP BY name", ""),
}
