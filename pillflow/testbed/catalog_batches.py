"""Registered queries that change tables: outcomes and new state, each with its SQL counterpart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow import schemas as S
from pillflow.operators import audit, expiry
from pillflow.operators.accounts import Registration, remove_users
from pillflow.operators.carts import CartScans, Checkout
from pillflow.operators.dispenser import Fill, Return
from pillflow.operators.orders import Cancellation, set_order_status
from pillflow.operators.stockroom import Intake, Removal
from pillflow.plans import log_views, quality, stock_views
from pillflow.session import scratch_path
from pillflow.sources import action_log
from pillflow.sources.snapshots import Append, Rewrite, Snapshots
from pillflow.sources.tables import COMPACT
from pillflow.streaming import log_ingest, request_batches, running_figures
from pillflow.testbed.catalog_reads import _CRITICAL, _REFRESHED
from pillflow.testbed.mapping import AS_OF, AS_OF_TIME, Domain


def intake(d: Domain) -> Intake:
    return Intake(d.stock, d.bestellungen, d.intake_req, AS_OF)


def removal(d: Domain) -> Removal:
    return Removal(d.stock, d.barcode_req)


def fill(d: Domain) -> Fill:
    return Fill(d.stock, d.barcode_req, AS_OF)


def give_back(d: Domain) -> Return:
    return Return(d.stock, d.barcode_req)


def scans(d: Domain) -> CartScans:
    return CartScans(d.stock, d.cart_scans, AS_OF)


def checkout(d: Domain) -> Checkout:
    return Checkout(d.stock, d.bestellungen, d.carts, d.cart_lines, AS_OF_TIME)


def cancellation(d: Domain) -> Cancellation:
    return Cancellation(d.stock, d.bestellungen, d.cancel_req, AS_OF)


def registration(d: Domain) -> Registration:
    return Registration(d.users, d.user_req, d.bestellungen)


def first_registration(d: Domain) -> Registration:
    """Registration in a directory without administrator."""
    return Registration(d.users.where("role <> 'admin'"), d.user_req, d.bestellungen)


_DIGITS = "'[0-9]{{8,13}}'"

_INTAKE = f"""judged AS (
    SELECT *, CASE
        WHEN coalesce(barcode, '') = '' OR coalesce(name, '') = '' OR coalesce(verfallsdatum_raw, '') = '' THEN 'MISSING_FIELD'
        WHEN NOT regexp_full_match(barcode, {_DIGITS}) THEN 'BAD_BARCODE'
        WHEN barcode IN (SELECT barcode FROM bestellungen WHERE status = 'Offen') THEN 'IN_OPEN_ORDER'
        WHEN barcode IN (SELECT barcode FROM stock) THEN 'IN_STOCK'
        WHEN NOT coalesce(TRY_CAST(verfallsdatum_raw AS DATE) > DATE '2000-01-01', false) THEN 'BAD_EXPIRY'
        ELSE 'OK' END AS first_code
    FROM intake_req),
intake_outcomes AS (
    SELECT seq, barcode, CASE WHEN first_code IN ('OK', 'BAD_EXPIRY')
        AND seq > min(seq) FILTER (WHERE first_code = 'OK') OVER (PARTITION BY barcode) THEN 'IN_STOCK' ELSE first_code END AS code,
        name AS detail, verfallsdatum_raw FROM judged)"""

_REMOVAL = f"""removal_outcomes AS (
    SELECT seq, r.barcode, CASE
        WHEN NOT regexp_full_match(r.barcode, {_DIGITS}) THEN 'BAD_BARCODE'
        WHEN s.barcode IS NULL THEN 'NOT_FOUND'
        WHEN s.ort = 'Automat' THEN 'IN_DISPENSER'
        WHEN row_number() OVER (PARTITION BY r.barcode ORDER BY seq) = 1 THEN 'OK'
        ELSE 'NOT_FOUND' END AS code, s.name AS detail
    FROM barcode_req r LEFT JOIN stock s ON r.barcode = s.barcode)"""

_CODE = f"""CASE WHEN r.barcode = '' THEN 'EMPTY_BARCODE' WHEN NOT regexp_full_match(r.barcode, {_DIGITS}) THEN 'BAD_BARCODE'"""

_FILL = f"""moves AS (
    SELECT seq, r.barcode, s.name, {_CODE} WHEN s.barcode IS NULL THEN 'NOT_FOUND'
        WHEN s.verfallsdatum < DATE '2000-01-01' THEN 'EXPIRED' ELSE 'OK' END AS code
    FROM barcode_req r LEFT JOIN stock s ON r.barcode = s.barcode),
held AS (SELECT name, min(CAST(substring(kanal, 7) AS BIGINT)) AS nummer FROM stock WHERE ort = 'Automat' GROUP BY name),
fresh_names AS (
    SELECT name, row_number() OVER (ORDER BY min(seq)) AS k FROM moves
    WHERE code = 'OK' AND name NOT IN (SELECT name FROM held) GROUP BY name),
free AS (
    SELECT n, row_number() OVER (ORDER BY n) AS k
    FROM (SELECT unnest(range(1, 1 + (SELECT count(*) FROM held) + (SELECT count(*) FROM fresh_names))) AS n) x
    WHERE n NOT IN (SELECT nummer FROM held)),
places AS (
    SELECT name, nummer FROM held UNION ALL SELECT name, n FROM fresh_names JOIN free USING (k)),
fill_outcomes AS (
    SELECT seq, barcode, code, name, CASE WHEN code = 'OK' THEN 'Kanal ' || CAST(nummer AS VARCHAR) END AS detail
    FROM moves LEFT JOIN places USING (name))"""

_RETURN = f"""return_outcomes AS (
    SELECT seq, r.barcode, {_CODE}
        WHEN s.barcode IS NOT NULL AND row_number() OVER (PARTITION BY r.barcode ORDER BY seq) = 1 THEN 'OK'
        ELSE 'NOT_IN_DISPENSER' END AS code, s.kanal, s.name
    FROM barcode_req r LEFT JOIN (SELECT * FROM stock WHERE ort = 'Automat') s ON r.barcode = s.barcode)"""

_SCANS = f"""scan_codes AS (
    SELECT cart_id, line_no, r.barcode, s.name, s.verfallsdatum, {_CODE}
        WHEN s.barcode IS NULL THEN 'NOT_IN_DISPENSER' WHEN s.verfallsdatum < DATE '2000-01-01' THEN 'EXPIRED' ELSE 'OK' END AS first_code
    FROM cart_scans r LEFT JOIN (SELECT * FROM stock WHERE ort = 'Automat') s ON r.barcode = s.barcode),
scan_outcomes AS (
    SELECT cart_id, line_no, barcode, name AS detail, verfallsdatum,
        CASE WHEN first_code = 'OK' AND row_number() OVER (PARTITION BY cart_id, barcode ORDER BY line_no) > 1
             THEN 'DUPLICATE' ELSE first_code END AS code FROM scan_codes)"""

# Each step decides the carts that are lowest for all of their barcodes and those that share one with them.
_CHECKOUT = """in_dispenser AS (SELECT barcode, name FROM stock WHERE ort = 'Automat'),
goods AS (
    SELECT cart_id, g.barcode, line_no, h.barcode IS NOT NULL AS there,
           count(*) OVER (PARTITION BY cart_id, g.barcode) AS times
    FROM cart_lines g LEFT JOIN in_dispenser h ON g.barcode = h.barcode),
able AS (
    SELECT g.cart_id FROM goods g JOIN carts c ON g.cart_id = c.cart_id WHERE coalesce(kundennummer, '') <> ''
    GROUP BY g.cart_id HAVING bool_and(there AND times = 1)),
steps AS (
    SELECT 0 AS step, cart_id, barcode, false AS won, false AS lost FROM goods WHERE cart_id IN (SELECT cart_id FROM able)
    UNION ALL
    SELECT step + 1, cart_id, barcode, best, NOT best AND bool_or(hit) OVER (PARTITION BY cart_id)
    FROM (SELECT *, bool_or(best) OVER (PARTITION BY barcode) AS hit
          FROM (SELECT *, bool_and(low) OVER (PARTITION BY cart_id) AS best
                FROM (SELECT *, cart_id = min(cart_id) OVER (PARTITION BY barcode) AS low
                      FROM steps WHERE NOT won AND NOT lost) a) b) c),
owned AS (SELECT cart_id, barcode FROM steps WHERE won),
sold_carts AS (
    SELECT cart_id, row_number() OVER (ORDER BY cart_id) + (SELECT max(bestellgruppe_id) FROM bestellungen) AS gruppe
    FROM (SELECT DISTINCT cart_id FROM owned) x),
gaps AS (
    SELECT g.cart_id, coalesce(arg_min(g.barcode, line_no) FILTER (WHERE NOT there OR o.cart_id < g.cart_id),
                               arg_min(g.barcode, line_no)) AS gap
    FROM goods g LEFT JOIN owned o ON g.barcode = o.barcode
    WHERE NOT there OR o.cart_id < g.cart_id OR times > 1 GROUP BY g.cart_id),
new_orders AS (
    SELECT (SELECT max(id) FROM bestellungen) + row_number() OVER (ORDER BY l.cart_id, l.line_no) AS id,
           gruppe AS bestellgruppe_id, kundennummer, l.barcode, h.name,
           TIMESTAMP '2000-01-01 08:30:00' AS bestelldatum, 'Offen' AS status
    FROM owned o JOIN cart_lines l ON o.cart_id = l.cart_id AND o.barcode = l.barcode
    JOIN sold_carts s ON s.cart_id = l.cart_id JOIN carts c ON c.cart_id = l.cart_id JOIN in_dispenser h ON h.barcode = l.barcode)"""

_CANCEL = """asked AS (
    SELECT bestellgruppe_id, kundennummer, min(seq) AS first_seq FROM cancel_req
    WHERE bestellgruppe_id <> 0 AND kundennummer <> '' GROUP BY bestellgruppe_id, kundennummer),
open_lines AS (
    SELECT b.*, first_seq, s.ort <> 'Lager' AS clash FROM bestellungen b JOIN asked USING (bestellgruppe_id, kundennummer)
    LEFT JOIN stock s ON b.barcode = s.barcode WHERE b.status = 'Offen'),
verdicts AS (
    SELECT bestellgruppe_id, kundennummer, first_seq, coalesce(bool_or(clash), false) AS conflict, count(*) AS n,
           arg_min(barcode, id) FILTER (WHERE clash) AS clash_barcode, arg_min(name, id) FILTER (WHERE clash) AS clash_name
    FROM open_lines GROUP BY bestellgruppe_id, kundennummer, first_seq),
back AS (
    SELECT barcode, count(*) AS n, arg_min(name, {{'a': o.first_seq, 'b': id}}) AS name
    FROM open_lines o JOIN verdicts v USING (bestellgruppe_id, kundennummer) WHERE NOT conflict GROUP BY barcode)"""

_REGISTER = """asked AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY seq) AS k FROM user_req WHERE coalesce(username, '') <> ''),
new_users AS (
    SELECT seq, username, role, row_number() OVER (ORDER BY seq) AS rang FROM asked
    WHERE k = 1 AND username NOT IN (SELECT username FROM directory)),
entered AS (
    SELECT rang + coalesce((SELECT max(id) FROM directory), 0) AS id, username,
           CAST(rang + greatest(9999999, (SELECT max(CAST(kundennummer AS BIGINT)) FROM directory),
                                (SELECT max(CAST(kundennummer AS BIGINT)) FROM bestellungen)) AS VARCHAR) AS kundennummer,
           CASE WHEN rang = 1 AND NOT EXISTS (SELECT 1 FROM directory WHERE role = 'admin') THEN 'admin' ELSE coalesce(role, 'user') END AS role
    FROM new_users)"""

_CHECKED_OUT = """SELECT c.cart_id, c.kundennummer, CASE WHEN coalesce(c.kundennummer, '') = '' THEN 'NO_CUSTOMER'
             WHEN c.cart_id NOT IN (SELECT cart_id FROM goods) THEN 'EMPTY_CART'
             WHEN gruppe IS NOT NULL THEN 'OK' ELSE 'LINE_UNAVAILABLE' END AS code,
           CASE WHEN coalesce(c.kundennummer, '') = '' THEN NULL WHEN gruppe IS NOT NULL THEN CAST(gruppe AS VARCHAR) ELSE gap END AS detail,
           CASE WHEN coalesce(c.kundennummer, '') <> '' AND gruppe IS NULL THEN h.name END AS name
           FROM carts c LEFT JOIN sold_carts s ON c.cart_id = s.cart_id LEFT JOIN gaps g ON c.cart_id = g.cart_id
           LEFT JOIN in_dispenser h ON h.barcode = g.gap"""
_CANCELLED = """SELECT r.seq, r.bestellgruppe_id, r.kundennummer,
           CASE WHEN r.bestellgruppe_id = 0 OR coalesce(r.kundennummer, '') = '' THEN 'MISSING_ARG' WHEN v.n IS NULL THEN 'NOT_OPEN'
                WHEN conflict THEN 'CONFLICT' WHEN r.seq = first_seq THEN 'OK' ELSE 'NOT_OPEN' END AS code,
           CASE WHEN conflict THEN clash_barcode WHEN r.seq = first_seq THEN CAST(v.n AS VARCHAR) END AS detail,
           CASE WHEN conflict THEN clash_name END AS name
           FROM cancel_req r LEFT JOIN verdicts v ON r.bestellgruppe_id = v.bestellgruppe_id AND r.kundennummer = v.kundennummer"""
_REGISTERED = """SELECT r.seq, r.username, CASE WHEN coalesce(r.username, '') = '' THEN 'MISSING_FIELD' WHEN n.seq IS NULL THEN 'TAKEN' ELSE 'OK' END AS code,
           e.kundennummer AS detail FROM user_req r LEFT JOIN new_users n ON r.seq = n.seq LEFT JOIN entered e ON e.username = n.username"""
_FILLED_STOCK = """SELECT s.barcode, s.name, menge, verfallsdatum, CASE WHEN o.barcode IS NULL THEN ort ELSE 'Automat' END AS ort,
           coalesce(o.detail, kanal) AS kanal
           FROM stock s LEFT JOIN (SELECT DISTINCT barcode, detail FROM fill_outcomes WHERE code = 'OK') o ON s.barcode = o.barcode"""
_RETURNED_STOCK = """SELECT s.barcode, s.name, menge, verfallsdatum, CASE WHEN o.barcode IS NULL THEN ort ELSE 'Lager' END AS ort,
           CASE WHEN o.barcode IS NULL THEN s.kanal END AS kanal
           FROM stock s LEFT JOIN (SELECT barcode FROM return_outcomes WHERE code = 'OK') o ON s.barcode = o.barcode"""
_CANCELLED_ORDERS = """SELECT * REPLACE (CASE WHEN (bestellgruppe_id, kundennummer) IN
             (SELECT (bestellgruppe_id, kundennummer) FROM verdicts WHERE NOT conflict) THEN 'Storniert' ELSE status END AS status)
           FROM bestellungen"""
_SET_ORDERS = """SELECT b.* REPLACE (coalesce(r.status, b.status) AS status) FROM bestellungen b
           LEFT JOIN (SELECT bestellgruppe_id, arg_max(status, seq) AS status FROM status_req GROUP BY bestellgruppe_id) r
           ON b.bestellgruppe_id = r.bestellgruppe_id"""
_REMOVED_STOCK = "SELECT * FROM stock WHERE barcode NOT IN (SELECT barcode FROM removal_outcomes WHERE code = 'OK')"
_INTAKE_STOCK = """SELECT * FROM stock UNION ALL
    SELECT barcode, detail, 1, CAST(verfallsdatum_raw AS DATE), 'Lager', NULL FROM intake_outcomes WHERE code = 'OK'"""
_RATE = """SELECT '{name}' AS vorgang, count(*) AS anzahl,
    CAST(count(*) FILTER (WHERE code = 'OK') AS DOUBLE) / count(*) * CAST(100 AS DOUBLE) AS erfolg,
    CAST(100 AS DOUBLE) - CAST(count(*) FILTER (WHERE code = 'OK') AS DOUBLE) / count(*) * CAST(100 AS DOUBLE) AS fehler FROM {table}"""
_LOGGED = "'2000-01-01 08:30:00' AS zeitstempel, 'Unbekannt' AS kundennummer"


def _snapshot_roundtrip(d: Domain):
    """A published removal followed by an intake that is staged but never published."""
    tables = Snapshots(d.spark, scratch_path(d.spark, "snapshots"))
    tables.create_if_absent()
    tables.commit({"stock": d.stock, "orders": d.bestellungen})
    stock, pieces = tables.near("stock", d.barcode_req)
    tables.commit({"stock": Rewrite(Removal(stock, d.barcode_req).stock, pieces)})
    stock, _ = tables.near("stock", d.intake_req)
    tables.stage({"stock": Append(Intake(stock, tables.read("orders"), d.intake_req, AS_OF).accepted)})
    return tables.read("stock")


def _bucketed_removal(d: Domain):
    """Removal from a stock that is stored in buckets."""
    tables = Snapshots(d.spark, scratch_path(d.spark, "snapshots"), buckets=16)
    tables.commit({"stock": d.stock})
    tables.commit({"stock": Removal(tables.read("stock"), d.barcode_req).stock})
    return tables.read("stock")


def _appended_log(d: Domain):
    path = scratch_path(d.spark, "log")
    action_log.append_log(d.action_log, path)
    action_log.append_log(audit.audit_log("removal", removal(d).outcomes, AS_OF_TIME), path)
    return action_log.read_log(d.spark, path)


def _streamed_log(d: Domain):
    """The log, written as CSV, streamed into folders by day."""
    source, target, state = (scratch_path(d.spark, n) for n in ("csv", "days", "state"))
    action_log.append_log(d.action_log, source)
    log_ingest.ingest_log(action_log.stream_log(d.spark, source), target, state).awaitTermination()
    return log_ingest.read_ingested(d.spark, target)


def _running_mtbf(d: Domain):
    """The mean time carried on over three runs of a stream of the log."""
    source, target, state = (scratch_path(d.spark, n) for n in ("csv", "figures", "state"))
    part = F.pmod(F.xxhash64(*S.ACTION_LOG.names), F.lit(3))
    for i in range(3):
        action_log.append_log(d.action_log.where(part == i), source)
        running_figures.follow_failures(action_log.stream_log(d.spark, source), target, state).awaitTermination()
    return running_figures.running_mean_time(d.spark, target)


def _published_rates(d: Domain):
    """Rates of two streams as their snapshots publish them; removals come in three micro-batches."""
    tables = Snapshots(d.spark, scratch_path(d.spark, "snapshots"))
    tables.commit({"stock": d.stock, "users": d.users, "orders": d.bestellungen})
    stream = request_batches.RequestStream("removal", tables, request_batches.removal(), scratch_path(d.spark, "outcomes"))
    part = F.pmod(F.hash("barcode"), F.lit(3))  # all requests for a barcode in one, as their order counts
    for i in range(3):
        stream.apply(d.barcode_req.where(F.coalesce(part, F.lit(0)) == i), i)
    request_batches.RequestStream("registration", tables, request_batches.registration(), scratch_path(d.spark, "outcomes")).apply(d.user_req, 0)
    return request_batches.published_rates(tables)


def _daily_refresh(d: Domain):
    """Stored warnings refreshed on three days, with a removal of goods before the last."""
    tables = Snapshots(d.spark, scratch_path(d.spark, "snapshots"))
    tables.commit({"stock": d.stock, "warnings": d.warnungen})
    expiry.refresh_stored(tables, "1999-06-01")
    expiry.refresh_stored(tables, "1999-12-01")
    asked = d.barcode_req
    stock, pieces = tables.near("stock", asked)
    tables.commit({"stock": Rewrite(Removal(stock, asked).stock, pieces)})
    expiry.refresh_stored(tables, AS_OF)
    return tables.read("warnings")


def _compacted_log(d: Domain):
    """The log in four micro-batches, in no order of days, compacted after three of them and again at the end."""
    source, target, state = (scratch_path(d.spark, n) for n in ("csv", "days", "state"))
    part = F.pmod(F.xxhash64(*S.ACTION_LOG.names), F.lit(4))
    for i in range(4):
        action_log.append_log(d.action_log.where(part == i), source)
        log_ingest.ingest_log(action_log.stream_log(d.spark, source), target, state).awaitTermination()
        if i == 2:
            log_ingest.compact_days(d.spark, target)
    log_ingest.compact_days(d.spark, target, whole=True)
    log_ingest.drop_merged(d.spark, target)
    return log_ingest.read_ingested(d.spark, target)


def _streamed(d: Domain, operation: request_batches.Operation, requests: DataFrame, table: str):
    """Requests as a stream of files against snapshots; the table as it is afterwards."""
    source, root, out, state = (scratch_path(d.spark, n) for n in ("requests", "snapshots", "outcomes", "state"))
    requests.write.options(**COMPACT).parquet(source)
    tables = Snapshots(d.spark, root)
    tables.commit({"stock": d.stock, "orders": d.bestellungen, "users": d.users})
    stream = request_batches.RequestStream("requests", tables, operation, out)
    stream.start(d.spark.readStream.schema(requests.schema).parquet(source), state).awaitTermination()
    return tables.read(table)


def _cart_requests(d: Domain):
    """Carts and their lines in one table, as they come from the counter."""
    return d.carts.join(d.cart_lines, "cart_id", "left").select("cart_id", "line_no", "barcode", "kundennummer")


def all_outcomes(d: Domain):
    """The outcomes of all operations as they are kept: written once, tagged with the operation."""
    judged = {
        "intake": lambda: intake(d).outcomes, "removal": lambda: removal(d).outcomes, "fill": lambda: fill(d).outcomes,
        "return": lambda: give_back(d).outcomes, "cart": lambda: scans(d).outcomes, "checkout": lambda: checkout(d).outcomes,
        "cancellation": lambda: cancellation(d).outcomes,
    }
    return d.once("outcomes", lambda: reduce(DataFrame.unionByName, [
        f().select(F.lit(name).alias("vorgang"), "code") for name, f in judged.items()]))


def _cart_list(d: Domain):
    return stock_views.cart_list(scans(d).cart_lines)


# name: (Spark query, SQL body, further expressions of the SQL)
BATCHES = {
    "j1_intake_outcomes": (lambda d: intake(d).outcomes, "SELECT seq, barcode, code, detail FROM intake_outcomes", _INTAKE),
    "j1_intake_state": (lambda d: intake(d).stock, _INTAKE_STOCK, _INTAKE),
    "j2_removal_outcomes": (lambda d: removal(d).outcomes, "SELECT * FROM removal_outcomes", _REMOVAL),
    "j2_removal_state": (lambda d: removal(d).stock, _REMOVED_STOCK, _REMOVAL),
    "j3_fill_outcomes": (lambda d: fill(d).outcomes, "SELECT * FROM fill_outcomes", _FILL),
    "j3_fill_state": (
        lambda d: fill(d).stock,
        _FILLED_STOCK, _FILL),
    "j4_return_outcomes": (
        lambda d: give_back(d).outcomes,
        "SELECT seq, barcode, code, name, CASE WHEN code = 'OK' THEN kanal END AS detail FROM return_outcomes", _RETURN),
    "j4_return_state": (
        lambda d: give_back(d).stock,
        _RETURNED_STOCK, _RETURN),
    "j5_cart_outcomes": (lambda d: scans(d).outcomes, "SELECT * FROM scan_outcomes", _SCANS),
    "c7_cart_list": (
        _cart_list,
        """SELECT cart_id AS "Cart_id", barcode AS "Barcode", detail AS "Name", verfallsdatum AS "Verfallsdatum"
           FROM scan_outcomes WHERE code = 'OK'""", _SCANS),
    "j6_checkout_outcomes": (
        lambda d: checkout(d).outcomes,
        _CHECKED_OUT, _CHECKOUT),
    "j6_checkout_orders": (
        lambda d: checkout(d).orders, "SELECT * FROM bestellungen UNION ALL SELECT * FROM new_orders", _CHECKOUT),
    "j6_checkout_state": (
        lambda d: checkout(d).stock, "SELECT * FROM stock WHERE barcode NOT IN (SELECT barcode FROM owned)", _CHECKOUT),
    "j7_cancel_outcomes": (
        lambda d: cancellation(d).outcomes,
        _CANCELLED, _CANCEL),
    "j7_cancel_stock": (
        lambda d: cancellation(d).stock,
        """SELECT coalesce(s.barcode, b.barcode) AS barcode, CASE WHEN s.barcode IS NULL THEN b.name ELSE s.name END AS name,
           CAST(coalesce(menge, 0) + coalesce(n, 0) AS INTEGER) AS menge,
           CASE WHEN s.barcode IS NULL THEN DATE '2001-01-01' ELSE verfallsdatum END AS verfallsdatum,
           coalesce(ort, 'Lager') AS ort, kanal FROM stock s FULL JOIN back b ON s.barcode = b.barcode""", _CANCEL),
    "j7_cancel_orders": (
        lambda d: cancellation(d).orders,
        _CANCELLED_ORDERS, _CANCEL),
    "d6_restock": (
        lambda d: cancellation(d).returned_lines.groupBy("barcode").agg(F.count("*").alias("anzahl")),
        "SELECT barcode, n AS anzahl FROM back", _CANCEL),
    "j8_status_state": (
        lambda d: set_order_status(d.bestellungen, d.status_req),
        _SET_ORDERS, ""),
    "j9_users": (lambda d: registration(d).users, "SELECT * FROM users UNION ALL BY NAME SELECT * FROM entered",
                 "directory AS (SELECT * FROM users)," + _REGISTER),
    "j9_user_outcomes": (
        lambda d: registration(d).outcomes,
        _REGISTERED,
        "directory AS (SELECT * FROM users)," + _REGISTER),
    "j9_first_users": (lambda d: first_registration(d).users, "SELECT * FROM directory UNION ALL BY NAME SELECT * FROM entered",
                       "directory AS (SELECT * FROM users WHERE role <> 'admin')," + _REGISTER),
    "j10_users": (
        lambda d: remove_users(d.users, d.leaving),
        "SELECT * FROM users WHERE username NOT IN (SELECT username FROM leaving)", ""),
    "j11_daily_refresh": (_daily_refresh, "SELECT * FROM fresh", _REMOVAL + ", " + _REFRESHED.replace("FROM stock", f"FROM ({_REMOVED_STOCK})")),
    "j11_warnings": (lambda d: expiry.refresh_warnings(d.warnungen, d.stock, AS_OF), "SELECT * FROM fresh", _REFRESHED),

    "a7_log_append": (
        _appended_log,
        f"""SELECT * FROM action_log UNION ALL
            SELECT {_LOGGED}, '✅ Ware ' || barcode || ' entfernt.' FROM removal_outcomes WHERE code = 'OK'""", _REMOVAL),
    "a9_snapshot_commit": (_snapshot_roundtrip, _REMOVED_STOCK, _REMOVAL),
    "a9_bucketed_snapshot": (_bucketed_removal, _REMOVED_STOCK, _REMOVAL),
    "c9_answers_removal": (
        lambda d: audit.answers("removal", removal(d).outcomes),
        """SELECT *, CASE code WHEN 'OK' THEN '✅ Erfolg: Ware ' || barcode || ' entfernt.'
             WHEN 'BAD_BARCODE' THEN '🚫 Fehler: Ungültiger oder leerer Barcode!'
             WHEN 'NOT_FOUND' THEN '🚫 Fehler: Barcode ' || barcode || ' nicht im Lager gefunden!'
             ELSE '🚫 Fehler: Ware ' || barcode || ' ist im Automaten und kann nicht gelöscht werden!' END AS antwort
           FROM removal_outcomes""", _REMOVAL),
    "c9_answers_intake": (
        lambda d: audit.answers("intake", intake(d).outcomes),
        """SELECT seq, barcode, code, detail, CASE code WHEN 'OK' THEN '✅ Erfolg: ' || coalesce(detail, '') || ' hinzugefügt.'
             WHEN 'MISSING_FIELD' THEN '🚫 Fehler: Alle Felder müssen ausgefüllt sein!'
             WHEN 'BAD_BARCODE' THEN '🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.'
             WHEN 'IN_OPEN_ORDER' THEN '🚫 Fehler: Dieser Barcode ist in einer offenen Bestellung!'
             WHEN 'IN_STOCK' THEN '🚫 Fehler: Barcode ' || barcode || ' existiert bereits im Lager!'
             ELSE '⚠️ Fehler: Verfallsdatum ungültig oder Ware ist abgelaufen!' END AS antwort FROM intake_outcomes""", _INTAKE),
    "c9_answers_fill": (
        lambda d: audit.answers("fill", fill(d).outcomes),
        """SELECT seq, barcode, code, name, detail, CASE code
             WHEN 'OK' THEN '✅ Erfolg: Ware ' || coalesce(name, '') || ' wurde in den Automaten verschoben (Kanal: ' || detail || ').'
             WHEN 'EMPTY_BARCODE' THEN '🚫 Fehler: Barcode darf nicht leer sein!'
             WHEN 'BAD_BARCODE' THEN '🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.'
             WHEN 'NOT_FOUND' THEN '🚫 Fehler: Ware ' || barcode || ' nicht im Lagerbestand!'
             ELSE '🚫 Fehler: ' || coalesce(name, '') || ' (Barcode: ' || barcode || ') ist abgelaufen und kann nicht in den Automaten verschoben werden!'
             END AS antwort FROM fill_outcomes""", _FILL),
    "c9_answers_return": (
        lambda d: audit.answers("return", give_back(d).outcomes),
        """SELECT seq, barcode, code, name, CASE WHEN code = 'OK' THEN kanal END AS detail, CASE code
             WHEN 'OK' THEN '✅ Erfolg: Ware ' || barcode || ' aus Kanal ' || kanal || ' entfernt und zurück ins Lager gelegt.'
             WHEN 'EMPTY_BARCODE' THEN '🚫 Fehler: Barcode darf nicht leer sein!'
             WHEN 'BAD_BARCODE' THEN '🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.'
             ELSE '🚫 Fehler: Ware ' || barcode || ' nicht im Automaten!' END AS antwort FROM return_outcomes""", _RETURN),
    "c9_answers_cart": (
        lambda d: audit.answers("cart", scans(d).outcomes),
        """SELECT *, CASE code WHEN 'OK' THEN '✅ ' || coalesce(detail, '') || ' wurde dem Warenkorb hinzugefügt!'
             WHEN 'EMPTY_BARCODE' THEN '🚫 Fehler: Barcode darf nicht leer sein!'
             WHEN 'BAD_BARCODE' THEN '🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.'
             WHEN 'DUPLICATE' THEN '🚫 Fehler: Barcode ' || barcode || ' ist bereits im Warenkorb!'
             WHEN 'NOT_IN_DISPENSER' THEN '🚫 Fehler: Medikament ' || barcode || ' ist nicht im Automaten!'
             ELSE '⚠️ Fehler: ' || coalesce(detail, '') || ' (Barcode: ' || barcode || ') ist abgelaufen!' END AS antwort FROM scan_outcomes""", _SCANS),
    "c9_answers_checkout": (
        lambda d: audit.checkout_answers(checkout(d)),
        """SELECT o.*, n.namen, CASE code
             WHEN 'OK' THEN '✅ Bestellung ' || o.detail || ' erfolgreich aufgegeben mit Medikamenten: ' || coalesce(n.namen, '')
             WHEN 'NO_CUSTOMER' THEN '🚫 Fehler: Kundennummer darf nicht leer sein!'
             WHEN 'EMPTY_CART' THEN '🚫 Fehler: Warenkorb ist leer!'
             ELSE '🚫 Fehler: ' || coalesce(o.name, '') || ' (Barcode: ' || o.detail || ') ist nicht im Automaten und kann nicht bestellt werden!'
             END AS antwort
           FROM (""" + _CHECKED_OUT + """) o LEFT JOIN (
             SELECT CAST(bestellgruppe_id AS VARCHAR) AS detail, string_agg(name, ', ' ORDER BY id) AS namen FROM new_orders GROUP BY bestellgruppe_id) n
           ON o.code = 'OK' AND o.detail = n.detail""", _CHECKOUT),
    "c9_answers_cancellation": (
        lambda d: audit.answers("cancellation", cancellation(d).outcomes),
        """SELECT *, CASE code
             WHEN 'OK' THEN '✅ Bestellung ' || CAST(bestellgruppe_id AS VARCHAR) || ' storniert! Alle Medikamente wurden zurück ins Lager gelegt und als ''Storniert'' markiert.'
             WHEN 'MISSING_ARG' THEN '🚫 Fehler: Bestellgruppen-ID und Kundennummer dürfen nicht leer sein!'
             WHEN 'NOT_OPEN' THEN '🚫 Fehler: Bestellung nicht gefunden oder bereits bearbeitet!'
             ELSE '🚫 Fehler: Integritätsproblem beim Zurücklegen von ' || coalesce(name, '') || ' (Barcode: ' || detail || ')!' END AS antwort
           FROM (""" + _CANCELLED + ") o", _CANCEL),
    "c9_answers_registration": (
        lambda d: audit.answers("registration", registration(d).outcomes),
        """SELECT *, CASE code WHEN 'OK' THEN '✅ Erfolgreich registriert! Ihre Kundennummer: ' || detail
             WHEN 'MISSING_FIELD' THEN '⚠️ Bitte alle Felder ausfüllen!'
             ELSE '🚫 Fehler: Benutzername bereits vergeben! Bitte wählen Sie einen anderen.' END AS antwort
           FROM (""" + _REGISTERED + ") o", "directory AS (SELECT * FROM users)," + _REGISTER),
    "j12_return_log": (
        lambda d: audit.audit_log("return", give_back(d).outcomes, AS_OF_TIME),
        f"""SELECT {_LOGGED}, CASE code
              WHEN 'OK' THEN 'Automatenentfernung: ✅ Erfolg: Ware ' || barcode || ' aus Kanal ' || kanal || ' entfernt und zurück ins Lager gelegt.'
              ELSE 'Automatenentfernung: 🚫 Fehler: Ware ' || barcode || ' nicht im Automaten!' END AS aktion
            FROM return_outcomes WHERE code IN ('OK', 'NOT_IN_DISPENSER')""", _RETURN),
    "j12_cart_log": (
        lambda d: audit.audit_log("cart", scans(d).outcomes, AS_OF_TIME),
        f"""SELECT {_LOGGED}, CASE code WHEN 'OK' THEN '✅ Medikament ' || coalesce(detail, '') || ' (Barcode: ' || barcode || ') zum Warenkorb hinzugefügt'
              WHEN 'NOT_IN_DISPENSER' THEN '🚫 Fehler: Medikament ' || barcode || ' ist nicht im Automaten und kann nicht in den Warenkorb gelegt werden!'
              ELSE '⚠️ Fehler: ' || coalesce(detail, '') || ' (Barcode: ' || barcode || ') ist abgelaufen und kann nicht in den Warenkorb gelegt werden!' END AS aktion
            FROM scan_outcomes WHERE code IN ('OK', 'NOT_IN_DISPENSER', 'EXPIRED')""", _SCANS),
    "j12_registration_log": (
        lambda d: audit.audit_log("registration", registration(d).outcomes, AS_OF_TIME),
        f"""SELECT {_LOGGED}, CASE code WHEN 'OK' THEN '✅ Registrierung erfolgreich' ELSE '🚫 Registrierung fehlgeschlagen' END AS aktion
            FROM ({_REGISTERED}) o WHERE code IN ('OK', 'MISSING_FIELD')""", "directory AS (SELECT * FROM users)," + _REGISTER),
    "c9_log_text": (
        lambda d: audit.audit_log("intake", intake(d).outcomes, AS_OF_TIME),
        f"""SELECT {_LOGGED}, '📦 Medikament hinzugefügt: ' || detail || ' (Barcode: ' || barcode || ')' AS aktion
            FROM intake_outcomes WHERE code = 'OK'""", _INTAKE),
    "j12_fill_log": (
        lambda d: audit.audit_log("fill", fill(d).outcomes, AS_OF_TIME),
        f"""SELECT {_LOGGED}, CASE code WHEN 'OK' THEN 'Automatenzugabe: ✅ Erfolg: Ware ' || name || ' wurde in den Automaten verschoben (Kanal: ' || detail || ').'
              ELSE 'Automatenzugabe: 🚫 Fehler: Ware ' || barcode || ' nicht im Lagerbestand!' END AS aktion
            FROM fill_outcomes WHERE code IN ('OK', 'NOT_FOUND')""", _FILL),
    "j12_checkout_log": (
        lambda d: audit.checkout_log(checkout(d), AS_OF_TIME),
        """SELECT '2000-01-01 08:30:00' AS zeitstempel, kundennummer, '📦 Bestellung ' || CAST(bestellgruppe_id AS VARCHAR)
             || ' aufgegeben mit Medikamenten: ' || string_agg(name, ', ' ORDER BY id) AS aktion
           FROM new_orders GROUP BY bestellgruppe_id, kundennummer""", _CHECKOUT),
    "j12_cancel_log": (
        lambda d: audit.cancellation_log(cancellation(d), AS_OF_TIME),
        """SELECT '2000-01-01 08:30:00' AS zeitstempel, kundennummer, '📦 Bestellung ' || CAST(bestellgruppe_id AS VARCHAR)
             || ' storniert, Medikamente zurück ins Lager: ' || string_agg(name, ', ' ORDER BY id) AS aktion
           FROM open_lines JOIN verdicts v USING (bestellgruppe_id, kundennummer) WHERE NOT conflict GROUP BY bestellgruppe_id, kundennummer""", _CANCEL),
    "j12_status_log": (
        lambda d: audit.status_log(d.status_req, AS_OF_TIME),
        f"""SELECT {_LOGGED}, '📦 Bestellstatus für ID ' || CAST(bestellgruppe_id AS VARCHAR) || ' wurde auf ''' || status || ''' gesetzt.' AS aktion
            FROM status_req""", ""),
    "e9_outcome_rates": (
        lambda d: quality.outcome_rates(all_outcomes(d)),
        " UNION ALL ".join([
            _RATE.format(name="intake", table="intake_outcomes"), _RATE.format(name="removal", table="removal_outcomes"),
            _RATE.format(name="fill", table="fill_outcomes"), _RATE.format(name="return", table="return_outcomes"),
            _RATE.format(name="cart", table="scan_outcomes"), _RATE.format(name="checkout", table=f"({_CHECKED_OUT}) o"),
            _RATE.format(name="cancellation", table=f"({_CANCELLED}) o")]),
        ",\n".join([_INTAKE, _REMOVAL, _FILL, _RETURN, _SCANS, _CANCEL, _CHECKOUT])),
    "e9_published_rates": (
        _published_rates,
        " UNION ALL ".join([_RATE.format(name="removal", table="removal_outcomes"), _RATE.format(name="registration", table=f"({_REGISTERED}) o")]),
        "directory AS (SELECT * FROM users)," + _REGISTER + ", " + _REMOVAL),
    "e10_running_mtbf": (
        _running_mtbf,
        f"""SELECT count(*) AS ausfaelle, CAST(date_diff('second', min(t), max(t)) AS DOUBLE) / CAST(3600 AS DOUBLE) / (count(*) - 1) AS mtbf_stunden
           FROM (SELECT CAST(zeitstempel AS TIMESTAMP) AS t FROM action_log WHERE {_CRITICAL}) f""", ""),
    "e9_outcome_counts": (
        lambda d: quality.outcome_counts(scans(d).outcomes), "SELECT code, count(*) AS anzahl FROM scan_outcomes GROUP BY code", _SCANS),

    "l1_log_ingest": (
        _streamed_log,
        "SELECT *, CAST(zeitstempel AS TIMESTAMP) AS ts, CAST(substring(zeitstempel, 1, 10) AS DATE) AS tag FROM action_log", ""),
    "l1_log_compaction": (
        _compacted_log,
        "SELECT *, CAST(zeitstempel AS TIMESTAMP) AS ts, CAST(substring(zeitstempel, 1, 10) AS DATE) AS tag FROM action_log", ""),
    "k5_log_review_by_day": (
        lambda d: log_views.log_review_stored(_compacted_log(d), "2024-01-15", "06:00:00", "18:00:00"),
        """SELECT zeitstempel AS "Zeitstempel", kundennummer AS "Benutzer", aktion AS "Aktion"
           FROM action_log WHERE zeitstempel BETWEEN '2024-01-15 06:00:00' AND '2024-01-15 18:00:00'""", ""),
    "l2_intake_stream": (
        lambda d: _streamed(d, request_batches.intake(AS_OF), d.intake_req, "stock"), _INTAKE_STOCK, _INTAKE),
    "l2_removal_stream": (
        lambda d: _streamed(d, request_batches.removal(), d.barcode_req, "stock"), _REMOVED_STOCK, _REMOVAL),
    "l2_fill_stream": (
        lambda d: _streamed(d, request_batches.fill(AS_OF), d.barcode_req, "stock"), _FILLED_STOCK, _FILL),
    "l2_return_stream": (
        lambda d: _streamed(d, request_batches.give_back(), d.barcode_req, "stock"), _RETURNED_STOCK, _RETURN),
    "l2_checkout_stream": (
        lambda d: _streamed(d, request_batches.checkout(AS_OF_TIME), _cart_requests(d), "orders"),
        "SELECT * FROM bestellungen UNION ALL SELECT * FROM new_orders", _CHECKOUT),
    "l2_cancellation_stream": (
        lambda d: _streamed(d, request_batches.cancellation(AS_OF), d.cancel_req, "orders"), _CANCELLED_ORDERS, _CANCEL),
    "l2_registration_stream": (
        lambda d: _streamed(d, request_batches.registration(), d.user_req, "users"),
        "SELECT * FROM directory UNION ALL BY NAME SELECT * FROM entered", "directory AS (SELECT * FROM users)," + _REGISTER),
    "l2_user_removal_stream": (
        lambda d: _streamed(d, request_batches.user_removal(), d.leaving, "users"),
        "SELECT * FROM users WHERE username NOT IN (SELECT username FROM leaving)", ""),
    "l2_status_stream": (
        lambda d: _streamed(d, request_batches.status_change(), d.status_req, "orders"), _SET_ORDERS, ""),
}
