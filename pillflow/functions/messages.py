"""Texts shown and logged for an outcome.

The texts are stored in the action log and searched for later, so they are data. ``{...}`` stands for a column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the user is told, per operation and outcome code.
ANSWERS = {
    "intake": {
        "OK": "✅ Erfolg: {detail} hinzugefügt.",
        "MISSING_FIELD": "🚫 Fehler: Alle Felder müssen ausgefüllt sein!",
        "BAD_BARCODE": "🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.",
        "IN_OPEN_ORDER": "🚫 Fehler: Dieser Barcode ist in einer offenen Bestellung!",
        "IN_STOCK": "🚫 Fehler: Barcode {barcode} existiert bereits im Lager!",
        "BAD_EXPIRY": "⚠️ Fehler: Verfallsdatum ungültig oder Ware ist abgelaufen!",
    },
    "removal": {
        "OK": "✅ Erfolg: Ware {barcode} entfernt.",
        "BAD_BARCODE": "🚫 Fehler: Ungültiger oder leerer Barcode!",
        "NOT_FOUND": "🚫 Fehler: Barcode {barcode} nicht im Lager gefunden!",
        "IN_DISPENSER": "🚫 Fehler: Ware {barcode} ist im Automaten und kann nicht gelöscht werden!",
    },
    "fill": {
        "OK": "✅ Erfolg: Ware {name} wurde in den Automaten verschoben (Kanal: {detail}).",
        "EMPTY_BARCODE": "🚫 Fehler: Barcode darf nicht leer sein!",
        "BAD_BARCODE": "🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.",
        "NOT_FOUND": "🚫 Fehler: Ware {barcode} nicht im Lagerbestand!",
        "EXPIRED": "🚫 Fehler: {name} (Barcode: {barcode}) ist abgelaufen und kann nicht in den Automaten verschoben werden!",
    },
    "return": {
        "OK": "✅ Erfolg: Ware {barcode} aus Kanal {detail} entfernt und zurück ins Lager gelegt.",
        "EMPTY_BARCODE": "🚫 Fehler: Barcode darf nicht leer sein!",
        "BAD_BARCODE": "🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.",
        "NOT_IN_DISPENSER": "🚫 Fehler: Ware {barcode} nicht im Automaten!",
    },
    "cart": {
        "OK": "✅ {detail} wurde dem Warenkorb hinzugefügt!",
        "EMPTY_BARCODE": "🚫 Fehler: Barcode darf nicht leer sein!",
        "BAD_BARCODE": "🚫 Fehler: Ungültiger Barcode! Er muss 8-13 Ziffern enthalten.",
        "DUPLICATE": "🚫 Fehler: Barcode {barcode} ist bereits im Warenkorb!",
        "NOT_IN_DISPENSER": "🚫 Fehler: Medikament {barcode} ist nicht im Automaten!",
        "EXPIRED": "⚠️ Fehler: {detail} (Barcode: {barcode}) ist abgelaufen!",
    },
    "checkout": {
        "OK": "✅ Bestellung {detail} erfolgreich aufgegeben mit Medikamenten: {namen}",
        "NO_CUSTOMER": "🚫 Fehler: Kundennummer darf nicht leer sein!",
        "EMPTY_CART": "🚫 Fehler: Warenkorb ist leer!",
        "LINE_UNAVAILABLE": "🚫 Fehler: {name} (Barcode: {detail}) ist nicht im Automaten und kann nicht bestellt werden!",
    },
    "cancellation": {
        "OK": "✅ Bestellung {bestellgruppe_id} storniert! Alle Medikamente wurden zurück ins Lager gelegt und als 'Storniert' markiert.",
        "MISSING_ARG": "🚫 Fehler: Bestellgruppen-ID und Kundennummer dürfen nicht leer sein!",
        "NOT_OPEN": "🚫 Fehler: Bestellung nicht gefunden oder bereits bearbeitet!",
        "CONFLICT": "🚫 Fehler: Integritätsproblem beim Zurücklegen von {name} (Barcode: {detail})!",
    },
    "registration": {
        "MISSING_FIELD": "⚠️ Bitte alle Felder ausfüllen!",
        "OK": "✅ Erfolgreich registriert! Ihre Kundennummer: {detail}",
        "TAKEN": "🚫 Fehler: Benutzername bereits vergeben! Bitte wählen Sie einen anderen.",
    },
}

# What goes into the action log; an outcome that is not listed leaves no entry.
# ``{antwort}`` stands for the answer above.
LOG_TEXTS = {
    "intake": {"OK": "📦 Medikament hinzugefügt: {detail} (Barcode: {barcode})"},
    "removal": {"OK": "✅ Ware {barcode} entfernt."},
    "fill": {
        "OK": "Automatenzugabe: {antwort}",
        "NOT_FOUND": "Automatenzugabe: {antwort}",
    },
    "return": {
        "OK": "Automatenentfernung: {antwort}",
        "NOT_IN_DISPENSER": "Automatenentfernung: {antwort}",
    },
    "cart": {
        "OK": "✅ Medikament {detail} (Barcode: {barcode}) zum Warenkorb hinzugefügt",
        "NOT_IN_DISPENSER": "🚫 Fehler: Medikament {barcode} ist nicht im Automaten und kann nicht in den Warenkorb gelegt werden!",
        "EXPIRED": "⚠️ Fehler: {detail} (Barcode: {barcode}) ist abgelaufen und kann nicht in den Warenkorb gelegt werden!",
    },
    "checkout": {"OK": "📦 Bestellung {detail} aufgegeben mit Medikamenten: {namen}"},
    "cancellation": {"OK": "📦 Bestellung {bestellgruppe_id} storniert, Medikamente zurück ins Lager: {namen}"},
    "status": {"OK": "📦 Bestellstatus für ID {bestellgruppe_id} wurde auf '{status}' gesetzt."},
    "registration": {
        "OK": "✅ Registrierung erfolgreich",
        "MISSING_FIELD": "🚫 Registrierung fehlgeschlagen",
    },
}

_HOLE = re.compile(r"\{(\w+)\}")


def fill_in(template: str, columns: list[str], **given: Column) -> Column:
    """The template with its holes replaced by columns; NULL leaves a blank, a column that is not there is an error."""
    pieces = []
    for i, piece in enumerate(_HOLE.split(template)):
        if i % 2 == 0:
            pieces.append(F.lit(piece))
        elif piece in given:
            pieces.append(given[piece])
        elif piece in columns:
            pieces.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
        else:
            raise ValueError(f"no column for {{{piece}}} among {columns}")
    return F.concat(*pieces)


def _by_code(texts: dict[str, str], columns: list[str], **given: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for code, template in texts.items():
        chosen = F.when(F.col("code") == code, fill_in(template, columns, **given)).otherwise(chosen)
    return chosen


def answer(operation: str, columns: list[str]) -> Column:
    """Text for the user, from ``code`` and the other outcome columns."""
    return _by_code(ANSWERS[operation], columns)


def log_text(operation: str, columns: list[str]) -> Column:
    """Text for the action log, NULL where nothing is logged."""
    texts = LOG_TEXTS[operation]
    told = any("{antwort}" in text for text in texts.values())
    return _by_code(texts, columns, **({"antwort": answer(operation, columns)} if told else {}))
