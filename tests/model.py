"""What the operators must equal: requests handled one after another on plain Python tables."""

from __future__ import annotations

import datetime as dt
import re
from copy import deepcopy
from dataclasses import dataclass, field


def is_barcode(text):
    return text is not None and re.fullmatch("[0-9]{8,13}", text, re.ASCII) is not None


def as_date(text):
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        return None


@dataclass
class Shop:
    """One place with its tables; every method handles one request and returns (code, detail)."""

    today: dt.date
    now: dt.datetime = dt.datetime(2000, 1, 1, 8, 30)
    stock: dict = field(default_factory=dict)       # barcode -> [name, menge, verfallsdatum, ort, kanal]
    orders: list = field(default_factory=list)      # [id, gruppe, kunde, barcode, name, datum, status]
    users: dict = field(default_factory=dict)       # username -> [id, kundennummer, role]
    warnings: dict = field(default_factory=dict)    # barcode -> [name, verfallsdatum, ort, status]

    def take_in(self, barcode, name, raw, place):
        if not barcode or not name or not raw:
            return "MISSING_FIELD"
        if not is_barcode(barcode):
            return "BAD_BARCODE"
        if any(o[3] == barcode and o[6] == "Offen" for o in self.orders):
            return "IN_OPEN_ORDER"
        if barcode in self.stock:
            return "IN_STOCK"
        day = as_date(raw)
        if day is None or day <= self.today:
            return "BAD_EXPIRY"
        self.stock[barcode] = [name, 1, day, place or "Lager", None]
        return "OK"

    def remove(self, barcode):
        if not is_barcode(barcode):
            return "BAD_BARCODE"
        if barcode not in self.stock:
            return "NOT_FOUND"
        if self.stock[barcode][3] == "Automat":
            return "IN_DISPENSER"
        del self.stock[barcode]
        return "OK"

    def fill(self, barcode):
        if not barcode:
            return "EMPTY_BARCODE", None
        if not is_barcode(barcode):
            return "BAD_BARCODE", None
        if barcode not in self.stock:
            return "NOT_FOUND", None
        row = self.stock[barcode]
        if row[2] is None or row[2] < self.today:
            return "EXPIRED", None
        dispenser = [r for r in self.stock.values() if r[3] == "Automat" and r[4]]
        same = sorted(int(r[4][6:]) for r in dispenser if r[0] == row[0])
        if same:
            channel = same[0]
        else:
            used = {r[4] for r in dispenser}
            channel = 1
            while f"Kanal {channel}" in used:
                channel += 1
        row[3], row[4] = "Automat", f"Kanal {channel}"
        return "OK", row[4]

    def give_back(self, barcode):
        if not barcode:
            return "EMPTY_BARCODE", None
        if not is_barcode(barcode):
            return "BAD_BARCODE", None
        row = self.stock.get(barcode)
        if row is None or row[3] != "Automat":
            return "NOT_IN_DISPENSER", None
        channel = row[4]
        row[3], row[4] = "Lager", None
        return "OK", channel

    def scan(self, cart, barcode):
        """``cart`` is the set of barcodes already in the cart."""
        if not barcode:
            return "EMPTY_BARCODE"
        if not is_barcode(barcode):
            return "BAD_BARCODE"
        if barcode in cart:
            return "DUPLICATE"
        row = self.stock.get(barcode)
        if row is None or row[3] != "Automat":
            return "NOT_IN_DISPENSER"
        if row[2] is None or row[2] < self.today:
            return "EXPIRED"
        cart.add(barcode)
        return "OK"

    def check_out(self, customer, barcodes):
        if not customer:
            return "NO_CUSTOMER", None
        if not barcodes:
            return "EMPTY_CART", None
        gone = [b for b in barcodes if b not in self.stock or self.stock[b][3] != "Automat"]
        twice = [b for b in barcodes if barcodes.count(b) > 1]
        if gone or twice:
            return "LINE_UNAVAILABLE", (gone or twice)[0]
        group = max([o[1] for o in self.orders] + [99999]) + 1
        for b in barcodes:
            number = max([o[0] for o in self.orders] + [0]) + 1
            self.orders.append([number, group, customer, b, self.stock.pop(b)[0], self.now, "Offen"])
        return "OK", str(group)

    def cancel(self, group, customer):
        if not group or not customer:
            return "MISSING_ARG", None
        lines = sorted(o for o in self.orders if o[1] == group and o[2] == customer and o[6] == "Offen")
        if not lines:
            return "NOT_OPEN", None
        before = deepcopy(self.stock)
        for line in lines:
            row = self.stock.get(line[3])
            if row is None:
                later = self.today.replace(year=self.today.year + 1)
                self.stock[line[3]] = [line[4], 1, later, "Lager", None]
            elif row[3] == "Lager":
                row[1] += 1
            else:
                self.stock = before
                return "CONFLICT", line[3]
        for o in self.orders:
            if o[1] == group and o[2] == customer:
                o[6] = "Storniert"
        return "OK", str(len(lines))

    def set_status(self, group, status):
        for o in self.orders:
            if o[1] == group:
                o[6] = status

    def register(self, username, role):
        if not username:
            return "MISSING_FIELD", None
        if username in self.users:
            return "TAKEN", None
        if not any(u[2] == "admin" for u in self.users.values()):
            role = "admin"
        known = [u[1] for u in self.users.values()] + [o[2] for o in self.orders]
        number = max([int(k) for k in known if k.isdigit()] + [9999999]) + 1
        self.users[username] = [max([u[0] for u in self.users.values()] + [0]) + 1, str(number), role or "user"]
        return "OK", str(number)

    def refresh_warnings(self):
        for barcode in [b for b in self.warnings if b not in self.stock]:
            del self.warnings[barcode]
        for barcode, (name, _, day, place, _) in self.stock.items():
            if day is not None and day < self.today:
                if barcode in self.warnings:
                    self.warnings[barcode][2:] = [place, "Medikament abgelaufen"]
                else:
                    self.warnings[barcode] = [name, day, place, "Medikament abgelaufen"]
