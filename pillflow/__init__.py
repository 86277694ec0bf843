"""Medication stock, dispenser, order, expiry and audit-log analytics on Spark."""
