"""Batch operators: tables and requests in, new tables and one outcome per request out."""
