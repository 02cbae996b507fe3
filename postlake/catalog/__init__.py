"""Registered queries: each runs one operator over whole driver tables, with its SQL twin."""

from postlake.catalog import base, jobs, records, stored, tables, texts  # noqa: F401

QUERIES = base.QUERIES
SQL = base.SQL
