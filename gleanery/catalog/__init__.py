"""Registered queries over the driver's tables, each next to the SQL that must give the same rows."""

from . import business, cleaning, encoding, learning, profiling, registry, storage, words  # noqa: F401

queries = registry.queries
oracle_sql = registry.oracle_sql
