"""Registered hypergraph queries (``QUERIES``) and their DuckDB equivalents (``ORACLE_SQL``)."""

from loomgraph.queries import algorithms, changes, lookups, shapes

MODULES = (lookups, shapes, algorithms, changes)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
