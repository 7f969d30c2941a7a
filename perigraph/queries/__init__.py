"""Registered queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

from . import comparing, filing, fitting, graphs, physical, selection

MODULES = [filing, selection, graphs, fitting, physical, comparing]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
