"""One query per operator over the shared test tables, each with its SQL where SQL can say it."""

from . import detection, lookups, parsing, rollups, streams, triage

MODULES = (detection, lookups, parsing, rollups, streams, triage)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
