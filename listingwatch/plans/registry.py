"""Every registered query of the listing pipeline, with its SQL where there is one."""

from . import carrying, covering, naming, queries, reviewing, storing, streams, walking, watching

MODULES = (queries, watching, reviewing, covering, streams, walking, carrying, storing, naming)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
