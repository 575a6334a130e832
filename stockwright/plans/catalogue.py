"""Every query of the library by name, with the SQL that states its result."""

from stockwright.plans import builds, entities, lookups, prices, streams, votes

_MODULES = (lookups, prices, builds, votes, entities, streams)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
