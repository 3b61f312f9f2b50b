"""One query per operator, with the SQL that gives the same rows.

The driver's tables hold no Chinese text, so most queries make theirs from key columns, by expressions that Spark and
DuckDB read alike.
"""

from cloakwork.queries import documents, layers, mappings, pages, restoring

_MODULES = (documents, layers, mappings, pages, restoring)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
