"""Every registered query of the engine and, where SQL can express it, its SQL."""

from .plans import admission, aggregates, captures, discovery, evidence, identity, imports, joins, layouts, pages, quality, report, review, scalars, sheets, streams, windows, wording  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
