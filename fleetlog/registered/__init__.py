"""Every operator as a query on the test tables, with the SQL that must give the same rows."""

from fleetlog.registered import live, relational, rows, scoring, tables, text, windows  # noqa: F401
from fleetlog.registered.core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
