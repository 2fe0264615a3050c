"""One registered query per operator, each with the SQL that must give the same rows."""

from . import counts, days, scans, slices, syncs, synthesis, writes  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
