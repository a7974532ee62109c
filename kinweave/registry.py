"""All queries of the library by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from kinweave.plans import codecs, draws, fitting, model, relational, siblings, sources, synthesis  # noqa: F401
from kinweave.plans.relational import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
