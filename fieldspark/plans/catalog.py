"""All queries and their SQL."""

from . import curation, database, fields, meshes, reducers, rollouts, sessions, surfaces, tables, tensors  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
