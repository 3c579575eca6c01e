"""Named queries over the driver tables, each with the SQL that checks it."""

from gridwake.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
