"""All queries of the engine, with their SQL twins."""

from ledgerloom.queries import evaluation, linking, relational, reports, texts  # noqa: F401
from ledgerloom.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
