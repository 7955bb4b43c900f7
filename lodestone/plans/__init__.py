"""Every registered query of the library and its oracle."""

from . import records, relational, retrieval, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "records", "relational", "retrieval", "texts"]
