"""Every operator as a query over the driver tables, with its SQL twin."""

from . import history_queries, ingest_queries, model_queries, report_queries  # noqa: F401  (they register themselves)
from .registry import FITTING, ORACLES, QUERIES

__all__ = ["FITTING", "ORACLES", "QUERIES"]
