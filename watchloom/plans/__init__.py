"""Named queries. Importing this package registers all of them."""

from watchloom.plans import basics, detections, mapping, reports, runs, search, storage  # noqa: F401
from watchloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
