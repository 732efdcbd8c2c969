"""Named queries over the given tables, each with the SQL a second engine can run."""

from launchgrid.catalog import (  # noqa: F401
    calendar_queries, calibration_queries, feature_queries, market_queries, metric_queries,
    output_queries, window_queries,
)
from launchgrid.catalog.base import CATALOG

__all__ = ["CATALOG"]
