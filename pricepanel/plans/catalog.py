"""Imports every query module; the catalogue is complete afterwards."""

from pricepanel.plans import (  # noqa: F401
    dispatch_queries,
    forecast_queries,
    metric_queries,
    panel_queries,
    source_queries,
    stream_queries,
)
from pricepanel.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
