"""Registered queries, each with the SQL that must give the same rows."""

from checks.base import REGISTRY  # noqa: F401
from checks import (  # noqa: F401
    aggregates, cleaning, distributions, features, rasters, risks, scores, sinks, spatial,
)
