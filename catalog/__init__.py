"""Registered queries over the given tables, each with its SQL check."""

from catalog import (  # noqa: F401
    cleaning,
    columns,
    filters,
    forecasts,
    grouped,
    linked,
    profiles,
    scores,
    stories,
    tables,
    timeline,
)
from catalog.registry import QUERIES, SQL  # noqa: F401
