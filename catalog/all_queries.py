"""Importing this module registers everything."""

from catalog import (  # noqa: F401
    asof_queries,
    evaluation_queries,
    feature_queries,
    history_queries,
    learned_queries,
    portfolio_queries,
    quality_queries,
    storage_queries,
    wallet_queries,
)
from catalog.registry import ORACLES, QUERIES  # noqa: F401
