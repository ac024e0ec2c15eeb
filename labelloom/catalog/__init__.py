"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from labelloom.catalog import (
    folds,
    labels,
    losses,
    metrics,
    neighbours,
    stores,
    terms,
    texts,
)
from labelloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "folds", "labels", "losses", "metrics", "neighbours", "stores", "terms", "texts"]
