"""The registered queries and the SQL they are checked against."""

from flowlens.catalog import (  # noqa: F401
    cleaning_queries,
    evaluation_queries,
    feature_queries,
    label_queries,
    model_queries,
    profile_queries,
    sampling_queries,
    source_queries,
)
from flowlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
