"""Registered queries: Spark plans over the driver tables plus DuckDB oracle SQL."""

from featlens.plans.registry import REGISTRY, oracle_queries, spark_queries  # noqa: F401


def load_all() -> None:
    """Import every query module so its registrations run."""
    from featlens.plans import (assoc_queries, feature_queries, model_queries, moment_queries, profile_queries,  # noqa: F401
                                rate_queries, table_queries)
