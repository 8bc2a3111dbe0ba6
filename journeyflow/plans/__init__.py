"""Query catalogue: one Spark query per operator id, plus an independent DuckDB oracle."""

from journeyflow.plans.registry import QUERIES, ORACLES, all_queries, all_oracles  # noqa: F401
