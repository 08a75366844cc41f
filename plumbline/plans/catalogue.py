"""All queries of the library, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from plumbline.plans import embedding, ingesting, judging, pressing, probing, regioning, splitting  # noqa: F401  (each registers its queries)
from plumbline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
