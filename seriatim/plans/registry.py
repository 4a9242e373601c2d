"""All queries of the core package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriatim.plans import analyses, core, exposures, inference, retrieval, scores

AREAS = (core, exposures, scores, inference, retrieval, analyses)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {k: v for area in AREAS for k, v in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for area in AREAS for k, v in area.ORACLE.items()}
