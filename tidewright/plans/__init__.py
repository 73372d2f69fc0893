"""The registered queries: each operator over whole tables, with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import documents, scenarios


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scenarios.QUERIES | documents.QUERIES


def oracles() -> dict[str, str]:
    return scenarios.ORACLES | documents.ORACLES
