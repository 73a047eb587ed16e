"""All queries over recordings and job tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cliploom.plans import jobtables, recordings, streams
from cliploom.plans.fixtures import Views

_ALL = recordings.QUERIES | jobtables.QUERIES | streams.QUERIES


def _run(query: Callable[[Views], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, query) for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ALL.items() if text}
