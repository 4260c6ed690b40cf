"""All queries by operator, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans import q_kpi, q_models, q_population, q_probes, q_relational, q_schema, q_sequences

MODULES = [q_sequences, q_population, q_schema, q_kpi, q_relational, q_probes, q_models]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= module.SQL
    return out
