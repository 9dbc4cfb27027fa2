"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone import artifact_queries as artifacts
from siltstone import chain_queries as chains
from siltstone import gate_queries as gates
from siltstone import integrity_queries as integrity
from siltstone import output_queries as outputs
from siltstone import queries as tables
from siltstone import record_queries as records
from siltstone import report_queries as reports
from siltstone import template_queries as templates
from siltstone import tool_queries as tools

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """All queries by name."""
    return tables.QUERIES | templates.QUERIES | gates.QUERIES | tools.QUERIES | records.QUERIES | reports.QUERIES | integrity.QUERIES | artifacts.QUERIES | chains.QUERIES | outputs.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return tables.SQL | templates.SQL | tools.SQL | records.SQL | reports.SQL | integrity.SQL | artifacts.SQL | chains.SQL | outputs.SQL | {"gate_decisions": gates.SQL}
