"""All queries of the library's own operators, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxframe.operators import analysis, captured, codec, config, dsp, flows, gates, receiver, routes, spectrum, validate

MODULES = [captured, flows, routes, validate, config, dsp, spectrum, codec, gates, receiver, analysis]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
