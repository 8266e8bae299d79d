"""Every registered query of the engine, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, evidence, excerpts, investigations, origins, places, research, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (investigations, texts, events, evidence, origins, research, places, excerpts):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
