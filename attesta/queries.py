"""Every query over the driver's tables, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.plans import code_plans, measure_plans, proof_plans, record_plans, report_plans, span_plans, string_plans, text_plans

_PLANS = (text_plans, proof_plans, report_plans, string_plans, span_plans, measure_plans, record_plans, code_plans)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for p in _PLANS for name, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for p in _PLANS for name, sql in p.ORACLE_SQL.items()}
