"""Registered queries: one Spark plan per SURVEY operator, plus its DuckDB oracle.

Each plan module registers ``(spark, sf_dir) -> DataFrame`` callables with
``@query(name, sql)``.  ``sql`` is an independent DuckDB statement over the
raw tables (or ``None`` when the operator is not SQL-expressible).  Double
columns are rounded to 9 decimals on both sides so that the order in which
floating sums were added cannot change the value hash.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_MODULES = ("evaluate_q", "label_q", "quality_q", "drift_q", "relate_q", "outlier_q",
            "prep_q", "sample_q", "report_q", "functions_q", "neighbours_q", "models_q",
            "sources_q", "streaming_q", "audit_q")


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"flowlab.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"flowlab.plans.{m}":
                raise


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_ORACLES.items()))


def finish(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (and fold -0.0 into 0.0) for stable hashing."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def rounded(sql: str, *double_cols: str, digits: int = 9) -> str:
    """Wrap a DuckDB statement so the named double columns are rounded like ``finish``."""
    if not double_cols:
        return sql
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"
