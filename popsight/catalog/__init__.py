"""Registered queries: name -> Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.frequencies import Frequencies, frequencies
from ..plans.store import stored
from ..sources.tables import persons as _persons
from ..sources.tables import persons_sql

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


_INPUTS: dict = {}


def persons_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``persons`` as the queries' stored input: derived from the driver
    tables once per session and written as Parquet into the session's shared
    folder, the way the survey's raw table sits on disk. Queries read
    the columns they need of all its rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INPUTS:
        _INPUTS[key] = stored(_persons(spark, sf_dir), "persons")
    return _INPUTS[key]


def persons_frequencies(spark: SparkSession, sf_dir: str) -> Frequencies:
    """The frequency table of ``persons_input``, made once per session and shared by
    the queries that ask for values (A1, A6, M1, P4)."""
    key = (spark.sparkContext.applicationId, sf_dir, "frequencies")
    if key not in _INPUTS:
        _INPUTS[key] = frequencies(persons_input(spark, sf_dir))
    return _INPUTS[key]


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with an optional oracle."""
    def deco(fn: Query) -> Query:
        if name in _QUERIES:
            raise KeyError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def oracles_so_far() -> dict[str, str]:
    """Oracle texts of the catalog modules imported up to now."""
    return _ORACLES


def queries_so_far() -> dict[str, Query]:
    """Queries of the catalog modules imported up to now."""
    return _QUERIES


def sql_with(*ctes: tuple[str, str], select: str) -> str:
    """``WITH persons AS (...), <ctes> <select>`` for the DuckDB oracle."""
    parts = [f"persons AS ({persons_sql()})"] + [f"{n} AS ({q})" for n, q in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select


def sql_chain(query: str) -> str:
    """Put ``persons`` in front of a query: a leading ``WITH`` is merged into
    the same CTE list."""
    body = query.strip()
    if body.upper().startswith("WITH "):
        return f"WITH persons AS ({persons_sql()}),\n" + body[5:]
    return sql_with(select=body)


def _load():
    # Import for side effects (registration), in inventory order.
    from . import (threshold, missing, project, profile, correlate,  # noqa: F401
                   encode, evaluate, segment, model, io, raw_layout, gaps, trees, report)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
