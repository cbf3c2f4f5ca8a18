"""The registered queries, by name, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Fragments of oracle SQL


def sql_number(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(CAST(CAST({x} AS DECIMAL(38,9)) AS VARCHAR), '0'), '.') END)"


def sql_date(x: str) -> str:
    return f"strftime(make_timestamp({x} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


def sql_duration(x: str) -> str:
    a = f"abs({x})"
    d, h, m, s = f"({a} // 86400)", f"({a} % 86400 // 3600)", f"({a} % 3600 // 60)", f"({a} % 60)"
    parts = [f"CASE WHEN {d} > 0 THEN {d} || 'd' END", f"CASE WHEN {h} > 0 OR ({d} > 0 AND {m} > 0) THEN {h} || 'h' END", f"CASE WHEN {m} > 0 OR ({h} > 0 AND {s} > 0) THEN {m} || 'm' END", f"CASE WHEN {s} > 0 OR {a} < 60 THEN {s} || 's' END"]
    return f"(CASE WHEN {x} = 0 THEN '0s' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || concat_ws(' ', {', '.join(parts)}) END)"


def sql_value(n: str = "") -> str:
    return f"(CASE {n}value_kind WHEN 'NUMBER' THEN {sql_number(n + 'number_val')} WHEN 'DATE' THEN {sql_date(n + 'date_secs')} ELSE {sql_duration(n + 'duration_secs')} END)"


def sql_xsd(x: str) -> str:
    a = f"abs({x})"
    part = lambda e, u: f"CASE WHEN {e} > 0 THEN {e} || '{u}' ELSE '' END"
    time = f"CASE WHEN {a} % 86400 > 0 THEN 'T' || {part(f'({a} % 86400 // 3600)', 'H')} || {part(f'({a} % 3600 // 60)', 'M')} || {part(f'({a} % 60)', 'S')} ELSE '' END"
    return f"(CASE WHEN {x} = 0 THEN 'PT0S' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || 'P' || {part(f'({a} // 86400)', 'D')} || {time} END)"


def sql_digest(prefix: str, *fields: str) -> str:
    return f"('{prefix}' || substr(sha256(concat_ws(chr(31), {', '.join(fields)})), 1, 32))"
