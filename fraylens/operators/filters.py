"""Declarative predicates: criteria lists, tenant filter, time ranges, boolean trees."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v, "ge": lambda c, v: c >= v, "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)),
    "like": lambda c, v: c.like(v), "contains": lambda c, v: c.contains(v),
}


def criterion(field: str, operator: str, value: Any, allowed: Sequence[str]) -> Column:
    if field not in allowed:
        raise ValueError(f"unknown field {field!r}")
    if operator not in COMPARE:
        raise ValueError(f"unknown operator {operator!r}")
    return COMPARE[operator](F.col(field), value)


def where(df: DataFrame, criteria: Sequence[tuple[str, str, Any]]) -> DataFrame:
    """Keep rows that meet every (field, operator, value)."""
    tests = [criterion(f, o, v, df.columns) for f, o, v in criteria]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def tree(node: Mapping[str, Any], allowed: Sequence[str]) -> Column:
    """Column of a nested search: {"and"|"or": [...]}, {"not": node} or a leaf
    {"field", "operator", "value", "case_sensitive"}."""
    for word, joined in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in node:
            return reduce(joined, [tree(n, allowed) for n in node[word]])
    if "not" in node:
        return ~tree(node["not"], allowed)
    field, value, op = node["field"], node["value"], node.get("operator", "eq")
    if field not in allowed:
        raise ValueError(f"unknown field {field!r}")
    column = F.col(field)
    if not node.get("case_sensitive", True):
        column = F.lower(column)
        value = [str(v).lower() for v in value] if isinstance(value, (list, tuple)) else str(value).lower()
    return COMPARE[op](column, value)


def for_guild(df: DataFrame, guild: int | None, default: int = 1, column: str = "guild_id") -> DataFrame:
    """Tenant predicate; a missing or non-positive id means the default guild."""
    return df.filter(F.col(column) == (guild if guild and guild > 0 else default))


def _moment(value: datetime | str) -> tuple[int, ...]:
    """Year to fraction as numbers, however a date is written (``2024-1-9``, a blank or ``T`` before the time)."""
    if isinstance(value, datetime):
        return (*value.timetuple()[:6], value.microsecond)
    whole, _, fraction = value.partition(".")
    parts = [int(p) for p in re.findall(r"\d+", whole)[:6]]
    return (*parts, *[1] * (3 - len(parts)), *[0] * (6 - max(len(parts), 3)), int(f"{fraction:0<6.6}" if fraction.isdigit() else 0))


def time_range(df: DataFrame, ts: str, start: datetime | str, end: datetime | str) -> DataFrame:
    if _moment(end) <= _moment(start):
        raise ValueError("end must be after start")
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def search_encounters(
    encounters: DataFrame, *, name: str | None = None, difficulty: str | None = None,
    encounter_type: str | None = None, success: bool | None = None,
    start: str | None = None, end: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Encounters by partial name, difficulty, type, outcome and date, newest first."""
    tests = []
    if name is not None:
        tests.append(F.col("name").contains(name))
    if difficulty is not None:
        tests.append(F.col("difficulty") == difficulty)
    if encounter_type is not None:
        tests.append(F.col("encounter_type") == encounter_type)
    if success is not None:
        tests.append(F.col("success") == success)
    if start is not None:
        tests.append(F.col("start_ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("start_ts") <= F.lit(end).cast("timestamp"))
    out = encounters.filter(reduce(lambda a, b: a & b, tests)) if tests else encounters
    return out.orderBy(F.desc("start_ts"), F.desc("encounter_key")).limit(limit) if limit else out
