"""Spell literals and names as Spark SQL text."""

from __future__ import annotations

import math


def num(value: float) -> str:
    """DOUBLE literal that keeps every digit."""
    v = float(value)
    if math.isnan(v) or math.isinf(v):
        return f"cast('{v}' AS double)"
    return f"({v!r}D)" if v < 0 else f"{v!r}D"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value(v) -> str:
    """Literal of a label: text, boolean, integer or number."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return text(v)
    if isinstance(v, int):
        return str(v) if -(2**31) <= v < 2**31 else f"{v}L"
    return num(v)


def clean_number(column: str) -> str:
    """A feature as DOUBLE with NaN as NULL: neither passes a split test."""
    return f"nanvl(cast({name(column)} AS double), cast(NULL AS double))"
