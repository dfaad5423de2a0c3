"""Seeded random draws as column expressions.

Every draw is an md5 of the row key, a salt and a seed, so it does not depend on
partitioning, a retried task repeats it, and any SQL engine can recompute it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of a draw: 60 bits, enough to address any table.
DRAW_DIGITS = 15


def draw_hash(keys: Sequence[str | Column], salt: Column | int | str, seed: int) -> Column:
    """md5 hex of ``key-salt-seed``; the parts of a longer key come with their lengths, so different keys differ."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    if len(parts) > 1:
        parts = [F.when(p.isNull(), F.lit("N")).otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for p in parts]
    salt_col = salt if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat_ws("-", *parts, salt_col.cast("string"), F.lit(str(seed))).cast("binary"))


def draw_bits(hashed: Column) -> Column:
    """First 60 bits of an md5 hex string as BIGINT."""
    return F.conv(F.substring(hashed, 1, DRAW_DIGITS), 16, 10).cast("bigint")


def draw_int(hashed: Column, upper: Column | int) -> Column:
    """Integer in ``0 .. upper-1``."""
    bound = upper if isinstance(upper, Column) else F.lit(upper)
    return F.pmod(draw_bits(hashed), bound.cast("bigint"))


def draw_unit(hashed: Column) -> Column:
    """Double in [0, 1)."""
    return draw_bits(hashed) / F.lit(float(16**DRAW_DIGITS))


def poisson_steps(mean: float) -> list[float]:
    """Distribution function of a Poisson count at 0, 1, ... as far as a double tells it from 1."""
    term = total = math.exp(-mean)
    steps = [total]
    while term > 1e-17 or len(steps) <= mean:
        term *= mean / len(steps)
        total += term
        steps.append(total)
    return [s for s in steps if s < 1.0]


def _steps_passed(unit: Column, steps: Sequence[float]) -> Column:
    return sum((F.when(unit >= F.lit(s), 1).otherwise(0) for s in steps[1:]),
               F.when(unit >= F.lit(steps[0]), 1).otherwise(0)).cast("bigint")


def poisson(unit: Column, mean: float) -> Column:
    """Poisson count by inversion; for means up to a few dozen."""
    return _steps_passed(unit, poisson_steps(mean))


def poisson_one(unit: Column) -> Column:
    """Poisson(1) count by inversion of the distribution function."""
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    return _steps_passed(unit, steps)
