"""Soft memberships of one number in the fuzzy sets of its feature, as SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from softgrove.functions.sqltext import clean_number, num

# Fixed value: a pairwise centroid distance of zero counts as this distance.
ZERO_DISTANCE = 9999.0


def widths(centroids: Sequence[float]) -> list[float]:
    """Distance of every centroid to its nearest other one (see ZERO_DISTANCE)."""
    return [min(abs(c - o) or ZERO_DISTANCE for o in centroids) for c in centroids]


def memberships(x: str, sets: Sequence[tuple[float, float]], slope: float = 1.0) -> list[str]:
    """One expression per ``(centroid, width)``: 1 at the centroid, 0 beyond the width."""
    steep = "" if slope == 1.0 else f" * {num(slope)}"
    return [f"greatest(0D, 1D - abs({x} - {num(c)}) / {num(t)}{steep})" for c, t in sets]


def membership_array(feature: str, sets: Sequence[tuple[float, float]], slope: float = 1.0) -> Column:
    return F.expr(f"array({', '.join(memberships(clean_number(feature), sets, slope))})")


def mass_sql(feature: str, sets: Sequence[tuple[float, float]], slope: float = 1.0) -> str:
    """Sum over the sets; the only thing a soft split needs. Missing values weigh 0."""
    return f"coalesce({' + '.join(memberships(clean_number(feature), sets, slope))}, 0D)"


def membership_mass(feature: str, sets: Sequence[tuple[float, float]], slope: float = 1.0) -> Column:
    return F.expr(mass_sql(feature, sets, slope))


def logit_slope(reg: float) -> float:
    """Slope of the optional logit variant; 0 and 1 switch the variant off."""
    return 1.0 if reg in (0.0, 1.0) else math.log(reg) - math.log(1.0 - reg)
