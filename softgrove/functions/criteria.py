"""Impurity criteria and split gains over sufficient statistics, as SQL expressions.

A *side* of a split (the whole node, the rows that pass the test, the rest) is
described by sums only: class masses for classification; count, sum and sum of
squares per output for regression. A criterion turns the sums of one side into
an impurity, a gain combines three sides. Both are functions from column names to
SQL text, registered by name: they stay inside generated code, and a long
expression costs one parse instead of one call per operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

# Relative residue below which the difference of two membership sums is zero.
MASS_RESIDUE = "1e-12D"


def plus(parts: Sequence[str]) -> str:
    return "(" + " + ".join(parts) + ")"


@dataclass(frozen=True)
class Side:
    """SQL names of the sums of one side; ``n`` rows and ``g`` membership in total."""

    n: str
    g: str = "0D"
    classes: tuple[str, ...] = ()  # row weight per class
    soft_classes: tuple[str, ...] = ()  # membership per class
    sums: tuple[str, ...] = ()
    squares: tuple[str, ...] = ()


def gini(masses: Sequence[str], whole: str) -> str:
    """1 - sum of squared shares, the same as sum of p (1 - p)."""
    return f"(1D - {plus([f'({m} / {whole}) * ({m} / {whole})' for m in masses])})"


def entropy(masses: Sequence[str], whole: str) -> str:
    """Base 2, with 0 log 0 = 0."""
    inner = plus([f"if({m} > 0, {m} * log2({m}), 0D)" for m in masses])
    return f"greatest(0D, log2({whole}) - {inner} / {whole})"


def variance(n: str, s: str, q: str) -> str:
    """Population variance from count, sum and sum of squares."""
    return f"greatest(0D, {q} / {n} - ({s} / {n}) * ({s} / {n}))"


def stddev(n: str, s: str, q: str) -> str:
    return f"sqrt({variance(n, s, q)})"


CLASS_CRITERIA: dict[str, Callable[[Sequence[str], str], str]] = {"gini": gini, "entropy": entropy}
# "mse" and "mae" are kept as names of the variance and the standard deviation.
VALUE_CRITERIA: dict[str, Callable[[str, str, str], str]] = {
    "variance": variance,
    "stddev": stddev,
    "mse": variance,
    "mae": stddev,
}
# Criteria with I(side) * count(side) concave in the sums; only these give bounds for whole value ranges.
CONCAVE = {"gini", "entropy", "variance", "stddev", "mse", "mae"}


def register_class_criterion(name: str, fn: Callable[[Sequence[str], str], str]) -> None:
    """``fn(masses, total)`` returns the SQL of an impurity; ``total`` is positive."""
    CLASS_CRITERIA[name] = fn


def register_value_criterion(name: str, fn: Callable[[str, str, str], str]) -> None:
    """``fn(n, s, q)`` returns the SQL of an impurity of one output; ``n`` is positive."""
    VALUE_CRITERIA[name] = fn


def impurity(side: Side, criterion: str) -> str:
    """Crisp impurity of a non-empty side; summed over outputs for regression."""
    if side.classes:
        return CLASS_CRITERIA[criterion](side.classes, side.n)
    fn = VALUE_CRITERIA[criterion]
    return plus([fn(side.n, s, q) for s, q in zip(side.sums, side.squares)])


def crisp_gain(node: Side, hit: Side, rest: Side, criterion: str) -> str:
    """Node impurity minus the count-weighted impurity of both (non-empty) sides."""
    return (f"({impurity(node, criterion)} - {hit.n} / {node.n} * {impurity(hit, criterion)}"
            f" - {rest.n} / {node.n} * {impurity(rest, criterion)})")


def soft_gain(node: Side, hit: Side, rest: Side, criterion: str) -> str:
    """Crisp node impurity minus the membership-weighted impurity of both sides.

    A node without any membership falls back to the crisp gain. In
    classification a side without membership has no impurity, hence no gain;
    regression impurity ignores memberships, only its weights are soft.
    """
    crisp = crisp_gain(node, hit, rest, criterion)
    if node.classes:
        fn = CLASS_CRITERIA[criterion]
        soft = (f"if({hit.g} > 0 AND {rest.g} > 0, {impurity(node, criterion)}"
                f" - {hit.g} / {node.g} * {fn(hit.soft_classes, hit.g)}"
                f" - {rest.g} / {node.g} * {fn(rest.soft_classes, rest.g)}, NULL)")
    else:
        soft = (f"({impurity(node, criterion)} - {hit.g} / {node.g} * {impurity(hit, criterion)}"
                f" - {rest.g} / {node.g} * {impurity(rest, criterion)})")
    return f"if({node.g} > 0, {soft}, {crisp})"


def rest_of(hit: str, node: str, soft: bool) -> str:
    """node - hit; for memberships, rounding residue is taken as zero."""
    left = f"({node} - {hit})"
    return f"if({left} <= {MASS_RESIDUE} * {node}, 0D, {left})" if soft else left


@dataclass(frozen=True)
class GainSpec:
    """Which gain scores a split; replace ``gain`` to plug in another rule."""

    criterion: str
    soft: bool = False
    gain: Callable[[Side, Side, Side, str], str] | None = None

    def score(self, node: Side, hit: Side, rest: Side) -> str:
        fn = self.gain or (soft_gain if self.soft else crisp_gain)
        return fn(node, hit, rest, self.criterion)
