"""Losses of boosting as pairs of column builders; register more by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Loss:
    """``gradient`` maps target and score columns (one per output) to new targets; ``value`` is the loss of one
    output, ``total`` that of a row over all outputs (early stopping; squared errors unless given)."""

    gradient: Callable[[Sequence[Column], Sequence[Column]], list[Column]]
    value: Callable[[Column, Column], Column] | None = None
    total: Callable[[Sequence[Column], Sequence[Column]], Column] | None = None

    def of_row(self, ys: Sequence[Column], fs: Sequence[Column]) -> Column:
        if self.total is not None:
            return self.total(ys, fs)
        one = self.value or _squared
        return reduce(lambda a, b: a + b, [one(y, f) for y, f in zip(ys, fs)])


def _squared(y: Column, f: Column) -> Column:
    return F.lit(0.5) * (y - f) * (y - f)


def _softmax_gradient(ys: Sequence[Column], fs: Sequence[Column]) -> list[Column]:
    top = F.greatest(*fs) if len(fs) > 1 else fs[0]
    raised = [F.exp(f - top) for f in fs]
    whole = raised[0]
    for r in raised[1:]:
        whole = whole + r
    return [r / whole - y for r, y in zip(raised, ys)]


def _softmax_loss(ys: Sequence[Column], fs: Sequence[Column]) -> Column:
    """Negative logarithm of the probability of the row's class."""
    top = F.greatest(*fs) if len(fs) > 1 else fs[0]
    raised = reduce(lambda a, b: a + b, [F.exp(f - top) for f in fs])
    return F.log(raised) + top - reduce(lambda a, b: a + b, [y * f for y, f in zip(ys, fs)])


LOSSES: dict[str, Loss] = {
    "least_squares": Loss(lambda ys, fs: [f - y for y, f in zip(ys, fs)], _squared),
    # Target minus raw score, although the boosting update subtracts the tree.
    "residual": Loss(lambda ys, fs: [y - f for y, f in zip(ys, fs)]),
    "softmax": Loss(_softmax_gradient, total=_softmax_loss),
}


def register_loss(name: str, loss: Loss) -> None:
    LOSSES[name] = loss
