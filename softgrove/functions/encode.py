"""Label encodings and score transforms as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(label: Column, width: int) -> Column:
    """0-based integer label -> array of ``width`` zeros with a single one."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda k: F.when(k == label, 1.0).otherwise(0.0))


def argmax_decode(vector: Column) -> Column:
    """Position (0-based) of the first largest element."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    """Scores -> probabilities; shifting by the largest score avoids overflow."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(raised, lambda e: e / total)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def recode(value: Column, mapping: Mapping[str, object]) -> Column:
    """Look a label up in a small fixed mapping; unknown labels give NULL."""
    pairs: list[Column] = []
    for key, code in mapping.items():
        pairs += [F.lit(key), F.lit(code)]
    return F.try_element_at(F.create_map(*pairs), value)


def shift_label(label: Column, by: int = -1) -> Column:
    return label + F.lit(by)


def majority_of(votes: Sequence[Column]) -> Column:
    """Most frequent value of several columns, the smallest one on ties."""
    arr = F.array(*votes)
    tally = F.transform(
        F.array_distinct(arr),
        lambda v: F.struct((-F.size(F.filter(arr, lambda u: u == v))).alias("k"), v.alias("v")),
    )
    return F.array_min(tally)["v"]


def mean_of(values: Sequence[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / F.lit(float(len(values)))
