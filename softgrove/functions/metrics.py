"""Metrics as aggregate columns; use them in ``agg`` or ``groupBy().agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accuracy(truth: Column, prediction: Column) -> Column:
    return F.avg(F.when(truth == prediction, 1.0).otherwise(0.0))


def mean_squared_error(truth: Column, prediction: Column) -> Column:
    d = truth - prediction
    return F.avg(d * d)


def mean_absolute_error(truth: Column, prediction: Column) -> Column:
    return F.avg(F.abs(truth - prediction))
