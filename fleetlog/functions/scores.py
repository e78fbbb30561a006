"""Score arithmetic shared by the evaluations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def share(part: Column, whole: Column) -> Column:
    """Ratio as double, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return share(precision * 2 * recall, precision + recall)


def lead_time_credit(predicted: Column, true: Column) -> Column:
    """Sigmoid of predicted over true minutes; nothing for a time that is too long."""
    predicted = F.greatest(predicted.cast("double"), F.lit(0.0))
    return F.when(predicted > true, 0.0).otherwise(sigmoid(predicted / (true + 1e-8)))


def argmax_class(probabilities: Column) -> Column:
    """Index of the greatest probability, the first one on ties."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1
