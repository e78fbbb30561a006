"""Row-level encodings: identifiers, one-hot columns, keys, fills and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_entity_id(name: Column) -> Column:
    """``server_123`` -> 123."""
    return F.split_part(name, F.lit("_"), F.lit(2)).try_cast("long")


def one_hot(value: Column, values: Sequence, prefix: str, fallback: int = 0) -> list[Column]:
    """One 0/1 double column per known value; anything else, null included, is ``fallback``."""
    known = F.coalesce(value.isin(*values), F.lit(False))
    return [
        F.when(value == v, 1.0)
        .when(~known & F.lit(i == fallback), 1.0)
        .otherwise(0.0)
        .alias(f"{prefix}_{v}")
        for i, v in enumerate(values)
    ]


def composite_key(*parts: str) -> Column:
    """Identity of a cell, row, column, bank or rank; null if no part is known."""
    any_known = F.coalesce(*[F.col(p).cast("string") for p in parts]).isNotNull()
    return F.when(any_known, F.struct(*parts))


def fill_missing(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    return df.fillna(value, subset=list(columns))


# Class weights of the four fault classes.
CLASS_WEIGHTS = {0: 5 / 11, 1: 4 / 11, 2: 1 / 11, 3: 1 / 11}


def sample_weight(label: Column, weights: Mapping[int, float] = CLASS_WEIGHTS) -> Column:
    cases = [F.when(label == k, F.lit(w)) for k, w in weights.items()]
    return F.coalesce(*cases)


def in_range(value: Column, low, high) -> Column:
    """Half-open day or month range."""
    return (value >= low) & (value < high)


def failure_target(days: Column, limit: float = 0.25) -> tuple[Column, Column]:
    """Days to failure clipped to the limit (unknown counts as the limit), and the 0/1 label."""
    target = F.least(F.coalesce(days, F.lit(limit)), F.lit(limit))
    return target, F.when(target < limit, 1).otherwise(0)


def threshold_labels(minutes: Column, classes: int = 10, first: int = 15, gap: int = 25) -> Column:
    """0/1 array: at most ``first + i·gap`` minutes to failure; unknown time gives zeros."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when(minutes <= i * gap + first, 1).otherwise(0),
    )


def minutes_from_threshold_labels(labels: Column, least: int = 3, gap: int = 5) -> Column:
    """Shortest time allowed by the label vector: one gap per leading zero after the first."""
    first_one = F.array_position(labels, 1)
    zeros = F.when(first_one == 0, F.size(labels)).otherwise(first_one - 1)
    return F.greatest(zeros - 1, F.lit(0)) * gap + least


# Value ranges, both ends excluded, that let a column move to the narrower type.
_WHOLE = [
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
]
_FLOAT_MAX = 3.4028234663852886e38


def shrink_types(df: DataFrame) -> DataFrame:
    """Cast every numeric column to the narrowest type its values fit in (one profiling job)."""
    numeric = [f for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.FractionalType))
               and not isinstance(f.dataType, T.DecimalType)]
    if not numeric:
        return df
    profile = df.agg(
        *[F.min(f.name).alias(f"lo_{i}") for i, f in enumerate(numeric)],
        *[F.max(f.name).alias(f"hi_{i}") for i, f in enumerate(numeric)],
    ).first()
    casts = {}
    for i, f in enumerate(numeric):
        low, high = profile[f"lo_{i}"], profile[f"hi_{i}"]
        if low is None:
            continue
        if isinstance(f.dataType, T.IntegralType):
            fits = [t for t, a, b in _WHOLE if low > a and high < b]
            casts[f.name] = F.col(f.name).cast(fits[0] if fits else T.LongType())
        elif low > -_FLOAT_MAX and high < _FLOAT_MAX:
            casts[f.name] = F.col(f.name).cast("float")
    return df.withColumns(casts) if casts else df
