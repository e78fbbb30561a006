"""Ordered scans that do not put a whole machine into one task.

A window over ``partitionBy(machine)`` gives the noisiest machine a single task. Every scan
here works in two levels instead: rows are shuffled by (machine, chunk), where the chunk is a
slice of the order, and scanned inside the chunk; one summary row per chunk (combined before its
shuffle) is scanned over the machine, and what the earlier chunks contribute is joined back on
(machine, chunk). The result equals the plain window, and the largest task is one chunk of one
machine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
DAY = 86_400
# Tables already collapsed to one row per machine and second: at most a week of seconds per task.
SECOND_GRAIN_CHUNK = 7 * DAY
# Raw rows, any number of them per second: five minutes per task.
ROW_GRAIN_CHUNK = 300


def by_time(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """Add the chunk column for an order given by a whole-second column."""
    return df.withColumn(CHUNK, F.floor(F.col(time) / F.lit(seconds)))


def order_key(df: DataFrame, name: str) -> Column:
    """A number that never decreases while the column increases (ties are allowed)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    return F.col(name).cast("double")


def cut_points(df: DataFrame, keys: Mapping[str, Column], chunks: int = 64) -> dict[str, list[float]]:
    """Approximate quantiles that split each key into chunks of similar size.

    One sketch job, like the sampling of a range partitioning. The points only balance the
    work: results do not depend on how good they are.
    """
    at = [i / chunks for i in range(1, chunks)]
    row = df.agg(*[F.percentile_approx(c, at, 1000).alias(k) for k, c in keys.items()]).first()
    return {k: sorted({p for p in (row[k] or []) if p == p}) for k in keys}


def chunk_of(key: Column, points: Sequence[float]) -> Column:
    """Number of cut points below the key, as one generated expression (no loop per row)."""
    return _added([F.when(key > F.lit(float(p)), 1).otherwise(0) for p in points])


def _added(terms: list[Column]) -> Column:
    # A balanced tree of additions keeps the expression shallow.
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return (terms[0] if terms else F.lit(0)).cast("long")


SAMPLED_TEXTS = 4096


def text_cut_points(df: DataFrame, name: str, chunks: int = 64) -> list[str]:
    """Texts that split the distinct values of a column into chunks of similar size.

    A bounded hash sample of the distinct values, so the whole text counts and not its first
    bytes; like ``cut_points`` it only balances the work.
    """
    values = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    some = sorted(r[0] for r in values.orderBy(F.xxhash64(name)).limit(SAMPLED_TEXTS).select(name).collect())
    step = max(1, -(-len(some) // chunks))
    return some[step::step]


def by_quantile(df: DataFrame, name: str, chunks: int = 64) -> DataFrame:
    """Add the chunk column for an order that is not time."""
    if isinstance(df.schema[name].dataType, T.StringType):
        below = [F.when(F.col(name) > F.lit(p), 1).otherwise(0) for p in text_cut_points(df, name, chunks)]
        return df.withColumn(CHUNK, _added(below))
    key = order_key(df, name)
    points = cut_points(df, {"k": key}, chunks)["k"]
    return df.withColumn(CHUNK, chunk_of(key, points))


_KEY = "_key"


def _keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the (group, chunk) key as one struct.

    A struct is never null, so a group whose id is null is a group like any other, and the join
    on the key adds no null filter to one of its sides only: both sides can share the shuffles
    below them.
    """
    return df.withColumn(_KEY, F.struct(*by, F.col(CHUNK)))


def _across(by: Sequence[str]) -> Window:
    """All chunks of a group, in order."""
    groups = [F.col(f"{_KEY}.{b}") for b in by]
    return (Window.partitionBy(*groups) if by else Window).orderBy(f"{_KEY}.{CHUNK}")


def _add_chunk_columns(rows: DataFrame, per_chunk: DataFrame) -> DataFrame:
    return rows.join(per_chunk, _KEY, "left")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Column | str,
    sums: Mapping[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Running sums up to and including all rows with the same order value.

    ``df`` carries the chunk column. With ``totals`` the sum over the whole group is added as
    ``<name>_total``.
    """
    order = F.col(order) if isinstance(order, str) else order
    valued = _keyed(df, by).select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    spread = valued.repartition(_KEY)
    in_chunk = Window.partitionBy(_KEY).orderBy(order)
    rows = spread.select(
        *df.columns, _KEY, *[F.sum(f"_v_{n}").over(in_chunk).alias(f"_in_{n}") for n in sums]
    )
    chunks = valued.groupBy(_KEY).agg(*[F.sum(f"_v_{n}").alias(f"_sum_{n}") for n in sums])
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    whole = _across(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = chunks.select(
        _KEY,
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
        *([F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []),
    )
    return _add_chunk_columns(rows, before).select(
        *df.columns,
        *[
            (F.col(f"_in_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
        *([f"{n}_total" for n in sums] if totals else []),
    )


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Zero-based row number inside the group; ``order`` must be unique inside it."""
    keyed = _keyed(df, by)
    in_chunk = Window.partitionBy(_KEY).orderBy(*order)
    rows = keyed.repartition(_KEY).select("*", F.row_number().over(in_chunk).alias("_rn"))
    chunks = keyed.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n"))
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(_KEY, F.sum("_n").over(earlier).alias("_before"))
    at = F.col("_rn") - 1 + F.coalesce(F.col("_before"), F.lit(0))
    return _add_chunk_columns(rows, before).select(*df.columns, at.cast("long").alias(name))


def neighbours(
    df: DataFrame, by: Sequence[str], value: str, order: Sequence[str] | None = None
) -> DataFrame:
    """Add ``_prev`` and ``_next``: the value on the row before and after, null at the ends.

    ``value`` never decreases along ``order`` (by default the value itself).
    """
    keyed = _keyed(df, by)
    in_chunk = Window.partitionBy(_KEY).orderBy(*(order or [value]))
    rows = keyed.repartition(_KEY).select(
        "*",
        F.lag(value).over(in_chunk).alias("_lag"),
        F.lead(value).over(in_chunk).alias("_lead"),
    )
    ends = keyed.groupBy(_KEY).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    across = _across(by)
    ends = ends.select(
        _KEY,
        F.lag("_hi").over(across).alias("_before"),
        F.lead("_lo").over(across).alias("_after"),
    )
    return _add_chunk_columns(rows, ends).select(
        *df.columns,
        F.coalesce("_lag", "_before").alias("_prev"),
        F.coalesce("_lead", "_after").alias("_next"),
    )


def carry_last(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """Add the last non-null value seen so far in ascending order, own row included."""
    valued = _keyed(df, by).select("*", *[c.alias(f"_v_{n}") for n, c in values.items()])
    so_far = (
        Window.partitionBy(_KEY)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = valued.repartition(_KEY).select(
        *df.columns,
        _KEY,
        *[F.last(f"_v_{n}", ignorenulls=True).over(so_far).alias(f"_in_{n}") for n in values],
    )
    # max_by leaves out rows whose place is null, so only rows with a value compete.
    place = F.struct(*order)
    chunks = valued.groupBy(_KEY).agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_end_{n}")
            for n in values
        ]
    )
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(
        _KEY,
        *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in values],
    )
    return _add_chunk_columns(rows, before).select(
        *df.columns, *[F.coalesce(f"_in_{n}", f"_before_{n}").alias(n) for n in values]
    )


def lagged(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, int]],
    block: int = 65_536,
) -> DataFrame:
    """Add ``{name: (column, n)}``: the value n rows earlier in the group.

    Rows are numbered, cut into blocks of equal length, and each block gets the last rows of
    the block before it as a halo, so ``lag`` never needs more than one block.
    """
    reach = max(n for _, n in values.values())
    if reach > block:
        raise ValueError("the lag is longer than a block")
    at = ordinal(df, by, order, "_at")
    home = F.floor(F.col("_at") / block)
    tail = F.col("_at") % block >= block - reach
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = at.withColumn("_home", home).withColumn("_block", F.explode(copies))
    in_block = Window.partitionBy(*by, "_block").orderBy("_at")
    return (
        spread.select(
            *df.columns,
            "_home",
            "_block",
            *[F.lag(c, n).over(in_block).alias(name) for name, (c, n) in values.items()],
        )
        .where(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    weight: str | None = None,
    bounded: bool = False,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles per group with linear interpolation. Nulls are left out.

    Equal values are counted first; ranks come from running counts over value ranges, so a group
    may be of any size. ``bounded`` groups are small by construction and ranked in one sort.
    ``points`` are cut points already at hand.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    seen = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(times.alias("_n"))
    if not bounded:
        key = order_key(seen, value)
        if points is None:
            points = cut_points(seen, {"k": key})["k"]
        seen = seen.withColumn(CHUNK, chunk_of(key, points))
    ranked = rank_counts(seen, by, value, F.col("_n"), bounded)
    return ranked.groupBy(*by).agg(*quantile_aggregates(value, "_n", quantiles))


def rank_counts(
    counts: DataFrame, by: Sequence[str], value: str, n: Column, bounded: bool = False
) -> DataFrame:
    """Add ``_upto``, the rows of the group up to a value, and ``_upto_total``, all its rows.

    Unbounded groups need the chunk column.
    """
    if not bounded:
        return running_sums(counts, by, value, {"_upto": n}, totals=True)
    whole = Window.partitionBy(*by)
    return counts.select(
        "*",
        F.sum(n).over(whole.orderBy(value)).alias("_upto"),
        F.sum(n).over(whole).alias("_upto_total"),
    )


def quantile_aggregates(value: str, n: str, quantiles: Mapping[str, float]) -> list[Column]:
    """Aggregates over ranked counts that pick and interpolate the quantiles of a group."""
    outs = []
    for name, q in quantiles.items():
        place = (F.col("_upto_total") - 1) * F.lit(float(q))
        ends = []
        for rank in (F.floor(place), F.ceil(place)):
            here = (F.col("_upto") - F.col(n) <= rank) & (rank < F.col("_upto"))
            ends.append(F.max(F.when(here, F.col(value).cast("double"))))
        low, high = ends
        share = F.max(place - F.floor(place))
        outs.append((low + share * (high - low)).alias(name))
    return outs
