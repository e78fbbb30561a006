"""Train/validation splits that do not leak time or machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.operators import scan


def purged_time_split(
    df: DataFrame,
    group: str,
    n_splits: int = 5,
    gap: int = 0,
    max_train: int | None = None,
    max_test: int | None = None,
) -> DataFrame:
    """Rows tagged (fold, role) with role train, gap or test.

    Groups (days, hours) are ordered by id. There are ``n_splits - 1`` folds at the end of the
    order; each trains on the groups before its test groups, without the ``gap`` in between.
    """
    groups = df.select(group).distinct()
    total = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = scan.ordinal(scan.by_quantile(groups, group), [], [group], "_rank")
    folds = n_splits - 1
    size = F.floor(total / n_splits)
    size = F.least(size, F.lit(max_test)) if max_test is not None else size
    tagged = placed.select(group, "_rank", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    start = total - folds * size + F.col("fold") * size
    oldest = F.greatest(F.lit(0), start - gap - max_train) if max_train is not None else F.lit(0)
    rank = F.col("_rank")
    role = (
        F.when((rank >= start) & (rank < start + size), "test")
        .when((rank >= start - gap) & (rank < start), "gap")
        .when((rank >= oldest) & (rank < start - gap), "train")
    )
    roles = tagged.select(group, "fold", role.alias("role")).where("role is not null")
    return df.join(roles, group)


# The day ranges [train), [valid) used for the regressor.
DAY_FOLDS = [
    ((0, 151), (181, 212)),
    ((0, 120), (120, 151)),
    ((0, 90), (120, 151)),
    ((0, 212), (181, 212)),
]


def range_split(
    df: DataFrame, day: str, folds: Sequence[tuple[tuple[int, int], tuple[int, int]]] = DAY_FOLDS
) -> DataFrame:
    """One row per fold and role whose half-open day range holds the row."""
    tags = []
    for i, ranges in enumerate(folds):
        for role, (low, high) in zip(("train", "valid"), ranges):
            inside = (F.col(day) >= low) & (F.col(day) < high)
            tags.append(F.when(inside, F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"))))
    found = F.filter(F.array(*tags), lambda t: t.isNotNull())
    return df.select("*", F.explode(found).alias("_tag")).select("*", "_tag.*").drop("_tag")


def kfold_contiguous(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """K contiguous folds along a unique key; the first ``n % k`` folds hold one row more."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = scan.ordinal(scan.by_quantile(df, key), [], [key], "_at")
    size, longer, at = F.floor(n / k), n % k, F.col("_at")
    head = longer * (size + 1)
    fold = F.when(at < head, F.floor(at / (size + 1))).otherwise(
        longer + F.floor((at - head) / F.greatest(size, F.lit(1)))
    )
    return placed.select(*df.columns, fold.cast("long").alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """All rows of a machine in one fold; the next largest machine goes to the lightest fold.

    Machines of one size are interchangeable, so only the number of them that each fold gets is
    worked out on the driver, one step a distinct size (at most the root of twice the rows). Within
    a size machines go to the folds in the order of their ids. Rows without a machine are one machine.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    steps = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_m")).collect()
    dealt = _deal(sorted(((r["_size"], r["_m"]) for r in steps), reverse=True), k)
    ends = df.sparkSession.createDataFrame(dealt, "_of long, _ends array<long>")
    placed = scan.ordinal(scan.by_quantile(sizes, group), ["_size"], [group], "_place")
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_place")))
    folds = placed.join(ends, F.col("_size") == F.col("_of")).select(F.col(group).alias("_group"), fold.cast("long").alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _deal(steps: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """For machines of each size, largest first: how many the folds up to each one get.

    A fold with load L gets its machines at loads L, L + size, ...; the m lowest of these over all
    folds are taken, ties to the first fold.
    """
    loads, out = [0] * k, []
    for size, m in steps:
        def upto(level):
            return [max(0, (level - load) // size + 1) for load in loads]

        low, high = min(loads) - 1, max(loads) + m * size
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(upto(middle)) <= m else (low, middle - 1)
        counts = upto(low)
        for f in range(k):
            if sum(counts) < m and (low + 1 - loads[f]) % size == 0 and loads[f] <= low + 1:
                counts[f] += 1
        loads = [load + n * size for load, n in zip(loads, counts)]
        out.append((size, [sum(counts[: f + 1]) for f in range(k)]))
    return out
