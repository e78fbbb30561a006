"""Joins on machine and time.

Range conditions never join a whole machine with a whole machine: the time axis is cut into
slots of a tenth of the range, the shorter table gets one row per slot its range touches (eleven
at most), and the equi-join key is (machine, slot). The rows of a noisy machine are thereby
spread over its history. No side is broadcast by hint; Spark does it where its own size check
allows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.operators import scan, trailing

DAY = 86_400
HOUR = 3_600


def band_join(
    points: DataFrame,
    bands: DataFrame,
    by: Sequence[str],
    at: Column,
    low: Column,
    high: Column,
    slot: int,
    how: str = "inner",
) -> DataFrame:
    """Join each point to the bands of its group with ``low <= at <= high``.

    ``low`` and ``high`` are columns of ``bands``; ``how`` is relative to the points (a point has
    one slot, so a left or semi join gives no duplicates). Bands bring their columns but ``by``.
    """
    left = points.withColumn("_at", at).withColumn("_slot", F.floor(F.col("_at") / slot))
    right = bands.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        *[c for c in bands.columns if c not in by],
        low.alias("_low"),
        high.alias("_high"),
    ).where(F.col("_low") <= F.col("_high"))
    right = right.withColumn(
        "_band_slot",
        F.explode(F.sequence(F.floor(F.col("_low") / slot), F.floor(F.col("_high") / slot))),
    )
    same = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_by_{b}") for b in by])
    on = same & (F.col("_slot") == F.col("_band_slot")) & F.col("_at").between(
        F.col("_low"), F.col("_high")
    )
    helper = ["_at", "_slot", "_band_slot", "_low", "_high", *[f"_by_{b}" for b in by]]
    return left.join(right, on, how).drop(*helper)


def feature_join(
    base: DataFrame, others: Sequence[DataFrame], key: Sequence[str], fill: float | None = 0
) -> DataFrame:
    """Left-join feature tables on their common key, then fill what is missing.

    The key identifies a row in every table, so all joins of the chain share one partitioning.
    """
    out, added = base, []
    for other in others:
        added += [c for c in other.columns if c not in key]
        out = out.join(other, list(key), "left")
    return out if fill is None else out.fillna(fill, subset=added)


def _with_previous(failures: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Distinct failures with the time of the failure before, null for the first one."""
    once = scan.by_time(failures.select(*by, at).distinct(), at, 365 * DAY)
    return scan.neighbours(once, by, at).select(*by, at, "_prev")


def time_to_failure_label(
    rows: DataFrame,
    failures: DataFrame,
    by: Sequence[str] = ("sn",),
    time: str = "t",
    failure_time: str = "failure_t",
    days: int = 15,
    nearest: bool = False,
) -> DataFrame:
    """Days and hours to a failure at most ``days`` ahead, at minute resolution.

    One row per matching failure, nulls without one; with ``nearest`` only the next failure
    counts, so that no row is doubled.
    """
    minute = F.floor(F.col(failure_time) / 60)
    low = minute - days * 1440
    if nearest:
        failures = _with_previous(failures, by, failure_time)
        previous = F.floor(F.col("_prev") / 60)
        bands = failures.select(
            *by, minute.alias("_fm"), F.greatest(low, previous + 1).alias("_from")
        )
    else:
        bands = failures.select(*by, minute.alias("_fm"), low.alias("_from"))
    at = F.floor(F.col(time) / 60)
    joined = band_join(
        rows, bands, by, at, F.col("_from"), F.col("_fm"), slot=max(60, days * 144), how="left"
    )
    ahead = F.col("_fm") - at
    return joined.select(
        *rows.columns,
        (ahead / F.lit(1440.0)).alias("days_to_failure"),
        (ahead / F.lit(60.0)).alias("hours_to_failure"),
    )


def lookback_join(
    tickets: DataFrame,
    logs: DataFrame,
    days: float = 40,
    by: Sequence[str] = ("sn",),
    fault_time: str = "fault_t",
    time: str = "t",
    ticket_id: str = "ticket_id",
    keep_empty: bool = True,
) -> DataFrame:
    """Long table of the logs in ``(fault - days, fault]`` per ticket.

    With ``keep_empty`` a ticket without logs keeps one row of nulls.
    """
    band = int(days * DAY)
    return anchored_join(
        tickets, logs, band, by, fault_time, time, ticket_id, keep_empty, open_start=True
    )


def anchored_join(
    anchors: DataFrame,
    logs: DataFrame,
    seconds: int,
    by: Sequence[str] = ("sn",),
    anchor_time: str = "fault_t",
    time: str = "t",
    anchor_id: str = "ticket_id",
    keep_empty: bool = True,
    open_start: bool = False,
) -> DataFrame:
    """Logs from ``anchor - seconds`` (itself left out with ``open_start``) to the anchor."""
    low = F.col(anchor_time) - seconds + (1 if open_start else 0)
    high = F.col(anchor_time)
    slot = max(HOUR, seconds // 10)
    found = band_join(logs, anchors, by, F.col(time), low, high, slot)
    rest = [c for c in logs.columns if c not in by]
    found = found.select(*anchors.columns, *rest)
    if not keep_empty:
        return found
    one = {"_n": F.lit(1)}
    counted = sums_at_anchors(logs, anchors, seconds - open_start, one, by, anchor_time, time)
    return found.unionByName(counted.where("_n = 0").drop("_n"), allowMissingColumns=True)


def sums_at_anchors(
    logs: DataFrame,
    anchors: DataFrame,
    seconds: int,
    amounts: Mapping[str, Column],
    by: Sequence[str] = ("sn",),
    anchor_time: str = "fault_t",
    time: str = "t",
) -> DataFrame:
    """Sums of whole amounts over ``[anchor - seconds, anchor]``, 0 without any, one row an anchor.

    Logs, collapsed to seconds, and anchors are one timeline, cut into chunks with a halo; an anchor
    reads two running sums of its chunk. Nothing grows beyond logs plus anchors.
    """
    outs = list(amounts)
    zero = [F.lit(0).cast("long").alias(o) for o in outs]
    timed = anchors.where(F.col(anchor_time).isNotNull())
    probes = timed.select(*by, F.col(anchor_time).alias("_t"), F.struct(*anchors.columns).alias("_anchor"), *zero)
    events = logs.groupBy(*by, F.col(time).alias("_t")).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(o) for o, c in amounts.items()])
    rows = probes.unionByName(events, allowMissingColumns=True)
    spread, part = trailing.chunked(rows, by, "_t", seconds)
    order = Window.partitionBy(*part).orderBy("_t")
    sums = [trailing.window_sum(o, seconds, order).alias(o) for o in outs]
    found = trailing.at_home(spread.select("_anchor", "_home", "_chunk", *sums)).where("_anchor is not null")
    untimed = anchors.where(F.col(anchor_time).isNull()).select(*anchors.columns, *zero)
    return found.select("_anchor.*", *outs).unionByName(untimed)


def faulty_only(logs: DataFrame, failures: DataFrame, by: Sequence[str] = ("sn",)) -> DataFrame:
    """Logs of machines that have a failure."""
    return logs.join(failures.select(*by).distinct(), list(by), "left_semi")


def alarm_failure_match(
    alarms: DataFrame,
    failures: DataFrame,
    days: int = 7,
    by: Sequence[str] = ("sn",),
    time: str = "t",
    failure_time: str = "failure_t",
) -> DataFrame:
    """Add ``hit`` and ``true_min``: is a failure less than ``days`` ahead, and how far.

    An alarm at the failure itself, or exactly ``days`` early, does not count.
    """
    bands = _with_previous(failures, by, failure_time)
    low = F.greatest(F.col(failure_time) - days * DAY + 1, F.col("_prev"))
    matched = band_join(
        alarms,
        bands.select(*by, F.col(failure_time).alias("_failure"), low.alias("_from")),
        by,
        F.col(time),
        F.col("_from"),
        F.col("_failure") - 1,
        slot=max(HOUR, days * DAY // 10),
        how="left",
    )
    return matched.select(
        *alarms.columns,
        F.when(F.col("_failure").isNotNull(), 1).otherwise(0).alias("hit"),
        ((F.col("_failure") - F.col(time)) / F.lit(60.0)).alias("true_min"),
    )


def lookback_count(
    logs: DataFrame, anchors: DataFrame, seconds: int, **how
) -> DataFrame:
    """Events in ``[anchor - seconds, anchor]`` per anchor, 0 without any."""
    return sums_at_anchors(logs, anchors, seconds, {"n": F.lit(1)}, **how)


def lookback_histogram(
    logs: DataFrame,
    anchors: DataFrame,
    seconds: int,
    category: str,
    values: Sequence,
    **how,
) -> DataFrame:
    """Events per known category in the same window, one column each."""
    amounts = {f"n_{v}": F.when(F.col(category) == v, 1).otherwise(0) for v in values}
    return sums_at_anchors(logs, anchors, seconds, amounts, **how)
