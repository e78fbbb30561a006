"""Alarms of machines: first one, cooldown, and scoring against failures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.scores import f1, share, sigmoid
from fleetlog.operators.joins import alarm_failure_match

WEEK = 7 * 86_400


def first_alarm(
    alarms: DataFrame, by: Sequence[str] = ("sn",), order: Sequence[str] = ("t", "id")
) -> DataFrame:
    """Earliest alarm per machine with all its columns."""
    rest = [c for c in alarms.columns if c not in by]
    first = alarms.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_a"))
    return first.select(*by, "_a.*")


def keep_spaced(times: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Of ascending times, those at least ``gap`` after the one kept before."""
    kept, at = [], 0
    while True:
        if last is not None:
            at = int(np.searchsorted(times, last + gap, side="left"))
        if at >= len(times):
            return kept, last
        last = int(times[at])
        kept.append(last)


def alarm_cooldown(
    alarms: DataFrame, gap: int = WEEK, machine: str = "sn", time: str = "t"
) -> DataFrame:
    """Keep the first alarm, then each one at least ``gap`` seconds after the last kept.

    Alarms are collapsed to distinct seconds before the shuffle, which bounds what a machine can
    send by the length of its history. Sorted rows then stream through in batches; the only
    state is the last kept time, so no machine is ever held in memory.
    """
    seconds = alarms.select(machine, time).distinct()
    ordered = seconds.repartition(machine).sortWithinPartitions(machine, time)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            names = batch[machine].to_numpy()
            times = batch[time].to_numpy()
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(batch) else []
            out_names, out_times = [], []
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                if names[a] != current:
                    current, last = names[a], None
                kept, last = keep_spaced(times[a:b], last, gap)
                out_names += [current] * len(kept)
                out_times += kept
            yield pd.DataFrame({machine: pd.Series(out_names, dtype=batch[machine].dtype), time: out_times}).astype(
                {time: "int64"}
            )

    kinds = {f.name: f.dataType.simpleString() for f in seconds.schema}
    return ordered.mapInPandas(fold, f"{machine} {kinds[machine]}, {time} bigint")


def _machines(failures: DataFrame, by: Sequence[str]):
    return failures.select(*by).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def alarm_f1(
    alarms: DataFrame,
    failures: DataFrame,
    days: int = 7,
    by: Sequence[str] = ("sn",),
    order: Sequence[str] = ("t", "id"),
) -> DataFrame:
    """First alarm per machine: hits over failed machines, and over alarmed machines."""
    matched = alarm_failure_match(first_alarm(alarms, by, order), failures, days, by, order[0])
    counts = matched.agg(
        F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("alarms")
    ).withColumn("failures", _machines(failures, by))
    return _rates(counts, F.col("hits"))


def _rates(counts: DataFrame, earned) -> DataFrame:
    rated = counts.withColumns(
        {"precision": share(earned, F.col("alarms")), "recall": share(earned, F.col("failures"))}
    )
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def alarm_lead_time_score(
    rows: DataFrame,
    failures: DataFrame,
    predicted: str = "pred_min",
    label: str = "pred_label",
    days: int = 7,
    by: Sequence[str] = ("sn",),
    order: Sequence[str] = ("t", "id"),
    failure_time: str = "failure_t",
) -> DataFrame:
    """As ``alarm_f1``, but a hit earns the sigmoid of predicted over true minutes.

    A prediction that is too long earns nothing. Only failures strictly inside the time range of
    the evaluated rows count.
    """
    time = order[0]
    span = rows.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("s")).scalar()
    inside = failures.where(
        (F.col(failure_time) > span["lo"]) & (F.col(failure_time) < span["hi"])
    )
    alarms = first_alarm(rows.where(F.col(label) == 1), by, order)
    matched = alarm_failure_match(alarms, inside, days, by, time, failure_time)
    ratio = F.col(predicted) / F.col("true_min")
    credit = F.when(
        (F.col("hit") == 1) & (F.col(predicted) >= 0) & (F.col(predicted) <= F.col("true_min")),
        sigmoid(ratio),
    ).otherwise(0.0)
    counts = matched.agg(
        F.coalesce(F.sum(credit), F.lit(0.0)).alias("credit"), F.count(F.lit(1)).alias("alarms")
    ).withColumn("failures", _machines(inside, by))
    rated = _rates(counts, F.col("credit"))
    return rated.withColumn("alarms_per_failure", share(F.col("alarms"), F.col("failures")))
