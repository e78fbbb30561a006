"""Features per machine and observation window, and along the windows of a machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.operators import scan

KEY = ("sn", "bin")


def bin_last(log: DataFrame, key: Sequence[str] = KEY, time: str = "t", edge: str = "edge") -> DataFrame:
    """Last time and the right edge per window: the base row of every feature table."""
    return log.groupBy(*key).agg(
        F.max(time).alias("last_t"), F.max_by(edge, time).alias(edge)
    )


_PLAIN = {
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
}


def bin_stats(
    df: DataFrame,
    stats: Mapping[str, Sequence[str]],
    key: Sequence[str] = KEY,
    weight: str | None = None,
) -> DataFrame:
    """max, min, sum, mean, median, sample std of row features per window: ``<col>_<stat>``.

    ``weight`` tells how many log rows a row stands for (per-second tables); it matters to
    mean and median. Medians of raw rows come from ranks, so a crowded window needs no list.
    """
    asked = {name for names in stats.values() for name in names}
    if weight and "median" in asked <= {"median", "max"} and all(isinstance(df.schema[c].dataType, (T.LongType, T.DoubleType)) for c in stats):
        return _medians_and_maxima(df, stats, key, weight)
    aggregates, medians = [], []
    for column, names in stats.items():
        for name in names:
            out = f"{column}_{name}"
            if name == "median" and weight:
                # A per-second table has at most as many rows in a window as the window has seconds.
                aggregates.append(F.percentile(column, F.lit(0.5), F.col(weight)).alias(out))
            elif name == "median":
                medians.append((column, out))
            elif name == "mean" and weight:
                known = F.when(F.col(column).isNotNull(), F.col(weight))
                aggregates.append((F.sum(F.col(column) * known) / F.sum(known)).alias(out))
            elif name in ("sum", "std") and weight:
                raise ValueError("sum and std need one row per log row")
            else:
                aggregates.append(_PLAIN[name](column).alias(out))
    out = df.groupBy(*key).agg(*aggregates) if aggregates else df.select(*key).distinct()
    for column, name in medians:
        out = out.join(
            scan.group_quantiles(df, key, column, {name: 0.5}), list(key), "left"
        )
    return out


def _medians_and_maxima(df: DataFrame, stats: Mapping[str, Sequence[str]], key: Sequence[str], weight: str) -> DataFrame:
    """Weighted medians and maxima of whole numbers and fractions per window, from rows sorted by window.

    A per-second table has at most as many rows in a window as the window has seconds; a task holds one batch and the window it ends in.
    """
    rows = df.select(*key, F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("_n"), *stats)
    kinds = {f"{c}_{n}": T.DoubleType() if n == "median" else df.schema[c].dataType for c, names in stats.items() for n in names}
    out = T.StructType([*[df.schema[k] for k in key], *[T.StructField(n, kind) for n, kind in kinds.items()]])
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_by_window(list(key), {c: list(n) for c, n in stats.items()}), out)


#: Rows put together before the windows in them are worked out.
WINDOW_ROWS = 100_000


def _by_window(key: Sequence[str], stats: Mapping[str, Sequence[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def begins_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in key:
            codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def found(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
        weights = table.column("_n").to_numpy()
        columns = [c.combine_chunks() for c in table.select(list(key)).take(pa.array(begins)).columns]
        for column, names in stats.items():
            cells = table.column(column)
            values, valid = pc.fill_null(cells, 0).to_numpy(), pc.is_valid(cells).to_numpy()
            for name in names:
                if name == "max":
                    least = -np.inf if values.dtype.kind == "f" else np.iinfo(np.int64).min
                    highest = np.maximum.reduceat(np.where(valid, values, least), begins)
                    columns.append(pa.array(highest, mask=~np.logical_or.reduceat(valid, begins)))
                else:
                    counted = valid & (weights > 0)
                    columns.append(_weighted_medians(values[counted].astype(np.float64), group[counted], weights[counted], len(begins)))
        return pa.RecordBatch.from_arrays(columns, names=[*key, *[f"{c}_{n}" for c, names in stats.items() for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, due = [], 0, WINDOW_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < due:
                continue
            table = pa.Table.from_batches(held)
            begins = begins_of(table)
            # the last window may go on
            over = int(begins[-1])
            if over:
                yield found(table.slice(0, over), begins[:-1])
            rest = table.slice(over)
            held, size = rest.to_batches(), rest.num_rows
            due = max(WINDOW_ROWS, 2 * size)
        if size:
            table = pa.Table.from_batches(held)
            yield found(table, begins_of(table))

    return run


def _weighted_medians(values: np.ndarray, group: np.ndarray, weights: np.ndarray, groups: int) -> pa.Array:
    """The middle value of each group, or the middle of the two, each value standing for its weight of rows."""
    total = np.zeros(groups, np.int64)
    np.add.at(total, group, weights)
    order = np.lexsort((values, group))
    upto, ordered = np.cumsum(weights[order]), values[order]
    some = np.flatnonzero(total)
    before = (np.cumsum(total) - total)[some]
    low = ordered[np.searchsorted(upto, before + (total[some] - 1) // 2, side="right")]
    high = ordered[np.searchsorted(upto, before + total[some] // 2, side="right")]
    medians = np.zeros(groups)
    medians[some] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return pa.array(medians, pa.float64(), mask=total == 0)


def bin_category_counts(
    log: DataFrame, category: str, values: Sequence, key: Sequence[str] = KEY
) -> DataFrame:
    """Rows per known category and window, one column each."""
    return log.groupBy(*key).agg(
        *[F.count_if(F.col(category) == v).alias(f"n_{v}") for v in values]
    )


def shift_bins(
    table: DataFrame,
    columns: Sequence[str],
    shifts: Sequence[int],
    by: Sequence[str] = ("sn",),
    order: str = "bin",
) -> DataFrame:
    """Values n observed windows earlier.

    The table has one row per window, at most 288 a day and machine whatever the log volume, so
    the plain window is bounded by the length of the history.
    """
    along = Window.partitionBy(*by).orderBy(order)
    return table.select(
        "*", *[F.lag(c, n).over(along).alias(f"{c}_lag{n}") for c in columns for n in shifts]
    )


def distinct_event_times(
    log: DataFrame, by: Sequence[str] = ("sn",), time: str = "t", bin_column: str = "bin"
) -> DataFrame:
    """One row per machine and second, with its first window."""
    return log.groupBy(*by, time).agg(F.min(bin_column).alias(bin_column))


def time_since_nth_last(
    log: DataFrame,
    shifts: Sequence[int] = (5, 50),
    by: Sequence[str] = ("sn",),
    time: str = "t",
    bin_column: str = "bin",
) -> DataFrame:
    """Seconds since the n-th previous distinct second; mean, std and max per window."""
    seconds = distinct_event_times(log, by, time, bin_column)
    seconds = scan.by_time(seconds, time, scan.SECOND_GRAIN_CHUNK)
    names = {f"_lag{n}": (time, n) for n in shifts}
    since = scan.lagged(seconds, by, [time], names)
    outs = {f"since_{n}": F.col(time) - F.col(f"_lag{n}") for n in shifts}
    since = since.select(*by, bin_column, *[c.alias(n) for n, c in outs.items()])
    return bin_stats(since, {n: ["mean", "std", "max"] for n in outs}, [*by, bin_column])


def forward_fill(
    log: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("sn",),
    order: Sequence[str] = ("t", "id"),
    sentinel=None,
    chunk_seconds: int = scan.ROW_GRAIN_CHUNK,
) -> DataFrame:
    """Replace nulls, and the sentinel, by the last value seen on the same machine.

    The first order column is whole seconds; ``order`` should be unique on a machine.
    """
    values = {
        c: F.when(F.col(c) != sentinel, F.col(c)) if sentinel is not None else F.col(c)
        for c in columns
    }
    chunked = scan.by_time(log, order[0], chunk_seconds)
    filled = scan.carry_last(
        chunked.select(*by, *order, scan.CHUNK, *[c for c in log.columns if c not in {*by, *order}]),
        by,
        order,
        {f"_f_{c}": v for c, v in values.items()},
    )
    return filled.select(
        *[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in log.columns]
    )


def gap_to_previous(
    log: DataFrame,
    by: Sequence[str] = ("sn",),
    order: Sequence[str] = ("t", "id"),
    chunk_seconds: int = scan.ROW_GRAIN_CHUNK,
) -> DataFrame:
    """Add ``gap``: seconds to the previous event of the machine, 0 for the first one."""
    time = order[0]
    near = scan.neighbours(scan.by_time(log, time, chunk_seconds), by, time, order)
    gap = F.coalesce(F.col(time) - F.col("_prev"), F.lit(0)).cast("long")
    return near.select(*log.columns, gap.alias("gap"))
