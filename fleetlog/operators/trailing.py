"""Trailing-window features per machine: count, sum, distinct, variance and their changes.

A window of W minutes ends at the row and starts W minutes earlier, both ends included, and
rows of the same second see each other. Results have one row per machine and second;
``attach`` brings them back to the log rows.

Two strategies give the same numbers:

* ``halo`` (default): a machine is cut into chunks of time at least as long as the longest window;
  every second also goes to the later chunks its windows reach (one or two copies), and is dropped
  there after the window function. One shuffle by (machine, chunk); the largest task is a chunk.
* ``range``: Spark's RANGE frame over the whole machine, without copies; good for an even fleet.

No frame slides: every number comes from running sums, so a row costs the same however full its
window is. Whole and decimal amounts are differences of two running sums of the chunk, which are
exact. Whole amounts, distinct values and variances are worked out on the sorted chunk, a batch at a time
(``_over_windows``). Fractional amounts take a window apart instead (``at_front``): time is cut into blocks as long
as the window, so a window is the end of one block and the beginning of the next, each a running aggregate
of its own block. Variances put a window together from parts inside it (``trailing_variance``). Nothing that has left
a window, not even a NaN, stays behind, and nothing cancels out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.operators import scan

MINUTE = 60


def attach(log: DataFrame, features: DataFrame, by: Sequence[str] = ("sn",), time: str = "t") -> DataFrame:
    """Put per-second features on the log rows. Rows without a machine id are one machine."""
    keys = [*by, time]
    named = features.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in features.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return log.join(named, reduce(Column.__and__, same), "left").drop(*[f"_of_{k}" for k in keys])


def per_second(
    log: DataFrame, by: Sequence[str], time: str, amounts: Mapping[str, Column]
) -> DataFrame:
    """Collapse the log to one row per machine and second (combined before the shuffle)."""
    return log.groupBy(*by, time).agg(*[F.sum(c).alias(n) for n, c in amounts.items()])


def _names(amounts: Sequence[str], windows: Sequence[int]) -> list[tuple[str, int, str]]:
    return [(a, w, f"{a}_{w}m") for a in amounts for w in windows]


def trailing_sums(
    log: DataFrame,
    windows: Sequence[int],
    amounts: Mapping[str, Column],
    by: Sequence[str] = ("sn",),
    time: str = "t",
    strategy: str = "halo",
    change: bool = False,
    chunk_seconds: int = scan.SECOND_GRAIN_CHUNK,
) -> DataFrame:
    """Sums over the past W minutes, ``<amount>_<W>m``, all windows in one pass.

    Null amounts count for nothing; a window with no other is null. With ``change`` also
    ``<amount>_<W>m_change``: the sum now minus the sum at the oldest second still in the window, or
    the sum itself while nothing of this machine has left the window.
    """
    seconds = per_second(log, by, time, amounts)
    outs = _names(list(amounts), windows)
    if change:
        # one row a machine; machines without an id are one machine
        firsts = log.groupBy(*[F.col(b).alias(f"_of_{b}") for b in by]).agg(F.min(time).alias("_first"))
        same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
        seconds = seconds.join(firsts, reduce(Column.__and__, same)).drop(*[f"_of_{b}" for b in by])
    # the sum at the oldest second looks back one more window
    reach = max(windows) * MINUTE * (2 if change else 1)
    spread, part = chunked(seconds, by, time, reach, strategy, chunk_seconds)
    if all(isinstance(seconds.schema[a].dataType, T.IntegralType) for a in amounts):
        return _whole_sums(spread, part, by, time, list(amounts), windows, reach, change, strategy)
    order = Window.partitionBy(*part).orderBy(time)
    exact = {a: isinstance(seconds.schema[a].dataType, (T.IntegralType, T.DecimalType)) for a in amounts}
    whole = [(a, w, n) for a, w, n in outs if exact[a]]
    summed = spread.select("*", *[window_sum(a, w * MINUTE, order).alias(n) for a, w, n in whole])
    for w in windows if len(whole) < len(outs) else []:
        summed = _block_sums(summed, part, time, w * MINUTE, {a: n for a, v, n in outs if v == w and not exact[a]})
    if change:
        summed = summed.select("*", *[at_front(n, time, w * MINUTE, order).alias(f"_front_{n}") for _, w, n in outs])
    changes = [
        F.when(F.col("_first") < F.col(time) - w * MINUTE, F.col(n) - F.col(f"_front_{n}")).otherwise(F.col(n)).alias(f"{n}_change")
        for _, w, n in outs
    ]
    return at_home(summed).select(*by, time, *[n for _, _, n in outs], *(changes if change else []))


def _whole_sums(
    spread: DataFrame,
    part: Sequence[str],
    by: Sequence[str],
    time: str,
    amounts: Sequence[str],
    windows: Sequence[int],
    reach: int,
    change: bool,
    strategy: str,
) -> DataFrame:
    """Sums of whole amounts: differences of running sums, for all rows and windows of a batch at a time."""
    named = [f"{n}{c}" for c in (["", "_change"] if change else [""]) for _, _, n in _names(amounts, windows)]
    first = [F.col("_first").cast("bigint").alias("_first")] if change else []
    cells = _cells(spread, part, by, time, [time], strategy, [*[F.col(a).cast("bigint").alias(f"_a_{a}") for a in amounts], *first])

    def found(table: pa.Table, clock: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        sums, changes = [], []
        begins = {w: np.searchsorted(clock, clock - w * MINUTE) for w in windows}
        if change:
            since = {w: pc.fill_null(pc.less(table.column("_first"), pc.subtract(table.column("_t"), w * MINUTE)), False).to_numpy()[at] for w in windows}
        for a in amounts:
            cells = table.column(f"_a_{a}")
            upto = _upto(pc.fill_null(cells, 0).to_numpy())
            known = _upto(pc.is_valid(cells).to_numpy()) if cells.null_count else None

            def window(rows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
                """Sums of the windows that end at the rows, and whether they are missing."""
                begin = begins[w][rows]
                none = known[rows + 1] == known[begin] if known is not None else np.zeros(len(rows), bool)
                return upto[rows + 1] - upto[begin], none

            for w in windows:
                now, none = window(at, w)
                sums.append(pa.array(now, pa.int64(), mask=none))
                if change:
                    then, absent = window(begins[w][at], w)
                    changes.append(pa.array(np.where(since[w], now - then, now), pa.int64(), mask=none | (since[w] & absent)))
        return [*sums, *changes]

    kinds = [T.StructField(n, T.LongType()) for n in named]
    out = T.StructType([*[cells.schema[c] for c in (*by, time)], *kinds])
    return cells.mapInArrow(_over_windows([*by, "_chunk"], [*by, time], reach, named, found), out)


def _upto(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, and of all."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def at_front(value: str | Column, time: str, seconds: int, order, rows_order=None) -> Column:
    """The value at the oldest row still in the window: the one behind the last row that has left.

    While no row of the chunk has left, its first one. ``rows_order`` tells rows of one second apart.
    """
    one = rows_order if rows_order is not None else order
    value = F.col(value) if isinstance(value, str) else value
    follower = F.struct(F.lead(time).over(one).alias("t"), F.lead(value).over(one).alias("v"))
    # of the rows of a second only the last one has a follower outside
    follower = F.when(F.lead(time).over(one) != F.col(time), follower)
    left = F.last(follower, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -seconds - 1))
    begin = F.first(F.struct(F.col(time).alias("t"), value.alias("v"))).over(one.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(left, begin)["v"]


def chunked(
    rows: DataFrame,
    by: Sequence[str],
    time: str,
    reach: int,
    strategy: str = "halo",
    chunk_seconds: int = scan.SECOND_GRAIN_CHUNK,
) -> tuple[DataFrame, list[str]]:
    """Rows with a home chunk and their copies in the chunks they reach, and the window's partition."""
    if strategy == "range":
        return rows.withColumns({"_home": F.lit(0), "_chunk": F.lit(0)}), list(by)
    if strategy != "halo":
        raise ValueError("strategy is 'halo' or 'range'")
    length = max(chunk_seconds, reach)
    home = F.floor(F.col(time) / length)
    reached = F.sequence(home, F.floor((F.col(time) + reach) / length))
    spread = rows.withColumn("_home", home).withColumn("_chunk", F.explode(reached))
    return spread.repartition(*by, "_chunk"), [*by, "_chunk"]


def at_home(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_home") == F.col("_chunk"))


def window_sum(amount: str, seconds: int, order) -> Column:
    """Sum of a whole or decimal amount over the window that ends at the row."""
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    gone = order.rangeBetween(Window.unboundedPreceding, -seconds - 1)
    known = F.count(amount).over(upto) - F.count(amount).over(gone)
    return F.when(known > 0, F.sum(amount).over(upto) - F.coalesce(F.sum(amount).over(gone), F.lit(0)))


def _block_frames(part: Sequence[str], block: str, order: Sequence[str]):
    """From the beginning of a row's block up to it, and from it to the end, both as running frames."""
    inside = Window.partitionBy(*part, block)
    return [
        inside.orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)
        for way in (list(order), [F.col(c).desc() for c in order])
    ]


def _block_sums(rows: DataFrame, part: Sequence[str], time: str, seconds: int, sums: Mapping[str, str]) -> DataFrame:
    """Add sums of any amounts over the window: ``{amount: new column}``, one row a second."""
    block = f"_block_{seconds}"
    rows = rows.withColumn(block, F.floor(F.col(time) / (seconds + 1)))
    up, down = _block_frames(part, block, [time])
    rows = rows.select(
        "*", *[F.sum(a).over(f).alias(f"{way}_{n}") for way, f in (("_up", up), ("_down", down)) for a, n in sums.items()]
    )
    ends = F.struct(F.col(block).alias("block"), *[F.col(f"_down_{n}").alias(n) for n in sums.values()])
    rows = rows.withColumn("_front", at_front(ends, time, seconds, Window.partitionBy(*part).orderBy(time)))
    added = []
    for n in sums.values():
        here, there = F.col(f"_up_{n}"), F.col("_front")[n]
        both = F.coalesce(here + there, here, there)
        added.append(F.when(F.col("_front")["block"] < F.col(block), both).otherwise(here).alias(n))
    return rows.select("*", *added).drop("_front", block, *[f"{way}_{n}" for way in ("_up", "_down") for n in sums.values()])


def trailing_count(log: DataFrame, windows: Sequence[int], weight: Column | None = None, **how) -> DataFrame:
    """Events, or the sum of their weights, in the past W minutes: ``cnt_<W>m``."""
    return trailing_sums(log, windows, {"cnt": F.lit(1) if weight is None else weight}, **how)


def trailing_distinct(
    log: DataFrame,
    windows: Sequence[int] | Mapping[str, Sequence[int]],
    value: Column | str | Mapping[str, Sequence[str]],
    name: str = "distinct",
    by: Sequence[str] = ("sn",),
    time: str = "t",
    strategy: str = "halo",
    chunk_seconds: int = scan.SECOND_GRAIN_CHUNK,
) -> DataFrame:
    """Distinct non-null values (a struct for composite keys) in the past W minutes: ``<name>_<W>m``.

    Several values are counted in one pass: ``{name: its columns}``, a value being null if none of its columns is known;
    ``windows`` may then tell those of each name. A value counts from the first second of a run of sightings at most W apart until W minutes
    after the last one: starts so far minus stops that are more than W minutes ago.
    """
    if isinstance(value, Mapping):
        parts = list(dict.fromkeys(c for columns in value.values() for c in columns))
        seen = log.select(*by, time, *[F.col(c).alias(f"_p_{c}") for c in parts]).distinct()
        leaves = {c: _leaves(seen.schema[f"_p_{c}"].dataType, F.col(f"_p_{c}"), f"_p_{c}") for c in parts}
        keys = {n: [k for c in columns for k in leaves[c]] for n, columns in value.items()}
    else:
        seen = log.select(*by, time, (F.col(value) if isinstance(value, str) else value).alias("_value")).distinct()
        leaves = {"": _leaves(seen.schema["_value"].dataType, F.col("_value"), "_value")}
        keys = {name: list(leaves[""])}
    windows = windows if isinstance(windows, Mapping) else dict.fromkeys(keys, list(windows))
    columns = {k: c for of in leaves.values() for k, c in of.items()}
    named = [f"{n}_{w}m" for n in keys for w in windows[n]]
    # a struct of unknown fields is a value, columns that are all unknown are none
    single = not isinstance(value, Mapping)
    flag = [F.col("_value").isNotNull().alias("_known")] if single else []
    reach = max(max(w) for w in windows.values()) * MINUTE
    spread, part = chunked(seen, by, time, reach, strategy, chunk_seconds)
    cells = _cells(spread, part, by, time, [time], strategy, [*[c.alias(k) for k, c in columns.items()], *flag])
    leaf_names, all_windows = list(columns), sorted({w for of in windows.values() for w in of})

    def found(table: pa.Table, clock: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        begins = {w: np.searchsorted(clock, clock[at] - w * MINUTE) for w in all_windows}
        codes = {k: _codes(table.column(k)) for k in leaf_names}
        counts = []
        for n, of in keys.items():
            known = table.column("_known").to_numpy() if single else reduce(np.logical_or, [pc.is_valid(table.column(k)).to_numpy() for k in of])
            before, after = _gaps(_joint([codes[k] for k in of], len(known)), clock)
            for w in windows[n]:
                came = np.cumsum(known & (before > w * MINUTE), dtype=np.int64)
                gone = _upto(known & (after > w * MINUTE))
                counts.append(pa.array(came[at] - gone[begins[w]]))
        return counts

    out = T.StructType([*[cells.schema[c] for c in (*by, time)], *[T.StructField(n, T.LongType()) for n in named]])
    return cells.mapInArrow(_over_windows([*by, "_chunk"], [*by, time], reach, named, found), out)


def _leaves(kind: T.DataType, column: Column, name: str) -> dict[str, Column]:
    """A value as plain columns that are equal where it is."""
    if isinstance(kind, T.StructType):
        return {k: c for i, f in enumerate(kind.fields) for k, c in _leaves(f.dataType, column.getField(f.name), f"{name}_{i}").items()}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return {name: column + F.lit(0.0)}  # one zero
    if isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)):
        return {name: F.to_json(F.struct(column))}
    return {name: column}


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Numbers of equal values, missing ones being equal, and how many there are."""
    if pa.types.is_null(column.type):
        return np.zeros(len(column), np.int64), 1
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


def _joint(codes: Sequence[tuple[np.ndarray, int]], size: int) -> np.ndarray:
    """Numbers of equal rows of several columns, as narrow as they can be."""
    joint, total = np.zeros(size, np.int64), 1
    for code, many in codes:
        if total * many >= 2**62:
            kinds, joint = np.unique(joint, return_inverse=True)
            total = len(kinds)
        joint, total = joint * many + code, total * many
    return joint.astype(np.uint16) if total <= 2**16 else joint


def _gaps(codes: np.ndarray, clock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the rows of the same number before and after are; as far as can be without one."""
    order = np.argsort(codes, kind="stable")
    sorted_, along = codes[order], clock[order]
    apart = np.where(sorted_[1:] == sorted_[:-1], along[1:] - along[:-1], np.iinfo(np.int64).max)
    before, after = np.full((2, len(codes)), np.iinfo(np.int64).max)
    before[order[1:]], after[order[:-1]] = apart, apart
    return before, after


def trailing_variance(
    log: DataFrame,
    windows: Sequence[int],
    value: str | Sequence[str],
    by: Sequence[str] = ("sn", "memory", "rankid", "bankid"),
    time: str = "t",
    weight: Column | None = None,
    strategy: str = "halo",
    chunk_seconds: int = scan.SECOND_GRAIN_CHUNK,
) -> DataFrame:
    """Population variance of the values in the past W minutes: ``var_<W>m``, null without values.

    Several values are read in one pass: ``<value>_var_<W>m``.
    ``weight`` tells how many log rows a row stands for, 1 if it is missing or less. Equal values of a second
    are added up first. A chunk is sorted once and read as a stream of batches, of which a task keeps twice its longest
    window; the moments of a window are put together
    from those of halves, quarters, ... of the batch that lie inside it, for all rows and windows of a batch at a time. Parts
    are merged by their means, so nothing cancels out, and nothing outside a window plays a part in it.
    """
    values = {value: "var"} if isinstance(value, str) else {v: f"{v}_var" for v in value}
    xs = [f"_x{i}" for i in range(len(values))]
    heavy = F.lit(1) if weight is None else F.greatest(F.coalesce(weight, F.lit(0)), F.lit(1))
    rows = log.select(*by, time, *[F.col(v).cast("double").alias(x) for v, x in zip(values, xs, strict=True)], heavy.cast("double").alias("_w"))
    rows = rows.groupBy(*by, time, *xs).agg(F.sum("_w").alias("_w"))
    reach = max(windows) * MINUTE
    spread, part = chunked(rows, by, time, reach, strategy, chunk_seconds)
    cells = _cells(spread, part, by, time, [time, *xs], strategy, [*xs, "_w"])
    named = [f"{n}_{w}m" for n in values.values() for w in windows]

    def found(table: pa.Table, clock: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        weights, variances = table.column("_w").to_numpy(), []
        begins = {w: np.searchsorted(clock, clock[at] - w * MINUTE) for w in windows}
        for name in xs:
            cells = table.column(name)
            x, w = pc.fill_null(cells, 0.0).to_numpy(), np.where(pc.is_valid(cells).to_numpy(), weights, 0.0)
            with np.errstate(invalid="ignore"):
                tree = _moments(w, x, x * 0.0)  # what is no number has no deviation either
            for begin in begins.values():
                count, m2 = _between(tree, begin, at + 1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    variances.append(pa.array(m2 / count, pa.float64(), mask=count == 0))
        return variances

    out = T.StructType([*[cells.schema[c] for c in (*by, time)], *[T.StructField(n, T.DoubleType()) for n in named]])
    return cells.mapInArrow(_over_windows([*by, "_chunk"], [*by, time], reach, named, found), out)


def _cells(
    spread: DataFrame, part: Sequence[str], by: Sequence[str], time: str, order: Sequence[str], strategy: str, columns: Sequence[Column | str]
) -> DataFrame:
    """The rows of a chunk in order, with the columns a scan over windows needs."""
    if strategy == "range":
        spread = spread.repartition(*part) if part else spread.coalesce(1)
    asked = (F.col("_home") == F.col("_chunk")).alias("_asked")
    return spread.sortWithinPartitions(*by, "_chunk", *order).select(
        *by, time, "_chunk", F.col(time).cast("bigint").alias("_t"), *columns, asked
    )


#: Rows put together before their windows are worked out.
VARIANCE_ROWS = 100_000


def _over_windows(
    group: Sequence[str],
    kept: Sequence[str],
    longest: int,
    names: Sequence[str],
    work: Callable[[pa.Table, np.ndarray, np.ndarray], list[pa.Array]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to one row a group and second with what ``work`` makes of the rows, their clock and the places of the seconds' last rows.

    A group may span batches: seconds that are over are given out, and rows of the longest reach are kept for those to come.
    """

    def clock_of(table: pa.Table) -> np.ndarray:
        """Groups one after the other on one clock, further apart than any window."""
        begins = group_begins(table, group)
        t = pc.fill_null(table.column("_t"), 0).to_numpy()
        ends = np.append(begins[1:], len(t)) - 1
        lengths = t[ends] - t[begins] + longest + 1
        return t + np.repeat(np.cumsum(lengths) - lengths - t[begins], ends - begins + 1)

    def found(table: pa.Table, clock: np.ndarray, begin: int, end: int) -> pa.RecordBatch:
        """The seconds that end in rows from ``begin`` to before ``end``."""
        last = np.append(clock[1:] != clock[:-1], True)
        at = begin + np.flatnonzero((last & table.column("_asked").to_numpy())[begin:end])
        columns = [c.combine_chunks() for c in table.select(list(kept)).take(pa.array(at)).columns]
        return pa.RecordBatch.from_arrays([*columns, *work(table, clock, at)], names=[*kept, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done, due = [], 0, 0, VARIANCE_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < due:
                continue
            table = pa.Table.from_batches(held)
            clock = clock_of(table)
            # the last second may go on
            over = int(np.searchsorted(clock, clock[-1]))
            yield found(table, clock, done, over)
            begin = int(np.searchsorted(clock, clock[-1] - longest))
            rest = table.slice(begin)
            held, size, done = rest.to_batches(), rest.num_rows, over - begin
            due = max(VARIANCE_ROWS, 2 * size)
        if size:
            table = pa.Table.from_batches(held)
            yield found(table, clock_of(table), done, size)

    return run


def group_begins(table: pa.Table, group: Sequence[str]) -> np.ndarray:
    """Places of the first rows of groups of equal keys; missing keys are equal, as are missing and known times apart."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    absent = pc.is_null(table.column("_t")).to_numpy()
    new[1:] |= absent[1:] != absent[:-1]
    for name in group:
        keys = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = keys.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _merged(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations of two parts, either of which may be empty."""
    (n, mean, m2), (k, other, more) = a, b
    total = n + k
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        apart = other - mean
        share = k / total
        both = (n > 0) & (k > 0)
        joint = np.where(both, mean + apart * share, np.where(k > 0, other, mean))
        return total, joint, m2 + more + np.where(both, apart * apart * n * share, 0.0)


def _moments(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Moments of rows, of pairs of rows, of pairs of pairs and so on; a part without a partner is left out."""
    tree = [(n, mean, m2)]
    while len(n := tree[-1][0]) > 1:
        even = len(n) // 2 * 2
        tree.append(_merged([v[0:even:2] for v in tree[-1]], [v[1:even:2] for v in tree[-1]]))
    return tree


def _between(tree: list[tuple[np.ndarray, ...]], begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of squared deviations of the rows from ``begin`` up to before ``end``."""
    left = [np.zeros(len(begin)) for _ in range(3)]
    right = [np.zeros(len(begin)) for _ in range(3)]
    open_ = np.arange(len(begin))
    low, high = begin.astype(np.int64), end.astype(np.int64)
    for level in tree:
        for edge, place, result, first in ((low, low, left, False), (high, high - 1, right, True)):
            odd = np.flatnonzero((edge & 1 == 1) & (low < high))
            to, part = open_[odd], [v[place[odd]] for v in level]
            mine = [v[to] for v in result]
            for v, merged in zip(result, _merged(part, mine) if first else _merged(mine, part), strict=True):
                v[to] = merged
            if not first:
                low = low + (low & 1)
        low, high = low >> 1, high >> 1
        still = low < high
        open_, low, high = open_[still], low[still], high[still]
        if not len(open_):
            break
    count, _, m2 = _merged(left, right)
    return count, m2


def trailing_bin_sums(
    log: DataFrame,
    windows: Sequence[int],
    amounts: Mapping[str, Column],
    bin_column: str = "bin",
    step: int = 300,
    by: Sequence[str] = ("sn",),
    **how,
) -> DataFrame:
    """Trailing sums over observation bins: the amounts are added up per bin first."""
    clock = log.withColumn("_clock", F.col(bin_column) * step)
    sums = trailing_sums(clock, windows, amounts, by=by, time="_clock", **how)
    return sums.withColumn(bin_column, F.floor(F.col("_clock") / step)).drop("_clock")
