"""Structured Streaming jobs over a log replay.

Minutes and windows are right-closed, streaming windows are left-closed: the event time used for
windows is one microsecond earlier, made before the watermark so that the watermark stays on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetlog.operators.alarms import WEEK, keep_spaced
from fleetlog.session import shared_dir

EVENT_TIME = "_tsx"


def with_event_time(log: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    shifted = F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    return log.withColumn(EVENT_TIME, shifted).withWatermark(EVENT_TIME, delay)


def _right_edge(step: int) -> Column:
    """End, in seconds, of the right-closed window of a row; the shifted time lies below it."""
    return ((F.floor(F.unix_micros(EVENT_TIME) / F.lit(step * 1_000_000.0)) + 1) * step).cast("bigint")


#: The state of ``transformWithState`` lives in RocksDB.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Timed(StatefulProcessor):
    """A processor with at most one event-time timer a key."""

    def _wake(self, at: int, now: int, instead: bool = False) -> None:
        """Wake at that millisecond of the watermark, now being ``now``; or earlier if it is to already, unless ``instead``."""
        waiting = [t for t in self.handle.listTimers() if t > now]
        if instead or not waiting or at < min(waiting):
            for t in waiting:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class MinuteRows(_Timed):
    """Keeps the rows of open minutes and gives out a minute's rows, in order, when the watermark has passed it."""

    def __init__(self, schema: T.StructType, order: Sequence[str]):
        self.schema, self.order = schema, list(order)

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            some = batch[self.schema.names]
            self.rows.appendList(_plain(some, self.schema))
            least = int(some["minute_end"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first * 1000, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=self.schema.names)
        closed = held["minute_end"] * 1000 <= now
        out, still = held[closed], held[~closed]
        if len(still):
            self.rows.put(_plain(still, self.schema))
            self._wake(int(still["minute_end"].min()) * 1000, now)
        else:
            self.rows.clear()
        out = out.sort_values(["minute_end", *self.order], kind="stable")
        yield out.assign(place=out.groupby("minute_end").cumcount() + 1)


def _plain(rows: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows of Python values, missing ones as None; pandas makes fractions of whole numbers beside missing ones."""
    columns = []
    for f in schema.fields:
        kind = int if isinstance(f.dataType, T.IntegralType) else lambda v: v
        columns.append([None if pd.isna(v) else kind(v) for v in rows[f.name].tolist()])
    return list(zip(*columns, strict=True))


def minute_batches(
    log: DataFrame, columns: Sequence[str], order: Sequence[str], shard: Column, ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """The rows of every minute once it is over: ``shard, minute_end, columns, place``.

    ``columns`` are numbers and texts. Rows are spread over shards (a column) and hours, which bound what one call holds: the
    rows of an hour's minutes that are still open. Inside a minute and shard rows come in the given order, numbered from 1 by ``place``.
    A row is late, and dropped, if its time is not after the watermark: the latest time seen in earlier
    batches less ``delay``. A minute stays open until the watermark has reached its end.
    """
    timed = with_event_time(log, ts, delay)
    key = ["shard", "_hour"]
    keyed = timed.where(F.col(EVENT_TIME).isNotNull()).select(EVENT_TIME, shard.cast("bigint").alias("shard"), _right_edge(60).alias("minute_end"), *columns)
    keyed = keyed.withColumn("_hour", F.floor(F.col("minute_end") / 3600))
    kept = T.StructType([f for f in keyed.schema.fields if f.name not in (EVENT_TIME, *key)])
    out = T.StructType([*[keyed.schema[k] for k in key], *kept.fields, T.StructField("place", T.LongType())])
    return _stateful(keyed, key, MinuteRows(kept, order), out).drop("_hour")


def _stateful(rows: DataFrame, key: Sequence[str], processor: _Timed, out: T.StructType) -> DataFrame:
    """Rows by key through a processor in event time; what it gives out gets its key back."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # a micro-batch commits its changes, not its whole state
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return rows.groupBy(*key).transformWithStateInPandas(_Keyed(processor, key, out.names), out, "append", "eventTime")


class _Keyed(StatefulProcessor):
    """A processor whose rows are completed by the columns of their key."""

    def __init__(self, inner: _Timed, key: Sequence[str], names: Sequence[str]):
        self.inner, self.key, self.names = inner, list(key), list(names)

    def init(self, handle) -> None:
        self.inner.init(handle)

    def _whole(self, key: tuple, made: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in made:
            if len(rows):
                yield rows.assign(**dict(zip(self.key, key, strict=True)))[self.names]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._whole(key, self.inner.handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._whole(key, self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def close(self) -> None:
        self.inner.close()


class PaneSums(_Timed):
    """Sums per observation window of the machines of a shard, and over the windows of the past, kept as long as the longest look-back."""

    def __init__(self, amounts: Sequence[str], trailing: Mapping[str, Sequence[int]]):
        self.amounts, self.trailing = list(amounts), {a: list(w) for a, w in trailing.items()}
        self.longest = 60 * max((m for w in self.trailing.values() for m in w), default=0)
        self.names = ["machine", "edge", "done", *self.amounts]

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"{a} array<bigint>" for a in self.amounts)
        self.state = handle.getValueState("panes", f"machine array<string>, edge array<bigint>, done array<boolean>, {fields}")

    def _read(self) -> pd.DataFrame:
        held = self.state.get() if self.state.exists() else [[] for _ in self.names]
        panes = pd.DataFrame(dict(zip(self.names, (list(x) for x in held), strict=True)))
        return panes.astype({"machine": object, "edge": "int64", "done": bool, **dict.fromkeys(self.amounts, "int64")})

    def _write(self, panes: pd.DataFrame) -> None:
        self.state.update(tuple(panes[c].tolist() for c in self.names))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._read()]
        for batch in rows:
            summed = batch.groupby(["machine", "edge"], as_index=False)[self.amounts].sum()
            parts.append(summed.assign(done=False))
        # a pane that is open is in the state at most once; closed ones get no more rows
        whole = {"done": "max", **dict.fromkeys(self.amounts, "sum")}
        panes = pd.concat([p for p in parts if len(p)] or parts[:1]).groupby(["machine", "edge"], as_index=False).agg(whole)
        panes[self.amounts] = panes[self.amounts].astype("int64")
        self._write(panes)
        waiting = panes.loc[~panes["done"].astype(bool), "edge"]
        if len(waiting):
            self._wake(int(waiting.min()) * 1000, timerValues.getCurrentWatermarkInMs(), instead=True)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        panes = self._read().sort_values(["machine", "edge"], ignore_index=True)
        edges, done = panes["edge"].to_numpy(np.int64), panes["done"].to_numpy(bool)
        fresh = ~done & (edges * 1000 <= now)
        out = panes.loc[fresh, ["machine", "edge", *self.amounts]].copy()
        # machines one after the other on one clock, further apart than any window
        turn = pd.factorize(panes["machine"])[0].astype(np.int64)
        clock = edges + turn * (int(np.ptp(edges)) + self.longest + 1 if len(edges) else 0)
        for amount, windows in self.trailing.items():
            upto = np.concatenate([[0], np.cumsum(panes[amount].to_numpy(np.int64))])
            for minutes in windows:
                begin = np.searchsorted(clock, clock - 60 * minutes)
                out[f"{amount}_{minutes}m"] = (upto[np.arange(len(edges)) + 1] - upto[begin])[fresh]
        panes["done"] = done | fresh
        open_ = ~panes["done"].to_numpy(bool)
        # what no later window can reach: panes end no earlier than the watermark from now on
        kept = open_ | (edges * 1000 > now - 1000 * self.longest)
        if kept.any():
            self._write(panes[kept])
            self._wake(int(edges[open_].min()) * 1000 if open_.any() else int(edges.max() + self.longest) * 1000, now, instead=True)
        else:
            self.state.clear()
        yield out


def bin_features(
    log: DataFrame,
    amounts: Mapping[str, Column],
    by: Sequence[str] = ("sn",),
    ts: str = "ts",
    step: int = 300,
    delay: str = "0 seconds",
    trailing: Mapping[str, Sequence[int]] | None = None,
    shards: int = 256,
) -> DataFrame:
    """Per machine and observation window, once it is over: sums, keyed by the right edge of the window.

    ``trailing`` adds sums over the past minutes' windows, ``<amount>_<W>m``, given out with the window. Amounts are whole
    numbers; null ones count for nothing. Machines are spread over shards, so that a micro-batch makes a call for each shard and not for
    each machine; the state of a shard holds its machines' windows of the longest look-back, which are
    dropped when none of them can be reached any more.
    """
    timed = with_event_time(log, ts, delay)
    # the ids as one text: whole numbers beside missing ones stay what they are
    machine = F.to_json(F.struct(*by))
    shard = F.pmod(F.xxhash64(machine), F.lit(shards)).cast("bigint").alias("shard")
    rows = timed.select(EVENT_TIME, shard, machine.alias("machine"), _right_edge(step).alias("edge"), *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(n) for n, c in amounts.items()])
    trailing = trailing or {}
    sums = [f"{a}_{m}m" for a, w in trailing.items() for m in w]
    longs = [T.StructField(n, T.LongType()) for n in ("edge", *amounts, *sums)]
    found = _stateful(rows, ["shard"], PaneSums(list(amounts), trailing), T.StructType([rows.schema["shard"], T.StructField("machine", T.StringType()), *longs]))
    ids = F.from_json("machine", T.StructType([timed.schema[b] for b in by]))
    return found.select(ids.alias("_ids"), *[f.name for f in longs]).select("_ids.*", *[f.name for f in longs])


class Cooldown(_Timed):
    """The last kept alarm of a machine, forgotten when the watermark is a whole gap behind it."""

    def __init__(self, time: str, gap: int):
        self.time, self.gap = time, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        times = np.zeros(0, np.int64)
        for batch in rows:  # distinct seconds only
            times = np.union1d(times, batch[self.time].dropna().to_numpy(np.int64))
        kept, last = keep_spaced(times, last, self.gap)
        if last is not None:
            self.state.update((int(last),))
            self._wake((int(last) + self.gap) * 1000, timerValues.getCurrentWatermarkInMs(), instead=True)
        yield pd.DataFrame({self.time: kept})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # any alarm from now on is later than the watermark, so it is kept with and without this state
        self.state.clear()
        yield pd.DataFrame()


def alarm_cooldown_stream(
    alarms: DataFrame, gap: int = WEEK, machine: str = "sn", time: str = "t", ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """Online cooldown: the state is the last kept time of a machine, for as long as it can matter.

    Alarms of a machine must not arrive in an earlier batch than alarms before them; inside a
    batch they may be in any order. Alarms not after the watermark are late and dropped.
    """
    timed = with_event_time(alarms, ts, delay).select(EVENT_TIME, machine, time)
    out = T.StructType([timed.schema[machine], T.StructField(time, T.LongType())])
    return _stateful(timed, [machine], Cooldown(time, gap), out)


def run_to_table(
    stream: DataFrame, key: Sequence[str], mode: str, release: Callable[[], bool] | None = None, state: str | None = None
) -> DataFrame:
    """Run over everything available and return the result as a table.

    Every micro-batch is written below its own number, so a batch that is repeated after a
    failure replaces itself; for updated keys the latest batch wins. ``release`` puts the next
    piece of history in place and tells whether there was one: pieces are run in that order. ``state`` is a
    folder for the state, to go on from or to look into.
    """
    spark = stream.sparkSession
    out, state = shared_dir(spark, "stream-out"), state or shared_dir(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run() -> None:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", state)
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    if release is None:
        run()
    else:
        while release():
            run()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).parquet(out)
    if mode == "append":
        return written.drop("batch")
    rest = [f.name for f in stream.schema.fields if f.name not in key]
    latest = written.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return latest.select(*key, "_last.*")


def events_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet"
) -> DataFrame:
    """The Parquet files of a folder whose names fit, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
