"""Streaming jobs over history that is released week by week: several micro-batches, a watermark
of minutes, and state that is dropped behind it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions import timegrid
from fleetlog.registered.core import ORIGIN, Tables, query
from fleetlog.session import shared_dir, stored
from fleetlog.sources import logs
from fleetlog.streaming import jobs


WEEK_US = 7 * 86_400 * 1_000_000
DELAY = "10 minutes"


SHARDS = 4
END = "the end"


def _weeks(rows, write):
    """What releases the next week of ``rows`` (with ``ts``), and at last a row a day behind them, which closes every window.

    ``write`` puts rows where the stream reads.
    """
    week = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / WEEK_US)
    ends = rows.agg(F.min(week).alias("lo"), F.max(week).alias("hi"), F.max("ts").alias("last")).first()
    pieces = iter([rows.where(week == w) for w in range(ends.lo, ends.hi + 1)] if ends.lo is not None else [])
    closing = iter([] if ends.lo is None else [ends.last])

    def release() -> bool:
        piece = next(pieces, None)
        if piece is None:
            last = next(closing, None)
            if last is None:
                return False
            of = {"ts": (F.lit(last) + F.expr("INTERVAL 1 DAY")).cast(rows.schema["ts"].dataType), "event_type": F.lit(END)}
            piece = rows.sparkSession.range(1).select(*[of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        write(piece)
        return True

    return release


def _events(x: Tables):
    """The event log as a stream, with the batch view's columns; and what releases its next week."""
    raw = x.table("events")
    live = shared_dir(x.spark, "live")
    raw.limit(0).write.parquet(live)
    stream = jobs.events_stream(x.spark, live, raw.schema).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("sn"),
        F.col("ts").cast("timestamp").alias("ts"),
        timegrid.unix_time(F.col("ts")).alias("t"),
        F.col("event_type").alias("cat"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return stream, _weeks(raw, lambda piece: piece.write.mode("append").parquet(live))


_MINUTE = "CAST(ceil(epoch_us(ts) / 60000000.0) AS BIGINT) * 60"


@query(
    f"""WITH l AS (SELECT CASE WHEN cat IN ('click', 'view') THEN 'address' WHEN cat = 'error' THEN 'mce' ELSE 'kernel' END AS log, id, sn, t, {_MINUTE} AS minute_end,
      CASE WHEN cat IN ('click', 'view') THEN '{{"row":' || k || ',"col":' || CAST(floor(v) AS INTEGER) || '}}'
        WHEN cat = 'error' THEN '{{"mca_id":"m' || k || '","transaction":' || (k % 4) || '}}' ELSE '{{"cat":"' || cat || '"}}' END AS body FROM ev)
    SELECT log, id, sn, t, minute_end, body, row_number() OVER (PARTITION BY minute_end, sn % {SHARDS} ORDER BY log, t, id) AS place FROM l""",
    "ev",
)
def minute_replay_source(x: Tables):
    """Three logs of different columns, replayed as one stream and given out minute by minute."""
    base = x.ev().join(x.table("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), "id")
    common = ["id", "sn", "t", "ts"]
    base = stored(base, "replay")  # read for each week and log
    parts = {
        "address": (F.col("cat").isin("click", "view"), [F.col("k").alias("row"), F.floor("v").cast("int").alias("col")]),
        "mce": (F.col("cat") == "error", [F.concat(F.lit("m"), "k").alias("mca_id"), (F.col("k") % 4).alias("transaction")]),
        "kernel": (F.col("cat").isin("purchase", "signup") | F.col("cat").isNull(), [F.col("cat")]),
    }
    paths = {name: shared_dir(x.spark, f"replay-{name}") for name in parts}
    views = {name: base.where(which).select(*common, *own) for name, (which, own) in parts.items()}
    for name, view in views.items():
        view.limit(0).write.parquet(paths[name])

    def write(piece):
        for name, (which, own) in parts.items():
            piece.where(which).select(*common, *own).write.mode("append").parquet(paths[name])

    stream = logs.replay_logs(x.spark, {name: (paths[name], view.schema) for name, view in views.items()}, common, files_per_trigger=1000)
    found = jobs.minute_batches(stream, ["log", "id", "sn", "t", "body"], ["log", "t", "id"], F.coalesce(F.col("sn") % SHARDS, F.lit(0)), delay=DELAY)
    return jobs.run_to_table(found, ["id"], "append", _weeks(base, write)).drop("shard")


@query(f"SELECT sn % {SHARDS} AS shard, {_MINUTE} AS minute_end, cat, id, sn, t, row_number() OVER (PARTITION BY {_MINUTE}, sn % {SHARDS} ORDER BY cat, t, id) AS place FROM ev", "ev")
def stream_minute_batches(x: Tables):
    events, release = _events(x)
    found = jobs.minute_batches(events, ["cat", "id", "sn", "t"], ["cat", "t", "id"], F.coalesce(F.col("sn") % SHARDS, F.lit(0)), delay=DELAY)
    return jobs.run_to_table(found, ["id"], "append", release)


@query(
    f"""WITH b AS (SELECT sn, CAST(ceil((epoch_us(ts) - {ORIGIN}000000) / 300000000.0) AS BIGINT) * 300 + {ORIGIN} AS edge, k, cat FROM ev),
    g AS (SELECT sn, edge, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, edge AS t FROM b GROUP BY sn, edge)
    SELECT sn, edge, n, k_sum, CAST(sum(n) OVER w AS BIGINT) AS n_120m, CAST(sum(n) OVER w2 AS BIGINT) AS n_2880m, CAST(sum(k_sum) OVER w2 AS BIGINT) AS k_sum_2880m FROM g
    WINDOW w AS (PARTITION BY sn ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW),
    w2 AS (PARTITION BY sn ORDER BY t RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW)""",
    "ev",
)
def stream_bin_features(x: Tables):
    amounts = {"n": F.lit(1), "k_sum": F.col("k")}
    events, release = _events(x)
    found = jobs.bin_features(events, amounts, delay=DELAY, trailing={"n": [120, 2880], "k_sum": [2880]})
    return jobs.run_to_table(found, ["sn", "edge"], "append", release)


@query(
    """WITH RECURSIVE ev AS (SELECT user_id AS sn, epoch_us(ts) // 1000000 AS t FROM events),
    kept AS (SELECT sn, min(t) AS t FROM ev GROUP BY sn
    UNION ALL SELECT sn, nt FROM (SELECT k.sn, (SELECT min(e.t) FROM ev e WHERE e.sn = k.sn AND e.t >= k.t + 604800) AS nt
      FROM kept k) WHERE nt IS NOT NULL)
    SELECT sn, t FROM kept"""
)
def stream_alarm_cooldown(x: Tables):
    events, release = _events(x)
    return jobs.run_to_table(jobs.alarm_cooldown_stream(events, delay=DELAY), ["sn"], "append", release).where("sn is not null")
