"""Trailing windows and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions import timegrid
from fleetlog.operators import alarms, bins, trailing
from fleetlog.registered.core import Tables, query, r6, rounded

ADDRESS_WINDOWS = [15, 120, 360, 720, 1440, 2880]
FLAG_WINDOWS = [120, 720, 1440, 2880]
BIN_WINDOWS = [30, 720, 1440, 2880]
DISTINCT_WINDOWS = [5, 15, 120, 720, 1440, 2880]
SPREAD_WINDOWS = [5, 30, 360, 1440, 2880, 20_160]
CATS = ["click", "error", "purchase", "signup", "view"]


def _over(windows, expr, name):
    """One RANGE aggregate per window, and the frames they need."""
    cols = ", ".join(f"{expr} OVER w{w} AS {name}_{w}m" for w in windows)
    frames = ", ".join(
        f"w{w} AS (PARTITION BY {{by}} ORDER BY t RANGE BETWEEN {w * 60} PRECEDING AND CURRENT ROW)"
        for w in windows
    )
    return cols, frames


def _trailing_sql(windows, expr, name, by="sn", keep="sn, t", source="ev"):
    cols, frames = _over(windows, expr, name)
    return f"SELECT DISTINCT {keep}, {cols} FROM {source} WINDOW {frames.format(by=by)}"


@query(_trailing_sql(ADDRESS_WINDOWS, "count(*)", "cnt"), "ev")
def trailing_count(x: Tables):
    return trailing.trailing_count(x.ev(), ADDRESS_WINDOWS)


@query(_trailing_sql(ADDRESS_WINDOWS, "sum(k::HUGEINT)", "cnt"), "ev")
def trailing_count_weighted(x: Tables):
    return trailing.trailing_count(x.ev(), ADDRESS_WINDOWS, weight=F.col("k"))


def _change_sql(windows, sums):
    """Sums now, and now minus those at the oldest second in the window."""
    names = [f"{a}_{w}m" for a in sums for w in windows]
    inner = ", ".join(
        f"CAST(sum({e}) OVER w{w} AS BIGINT) AS {a}_{w}m" for a, e in sums.items() for w in windows
    )
    firsts = ", ".join(
        f"CASE WHEN first_t < t - {w * 60} THEN {a}_{w}m - first({a}_{w}m) OVER w{w} ELSE {a}_{w}m END AS {a}_{w}m_change"
        for a in sums
        for w in windows
    )
    _, frames = _over(windows, "", "")
    frames = frames.format(by="sn")
    return f"""WITH c AS (SELECT DISTINCT sn, t, min(t) OVER (PARTITION BY sn) AS first_t, {inner} FROM flags WINDOW {frames})
    SELECT sn, t, {', '.join(names)}, {firsts} FROM c WINDOW {frames}"""


_FLAGS = (
    "WITH flags AS (SELECT sn, t, "
    + ", ".join(f"CASE WHEN cat = '{c}' THEN 1 ELSE 0 END AS {c}" for c in CATS)
    + " FROM ev), "
)


@query(_FLAGS + _change_sql(ADDRESS_WINDOWS, {"cnt": "1"})[5:], "ev")
def trailing_count_change(x: Tables):
    return trailing.trailing_count(x.ev(), ADDRESS_WINDOWS, change=True)


def _flag_amounts():
    return {c: F.when(F.col("cat") == c, 1).otherwise(0) for c in CATS}


@query(
    _FLAGS
    + _change_sql([120, 720, 1440, 2880], {c: c for c in CATS})[5:].split("SELECT sn, t, ", 1)[0]
    + "SELECT sn, t, "
    + ", ".join(f"{c}_{w}m" for c in CATS for w in [120, 720, 1440, 2880])
    + " FROM c",
    "ev",
)
def trailing_sum(x: Tables):
    return trailing.trailing_sums(x.ev(), [120, 720, 1440, 2880], _flag_amounts())


@query(_FLAGS + _change_sql(FLAG_WINDOWS, {c: c for c in CATS})[5:], "ev")
def trailing_sum_change(x: Tables):
    return trailing.trailing_sums(x.ev(), FLAG_WINDOWS, _flag_amounts(), change=True)


@query(
    "SELECT DISTINCT sn, t, "
    + ", ".join(f"round(sum(v) OVER w{w}, 6) AS v_{w}m" for w in [120, 720, 1440, 2880])
    + " FROM ev WINDOW "
    + ", ".join(f"w{w} AS (PARTITION BY sn ORDER BY t RANGE BETWEEN {w * 60} PRECEDING AND CURRENT ROW)" for w in [120, 720, 1440, 2880]),
    "ev",
)
def trailing_sum_of_fractions(x: Tables):
    found = trailing.trailing_sums(x.ev(), FLAG_WINDOWS, {"v": F.col("v")})
    return rounded(found, [f"v_{w}m" for w in FLAG_WINDOWS])


@query(
    "WITH b AS (SELECT sn, bin, bin * 300 AS t, count(*) FILTER (cat = 'error') AS n FROM binned GROUP BY sn, bin) SELECT sn, bin, "
    + ", ".join(f"CAST(sum(n) OVER w{w} AS BIGINT) AS n_{w}m" for w in BIN_WINDOWS)
    + " FROM b WINDOW "
    + ", ".join(f"w{w} AS (PARTITION BY sn ORDER BY t RANGE BETWEEN {w * 60} PRECEDING AND CURRENT ROW)" for w in BIN_WINDOWS),
    "binned",
)
def trailing_sum_of_bins(x: Tables):
    error = F.when(F.col("cat") == "error", 1).otherwise(0)
    return trailing.trailing_bin_sums(x.binned(), BIN_WINDOWS, {"n": error})


@query("WITH flags AS (SELECT 0 AS sn, t FROM ev), " + _change_sql(ADDRESS_WINDOWS, {"cnt": "1"})[5:], "ev")
def trailing_change_of_one_machine(x: Tables):
    """All events on one machine: thousands of rows in a window."""
    return trailing.trailing_count(x.ev().withColumn("sn", F.lit(0)), ADDRESS_WINDOWS, change=True)


@query(
    "SELECT DISTINCT t, "
    + ", ".join(f"round(ln(1 + var_pop(v) OVER w{w}), 6) AS log_var_{w}m" for w in FLAG_WINDOWS)
    + " FROM ev WINDOW "
    + ", ".join(f"w{w} AS (ORDER BY t RANGE BETWEEN {w * 60} PRECEDING AND CURRENT ROW)" for w in FLAG_WINDOWS),
    "ev",
)
def trailing_variance_of_one_machine(x: Tables):
    found = trailing.trailing_variance(x.ev().withColumn("sn", F.lit(0)), FLAG_WINDOWS, "v", by=["sn"])
    return found.select("t", *_log_variances())


@query(
    _trailing_sql([5, 15, 120, 720, 1440, 2880], "count(DISTINCT k)", "distinct"), "ev"
)
def trailing_distinct(x: Tables):
    return trailing.trailing_distinct(x.ev(), [5, 15, 120, 720, 1440, 2880], "k")


@query(
    _trailing_sql(DISTINCT_WINDOWS, "count(DISTINCT (bankid, row))", "cells", source="addr"), "addr"
)
def trailing_distinct_cells(x: Tables):
    cell = F.struct("bankid", "row")
    return trailing.trailing_distinct(x.addr(), DISTINCT_WINDOWS, cell, "cells")


@query(
    _trailing_sql([1440, 2880], "count(DISTINCT hour)", "hours", source="(SELECT *, t // 3600 AS hour FROM ev)"), "ev"
)
def trailing_active_hours(x: Tables):
    hour = timegrid.elapsed_hours(F.col("t"), 0)
    return trailing.trailing_distinct(x.ev(), [1440, 2880], hour, "hours")


_SPREAD_BY = "sn, memory, rankid, bankid"


@query(
    f"SELECT DISTINCT {_SPREAD_BY}, t, "
    + ", ".join(f"round(var_pop(row) OVER w{w}, 6) AS var_{w}m" for w in SPREAD_WINDOWS)
    + " FROM addr WINDOW "
    + ", ".join(f"w{w} AS (PARTITION BY {_SPREAD_BY} ORDER BY t RANGE BETWEEN {w * 60} PRECEDING AND CURRENT ROW)" for w in SPREAD_WINDOWS),
    "addr",
)
def trailing_variance(x: Tables):
    found = trailing.trailing_variance(x.addr(), SPREAD_WINDOWS, "row")
    return rounded(found, [f"var_{w}m" for w in SPREAD_WINDOWS])


def _log_variances():
    """Variances of amounts with two decimals often lie right between two rounded ones; their logarithms do not."""
    return [r6(F.log(F.col(f"var_{w}m") + 1)).alias(f"log_var_{w}m") for w in FLAG_WINDOWS]


@query(
    "SELECT DISTINCT sn, t, "
    + ", ".join(f"round(ln(1 + var_pop(v) OVER w{w}), 6) AS log_var_{w}m" for w in FLAG_WINDOWS)
    + " FROM ev WINDOW "
    + ", ".join(f"w{w} AS (PARTITION BY sn ORDER BY t RANGE BETWEEN {w * 60} PRECEDING AND CURRENT ROW)" for w in FLAG_WINDOWS),
    "ev",
)
def trailing_variance_of_fractions(x: Tables):
    found = trailing.trailing_variance(x.ev(), FLAG_WINDOWS, "v", by=["sn"])
    return found.select("sn", "t", *_log_variances())


@query(
    """WITH b AS (SELECT sn, bin, count(*) AS n FROM binned GROUP BY sn, bin)
    SELECT sn, bin, n, lag(n, 10) OVER w AS n_lag10, lag(n, 50) OVER w AS n_lag50 FROM b WINDOW w AS (PARTITION BY sn ORDER BY bin)""",
    "binned",
)
def shift_bins(x: Tables):
    counts = x.binned().groupBy("sn", "bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.shift_bins(counts, ["n"], [10, 50])


@query(
    """WITH d AS (SELECT sn, t, min(t // 86400) AS bin FROM ev GROUP BY sn, t),
    s AS (SELECT sn, bin, t - lag(t, 5) OVER w AS s5, t - lag(t, 50) OVER w AS s50 FROM d WINDOW w AS (PARTITION BY sn ORDER BY t))
    SELECT sn, bin, round(avg(s5), 6) AS since_5_mean, round(stddev_samp(s5), 6) AS since_5_std, max(s5) AS since_5_max,
    round(avg(s50), 6) AS since_50_mean, round(stddev_samp(s50), 6) AS since_50_std, max(s50) AS since_50_max
    FROM s GROUP BY sn, bin""",
    "ev",
)
def time_since_nth_last(x: Tables):
    daily = x.ev().withColumn("bin", F.floor(F.col("t") / 86_400))
    found = bins.time_since_nth_last(daily, [5, 50])
    return rounded(found, [f"since_{n}_{s}" for n in (5, 50) for s in ("mean", "std")])


@query(
    """SELECT id, CAST(last_value(k7 IGNORE NULLS) OVER (PARTITION BY sn ORDER BY t, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS k7 FROM ev_null""",
    "ev_null",
)
def forward_fill(x: Tables):
    log = x.ev_null().withColumn("k7", F.when(F.col("id") % 2 == 0, F.coalesce("k7", F.lit(-1))).otherwise(F.col("k7")))
    return bins.forward_fill(log, ["k7"], sentinel=-1).select("id", "k7")


@query(
    """SELECT id, gap, CAST(least(gap // 120 + 1, 5040) AS VARCHAR) AS time_bin_id FROM
    (SELECT id, coalesce(t - lag(t) OVER (PARTITION BY sn ORDER BY t, id), 0) AS gap FROM ev)""",
    "ev",
)
def gap_to_previous(x: Tables):
    gaps = bins.gap_to_previous(x.ev().select("id", "sn", "t"))
    slot = timegrid.digitize(F.col("gap"), 120, 7 * 86_400)
    return gaps.select("id", "gap", slot.cast("string").alias("time_bin_id"))


@query(
    """SELECT sn, min(t) AS t, arg_min(id, (t, id)) AS id, CAST(arg_min(k, (t, id)) AS BIGINT) AS k
    FROM ev WHERE k >= 60 GROUP BY sn""",
    "ev",
)
def first_alarm(x: Tables):
    return alarms.first_alarm(x.ev().where("k >= 60").select("sn", "t", "id", "k"))


@query(
    """WITH RECURSIVE ev AS (SELECT user_id AS sn, epoch_us(ts) // 1000000 AS t FROM events),
    kept AS (SELECT sn, min(t) AS t FROM ev GROUP BY sn
    UNION ALL SELECT sn, nt FROM (SELECT k.sn, (SELECT min(e.t) FROM ev e WHERE e.sn = k.sn AND e.t >= k.t + 604800) AS nt
      FROM kept k) WHERE nt IS NOT NULL)
    SELECT sn, t FROM kept""",
)
def alarm_cooldown(x: Tables):
    return alarms.alarm_cooldown(x.ev().select("sn", "t"))


@query(
    """WITH c AS (SELECT DISTINCT sn, bin, t, count(*) OVER (PARTITION BY sn ORDER BY t RANGE BETWEEN 7200 PRECEDING
      AND CURRENT ROW) AS cnt_120m FROM binned)
    SELECT sn, bin, max(cnt_120m) AS cnt_120m_max FROM c GROUP BY sn, bin""",
    "binned",
)
def bin_trailing_max(x: Tables):
    """The flagship: events -> windows -> trailing counts -> one row per machine and window."""
    log = x.binned()
    counts = trailing.trailing_count(log, [120])
    seconds = bins.distinct_event_times(log)
    return bins.bin_stats(seconds.join(counts, ["sn", "t"]), {"cnt_120m": ["max"]})
