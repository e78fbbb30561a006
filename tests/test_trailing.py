"""Trailing windows: borders, ties, strategies, leakage and independence of the layout."""

import bisect
import random
import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetlog.operators import bins, scan, trailing


def log(spark, data):
    return spark.createDataFrame(data, "id bigint, sn bigint, t bigint, k int")


def random_log(spark, n=400, machines=3, span=40_000, seed=1):
    rng = random.Random(seed)
    return [
        (i, rng.choice([1] * 5 + list(range(machines))), 1_000_000 + rng.randrange(span), rng.choice([None, 1, 2, 3, 4]))
        for i in range(n)
    ]


def brute(data, minutes):
    """Two-pointer result written out: per machine and second, over rows in [t - W, t]."""
    out = {}
    for _, sn, t, _ in data:
        inside = [r for r in data if r[1] == sn and t - 60 * minutes <= r[2] <= t]
        front = min(r[2] for r in inside)
        before = [r for r in data if r[1] == sn and front - 60 * minutes <= r[2] <= front]
        evicted = any(r[1] == sn and r[2] < t - 60 * minutes for r in data)
        n = len(inside)
        out[sn, t] = (n, n - len(before) if evicted else n, len({r[3] for r in inside} - {None}))
    return out


def test_exact_border_stays_in_the_window(spark):
    df = log(spark, [(1, 7, 1000, 1), (2, 7, 1000 + 900, 1), (3, 7, 1000 + 901, 1)])
    assert rows(trailing.trailing_count(df, [15]), "t", "cnt_15m") == [(1000, 1), (1900, 2), (1901, 2)]


def test_same_second_sees_itself(spark):
    df = log(spark, [(1, 7, 50, 1), (2, 7, 50, 2), (3, 7, 50, 2)])
    assert rows(trailing.trailing_count(df, [5])) == [(7, 50, 3)]
    assert rows(trailing.trailing_distinct(df, [5], "k")) == [(7, 50, 2)]


def test_first_eviction_is_per_machine(spark):
    df = log(spark, [(1, 1, 0, 1), (2, 1, 10_000, 1), (3, 2, 20_000, 1), (4, 2, 20_010, 1)])
    got = trailing.trailing_count(df, [5], change=True)
    assert rows(got) == [(1, 0, 1, 1), (1, 10_000, 1, 0), (2, 20_000, 1, 1), (2, 20_010, 2, 2)]


@pytest.mark.parametrize("strategy", ["halo", "range"])
@pytest.mark.parametrize("chunk", [500, 10_000_000])
def test_against_brute_force(spark, strategy, chunk):
    data = random_log(spark)
    df = log(spark, data)
    want = {w: brute(data, w) for w in (5, 60)}
    how = {"strategy": strategy, "chunk_seconds": chunk}
    counts = trailing.trailing_count(df, [5, 60], change=True, **how)
    for r in counts.collect():
        for w in (5, 60):
            assert (r[f"cnt_{w}m"], r[f"cnt_{w}m_change"]) == want[w][r.sn, r.t][:2]
    distinct = trailing.trailing_distinct(df, [5, 60], "k", **how)
    assert distinct.count() == len(want[5])
    for r in distinct.collect():
        for w in (5, 60):
            assert r[f"distinct_{w}m"] == want[w][r.sn, r.t][2]


@pytest.mark.parametrize("strategy", ["halo", "range"])
def test_variance(spark, strategy):
    data = random_log(spark, n=200)
    got = trailing.trailing_variance(log(spark, data), [60], "k", by=["sn"], strategy=strategy, chunk_seconds=900)
    for r in got.collect():
        inside = [d[3] for d in data if d[1] == r.sn and r.t - 3600 <= d[2] <= r.t and d[3] is not None]
        if inside:
            assert r.var_60m == pytest.approx(np.var(inside), abs=1e-9)
        else:
            assert r.var_60m is None


def test_features_do_not_see_the_future(spark):
    data = random_log(spark, seed=5)
    cut = sorted(d[2] for d in data)[len(data) // 2]
    whole, past = log(spark, data), log(spark, [d for d in data if d[2] <= cut])
    for f in (
        lambda d: trailing.trailing_count(d, [60], change=True, chunk_seconds=700),
        lambda d: trailing.trailing_distinct(d, [60], "k", chunk_seconds=700),
        lambda d: bins.gap_to_previous(d).select("sn", "t", "id", "gap"),
        lambda d: bins.forward_fill(d, ["k"]).select("sn", "t", "id", "k"),
    ):
        assert rows(f(whole).where(F.col("t") <= cut)) == rows(f(past))


def test_layout_does_not_matter(spark):
    data = random_log(spark, seed=9)
    found = []
    for parts, seed in ((1, 0), (4, 1), (16, 2)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        mixed = data[:]
        random.Random(seed).shuffle(mixed)
        df = log(spark, mixed).repartition(parts)
        found.append(
            (
                rows(trailing.trailing_count(df, [30], change=True, chunk_seconds=1000)),
                rows(trailing.trailing_distinct(df, [30], "k", chunk_seconds=1000)),
                rows(bins.forward_fill(df, ["k"])),
            )
        )
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2]


def test_lag_over_block_borders(spark):
    data = [(i, 1 + i % 2, 10 * i, i) for i in range(60)]
    df = scan.by_time(log(spark, data), "t", 100)
    got = scan.lagged(df, ["sn"], ["t"], {"a": ("k", 1), "b": ("k", 4)}, block=5)
    for r in got.collect():
        assert r.a == (r.k - 2 if r.k >= 2 else None)
        assert r.b == (r.k - 8 if r.k >= 8 else None)


def test_forward_fill_over_chunks_and_sentinel(spark):
    df = log(spark, [(1, 1, 10, None), (2, 1, 20, 5), (3, 1, 900, -1), (4, 1, 5000, None), (5, 2, 30, None)])
    got = bins.forward_fill(df, ["k"], sentinel=-1)
    assert rows(got, "id", "k") == [(1, None), (2, 5), (3, 5), (4, 5), (5, None)]


def test_gap_with_ties_and_chunks(spark):
    df = log(spark, [(1, 1, 10, 0), (2, 1, 10, 0), (3, 1, 10_000, 0), (4, 2, 5, 0)])
    assert rows(bins.gap_to_previous(df), "id", "gap") == [(1, 0), (2, 0), (3, 9990), (4, 0)]


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([0.5, 1.0, rng.random() * 9])) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, x double")
    for bounded in (False, True):
        got = {r.g: r for r in scan.group_quantiles(df, ["g"], "x", {"q": 0.37, "m": 0.5}, bounded=bounded).collect()}
        for g in "ab":
            xs = [x for k, x in data if k == g]
            assert got[g].q == pytest.approx(np.quantile(xs, 0.37))
            assert got[g].m == pytest.approx(np.median(xs))


def test_weighted_bin_stats(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 3), (1, 0, 8.0, 1)], "sn int, bin int, x double, n int")
    r = bins.bin_stats(df, {"x": ["mean", "median", "max"]}, weight="n").first()
    assert (r.x_mean, r.x_median, r.x_max) == (3.5, 2.0, 8.0)


def test_single_row_window_has_no_std(spark):
    df = spark.createDataFrame([(1, 0, 2.0)], "sn int, bin int, x double")
    assert bins.bin_stats(df, {"x": ["std"]}).first().x_std is None


def test_rows_without_a_machine_are_a_group_too(spark):
    df = log(spark, [(i, None, 100 * i, 1) for i in range(10)])
    small = trailing.trailing_count(df, [5], chunk_seconds=250)
    assert rows(small) == rows(trailing.trailing_count(df, [5], strategy="range"))
    assert rows(bins.gap_to_previous(df), "id", "gap") == [(i, 100 if i else 0) for i in range(10)]


@pytest.mark.parametrize("strategy", ["halo", "range"])
def test_nulls_nan_and_large_values_leave_the_window(spark, strategy):
    how = {"strategy": strategy, "chunk_seconds": 800}
    df = spark.createDataFrame([(1, 790, 5, 1.0), (1, 805, None, float("nan")), (1, 5000, 2, 2.0), (2, 805, None, None)], "sn bigint, t bigint, k int, x double")
    counts = rows(trailing.trailing_count(df, [15], weight=F.col("k"), **how))
    assert counts == [(1, 790, 5), (1, 805, 5), (1, 5000, 2), (2, 805, None)]
    sums = rows(trailing.trailing_sums(df, [15], {"x": F.col("x")}, **how), "sn", "t", "x_15m")
    assert [r[2] for r in sums if r[1] == 5000] == [2.0]
    rng = random.Random(4)
    large = [(1, i, 0, rng.random() * 1e9) for i in range(3000)] + [(1, 300_000 + i, 0, v) for i, v in enumerate((0.1, 0.35, 0.2, 0.6))]
    spread = trailing.trailing_variance(spark.createDataFrame(large, "sn bigint, t bigint, k int, x double"), [60], "x", by=["sn"], **how)
    last = spread.orderBy(F.col("t").desc()).first().var_60m
    assert last == pytest.approx(np.var([0.1, 0.35, 0.2, 0.6]), rel=1e-9)


def test_rows_without_a_machine_are_one_machine(spark):
    df = spark.createDataFrame([(None, 10, 1), (None, 20, 2), (1, 20, 2)], "sn bigint, t bigint, k int")
    found = trailing.attach(df, trailing.trailing_count(df, [5], change=True))
    assert rows(found, "sn", "t", "cnt_5m", "cnt_5m_change") == [(1, 20, 1, 1), (None, 10, 1, 1), (None, 20, 2, 2)]


def test_variance_in_one_sort(spark, capsys):
    """However many windows: rows are sorted once and no frame holds them (it was two sorts and frames a window)."""
    df = log(spark, random_log(spark))
    trailing.trailing_variance(df, [5, 30, 60, 120], "k", by=["sn"]).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and "Window" not in plan


def test_variance_of_groups_over_many_batches(spark):
    """A machine of more rows than are put together at a time, machines without an id, far values, NaN that has left."""
    n = trailing.VARIANCE_ROWS + 20_000
    far = 1e9
    value = F.when(F.col("id") == 100, float("nan")).otherwise(F.lit(far) + F.col("id") % 7)
    dense = spark.range(n).select(F.when(F.col("id") < 5_000, F.lit(None)).otherwise(F.lit(1)).cast("long").alias("sn"), "id", value.alias("v"))
    dense = dense.withColumn("t", F.floor(F.col("id") / 2))
    got = {(r.sn, r.t): r.var_60m for r in trailing.trailing_variance(dense, [60], "v", by=["sn"]).collect()}
    assert len(got) == n // 2
    for sn, t in ((1, 2_500), (1, 30_000), (1, n // 2 - 1), (None, 10), (None, 2_400)):
        lo = max(t - 3_600, 0 if sn is None else 2_500)
        inside = [i % 7 for i in range(2 * lo, 2 * t + 2)]
        if sn is None and 100 in range(2 * lo, 2 * t + 2):
            assert got[sn, t] != got[sn, t]
        else:
            assert got[sn, t] == pytest.approx(np.var(inside), rel=1e-6)


def test_several_values_are_counted_in_one_pass(spark, capsys):
    """the parts of an address are counted from one table, and one machine may fill several batches."""
    rng = random.Random(5)
    n = trailing.VARIANCE_ROWS + 20_000
    data = [(i // 3 * 2, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.randrange(40)) for i in range(n)]
    data += data[:5]
    log = spark.createDataFrame(data, "t long, a int, b string, c int").withColumn("sn", F.when(F.col("t") >= 0, F.lit(None)).cast("long"))
    got = trailing.trailing_distinct(log, {"ab": [1, 3], "c": [2]}, {"ab": ["a", "b"], "c": ["c"]}, chunk_seconds=10_000)
    got.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and "Window" not in plan and "Join" not in plan
    found = {r.t: (r.ab_1m, r.ab_3m, r.c_2m) for r in got.collect()}
    assert len(found) == len({r[0] for r in data})
    held = sorted(data, key=lambda r: r[0])
    at = [r[0] for r in held]
    for t in rng.sample(sorted(found), 300):
        window = lambda w: held[bisect.bisect_left(at, t - 60 * w) : bisect.bisect_right(at, t)]  # noqa: E731, B023
        pairs = lambda w: len({r[1:3] for r in window(w)} - {(None, None)})  # noqa: E731, B023
        assert found[t] == (pairs(1), pairs(3), len({r[3] for r in window(2)}))


def test_whole_sums_and_their_changes_span_batches(spark, capsys):
    """whole amounts, some of them missing, need no window frames of Spark."""
    rng = random.Random(6)
    n = trailing.VARIANCE_ROWS + 20_000
    data = [(i % 2, i // 2 * 3 + rng.randrange(3), rng.choice([None, None, None, rng.randrange(-9, 9)])) for i in range(n)]
    log = spark.createDataFrame(data, "sn long, t long, v int")
    got = trailing.trailing_sums(log, [0, 1, 5], {"v": F.col("v")}, change=True, chunk_seconds=50_000)
    got.explain("simple")
    assert "Window" not in capsys.readouterr().out
    found = {(r.sn, r.t): r for r in got.collect()}
    logs = {m: sorted(((t, v) for s, t, v in data if s == m), key=lambda r: r[0]) for m in (0, 1)}
    times = {m: [t for t, _ in rows_] for m, rows_ in logs.items()}

    def total(m, t, w):
        known = [v for _, v in logs[m][bisect.bisect_left(times[m], t - 60 * w) : bisect.bisect_right(times[m], t)] if v is not None]
        return sum(known) if known else None

    for m, t in rng.sample(sorted(found), 300) + [(m, times[m][0]) for m in (0, 1)]:
        for w in (0, 1, 5):
            now = total(m, t, w)
            assert found[m, t][f"v_{w}m"] == now
            change = now
            if times[m][0] < t - 60 * w:
                then = total(m, times[m][bisect.bisect_left(times[m], t - 60 * w)], w)
                change = None if now is None or then is None else now - then
            assert found[m, t][f"v_{w}m_change"] == change


def test_weighted_medians_of_windows(spark, capsys):
    """medians of rows that stand for several rows, missing values and windows without any."""
    rng = random.Random(7)
    data = [(rng.choice([None, 1, 2]), rng.randrange(60), rng.choice([None, rng.randrange(20)]), rng.randrange(4)) for _ in range(900)] + [(3, 1, None, 2), (3, 2, 5, 0)]
    log = spark.createDataFrame(data, "sn long, bin long, x long, n long")
    got = bins.bin_stats(log, {"x": ["max", "median"]}, weight="n")
    got.explain("simple")
    assert "percentile" not in capsys.readouterr().out
    want = {}
    for sn, at, x, n in data:
        cell = want.setdefault((sn, at), [[], []])
        if x is not None:
            cell[0].append(x)
            cell[1] += [x] * n
    assert {(r.sn, r.bin): (r.x_max, r.x_median) for r in got.collect()} == {
        k: (max(a, default=None), statistics.median(b) if b else None) for k, (a, b) in want.items()
    }
