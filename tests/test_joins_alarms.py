"""Time joins and alarms on literals and against plain loops."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetlog.operators import alarms, evaluate, joins, lookback

DAY = 86_400


def test_two_failures_double_or_nearest(spark):
    rows_ = spark.createDataFrame([(1, 1, 0), (2, 1, 5 * DAY), (3, 2, 0)], "id int, sn int, t long")
    failures = spark.createDataFrame([(1, 4 * DAY), (1, 6 * DAY), (9, 1)], "sn int, failure_t long")
    both = joins.time_to_failure_label(rows_, failures)
    assert rows(both, "id", "days_to_failure") == [(1, 4.0), (1, 6.0), (2, 1.0), (3, None)]
    near = joins.time_to_failure_label(rows_, failures, nearest=True)
    assert rows(near, "id", "days_to_failure") == [(1, 4.0), (2, 1.0), (3, None)]


def test_label_is_at_minute_resolution(spark):
    rows_ = spark.createDataFrame([(1, 1, 130), (2, 1, 179), (3, 1, 180)], "id int, sn int, t long")
    failures = spark.createDataFrame([(1, 121)], "sn int, failure_t long")
    got = joins.time_to_failure_label(rows_, failures)
    assert rows(got, "id", "hours_to_failure") == [(1, 0.0), (2, 0.0), (3, None)]


def test_lookback_borders_and_empty_ticket(spark):
    tickets = spark.createDataFrame([(7, 1, 10 * DAY), (8, 2, 10 * DAY)], "ticket_id int, sn int, fault_t long")
    logs = spark.createDataFrame([(1, 1, 5 * DAY), (2, 1, 5 * DAY + 1), (3, 1, 10 * DAY), (4, 1, 10 * DAY + 1)], "id int, sn int, t long")
    got = joins.lookback_join(tickets, logs, days=5)
    assert rows(got, "ticket_id", "id") == [(7, 2), (7, 3), (8, None)]
    counts = joins.lookback_count(logs, tickets, 5 * DAY)
    assert rows(counts, "ticket_id", "n") == [(7, 3), (8, 0)]
    stats = {r.ticket_id: r for r in lookback.lookback_time_stats(logs, tickets, 5).collect()}
    assert (stats[7].gap_min, stats[7].gap_median, stats[7].gap_std) == (5 * DAY - 1, 5 * DAY - 1, 0.0)
    assert stats[8].gap_min is None and stats[8].rel_mean is None


def test_time_stats_count_ties(spark):
    tickets = spark.createDataFrame([(7, 1, 1000)], "ticket_id int, sn int, fault_t long")
    logs = spark.createDataFrame([(1, 10), (1, 10), (1, 10), (1, 100)], "sn int, t long")
    r = lookback.lookback_time_stats(logs, tickets, 1).first()
    assert (r.gap_min, r.gap_max, r.gap_mean, r.gap_median) == (0.0, 90.0, 30.0, 0.0)
    assert r.rel_mean == pytest.approx(0.0325)


def test_alarm_match_is_strict(spark):
    t = 20 * DAY
    a = spark.createDataFrame([(1, 1, t - 7 * DAY), (2, 1, t - 7 * DAY + 1), (3, 1, t - 1), (4, 1, t)], "id int, sn int, t long")
    f = spark.createDataFrame([(1, t)], "sn int, failure_t long")
    assert rows(joins.alarm_failure_match(a, f), "id", "hit") == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_match_takes_the_next_failure_once(spark):
    a = spark.createDataFrame([(1, 1, 100)], "id int, sn int, t long")
    f = spark.createDataFrame([(1, 160), (1, 400), (1, 400)], "sn int, failure_t long")
    assert rows(joins.alarm_failure_match(a, f), "hit", "true_min") == [(1, 1.0)]


def test_cooldown_against_loop(spark):
    rng = random.Random(4)
    data = [(rng.choice("aab"), rng.randrange(3_000)) for _ in range(500)]
    want = []
    for sn in "ab":
        last = None
        for t in sorted(t for s, t in data if s == sn):
            if last is None or t >= last + 100:
                want.append((sn, t))
                last = t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = rows(alarms.alarm_cooldown(spark.createDataFrame(data, "sn string, t long"), 100))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == sorted(want)


def test_first_alarm_tie(spark):
    df = spark.createDataFrame([(1, 5, 9, "x"), (1, 5, 2, "y"), (1, 6, 1, "z")], "sn int, t long, id int, c string")
    assert rows(alarms.first_alarm(df)) == [(1, 5, 2, "y")]


def test_no_alarms_no_failures(spark):
    a = spark.createDataFrame([], "sn int, t long, id int")
    f = spark.createDataFrame([], "sn int, failure_t long")
    r = alarms.alarm_f1(a, f).first()
    assert (r.hits, r.alarms, r.failures, r.precision, r.recall, r.f1) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_scores_on_empty_denominators(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    r = evaluate.binary_f1(df, "s", "y", 0.5).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    b = evaluate.best_f1_threshold(df, "s", "y").first()
    assert (b.best_f1, b.best_threshold) == (0.0, 0.0)
    assert evaluate.pr_auc(df, "s", "y").first().pr_auc == 0.0


def test_thresholds_hit_scores_exactly(spark):
    step = 0.9 / 511
    data = [(i * step, i % 2) for i in range(0, 512, 7)] + [(0.95, 1), (-0.1, 0)]
    df = spark.createDataFrame(data, "s double, y int")
    got = {r.i: r for r in evaluate.f1_over_thresholds(df, "s", "y", 0.0, 0.9, 512).collect()}
    for i in range(512):
        th = i * step
        tp = sum(1 for s, y in data if y == 1 and s > th)
        fp = sum(1 for s, y in data if y == 0 and s > th)
        fn = sum(1 for s, y in data if y == 1 and s <= th)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        assert got[i].f1 == pytest.approx(f1)


def test_hot_machine_join_is_spread_over_days(spark):
    """The equi-join key of a time join holds the day, not the machine alone."""
    logs = spark.createDataFrame([(1, 1)], "sn int, t long")
    tickets = spark.createDataFrame([(7, 1, 10)], "ticket_id int, sn int, fault_t long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = joins.lookback_join(tickets, logs, keep_empty=False)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("slot" in line for line in exchanges)


def test_memory_table_from_raw_logs(spark):
    from fleetlog.operators.dictionary import fit_dictionary
    from fleetlog.plans import memory_faults as mf

    def raw(data, columns):
        return spark.createDataFrame(data, columns)

    address = raw(
        [
            (1, "server_1", "2019/01/01 00:00:10", 0, 0, 1, 5, 7, 0, 1),
            (2, "server_1", "2019/01/01 00:04:00", -1, 0, 1, 6, 7, 0, 1),
            (3, "server_1", "2019/01/01 00:06:00", 1, 0, 1, 6, 7, 9, 1),
            (4, "server_2", "2019/01/01 00:00:10", 0, 0, 1, 5, 7, 0, 1),
        ],
        "id int, serial_number string, collect_time string, memory int, rankid int, bankid int, row int, col int, vendor int, manufacturer int",
    )
    mce = raw(
        [(1, "server_1", "2019/01/01 00:00:20", "ab", 1), (2, "server_1", "2019/01/01 00:00:40", None, None)],
        "id int, serial_number string, collect_time string, mca_id string, transaction int",
    )
    kernel = raw(
        [(1, "server_1", "2019/01/01 00:00:30", 1, None), (2, "server_1", "2019/01/01 00:07:00", 1, 1)],
        "id int, serial_number string, collect_time string, ke int, sel int",
    )
    failures = spark.createDataFrame([(1, mf.timegrid.ORIGIN_2019 + 600)], "sn long, failure_t long")
    m = mf.on_grid(mce)
    table = mf.memory_table(
        mf.prepare_address(mf.on_grid(address)),
        mf.prepare_mce(m, fit_dictionary(m, "mca_id", "t")),
        mf.on_grid(kernel),
        failures,
        flags=["ke", "sel"],
    )
    got = {(r.sn, r.bin): r for r in table.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert (a.cnt_15m_max, b.cnt_15m_max, a.memory_5m_max, b.memory_15m_max) == (2, 3, 1, 2)
    assert (a.cell_5m_max, b.row_15m_max) == (2, 3)
    assert (a.vendor_0_max, b.vendor_0_max, a.manufacturer_1_max) == (1.0, 1.0, 1.0)
    assert (a.mca_5m_max, a.kinds_15m_max, a.tx1_30m, c.mca_5m_max) == (1, 1, 2, 0)
    assert (a.ke_120m_max, b.ke_120m_max, b.sel_120m_max, c.ke_120m_max) == (1, 2, 1, 0)
    assert (a.hours_to_failure, b.hours_to_failure, c.hours_to_failure) == (0.1, 4 / 60, None)
    assert (a.month, a.global_day) == (1, 0)


def test_counts_at_anchors_make_no_pairs(spark):
    logs = spark.createDataFrame([(1, t, "ab"[t % 2]) for t in range(0, 2000, 7)] + [(None, 5, "a")], "sn bigint, t bigint, cat string")
    anchors = spark.createDataFrame([(10, 1, 500), (11, 1, 0), (12, 1, 5000), (13, 2, 7), (14, None, 6), (15, 1, None)], "ticket_id bigint, sn bigint, fault_t bigint")
    found = {r.ticket_id: (r.n_a, r.n_b) for r in joins.lookback_histogram(logs, anchors, 100, "cat", ["a", "b"]).collect()}
    inside = [t for t in range(0, 2000, 7) if 400 <= t <= 500]
    assert found == {10: (sum(t % 2 == 0 for t in inside), sum(t % 2 == 1 for t in inside)), 11: (1, 0), 12: (0, 0), 13: (0, 0), 14: (1, 0), 15: (0, 0)}


def test_look_back_statistics_are_read_in_one_pass(spark, monkeypatch):
    """F16, F17: no round for each digit of a value; the numbers of a plain loop, over several chunks and machines without an id."""
    rng = random.Random(5)
    logs = [(rng.choice([1, 2, None]), rng.randrange(12 * DAY) // 900 * 900, rng.choice([None, float("nan"), -2.5, 7.0, 1e9, rng.random()])) for _ in range(500)]
    tickets = [(i, rng.choice([1, 2, 3, None]), rng.randrange(13 * DAY)) for i in range(60)] + [(60, 1, None)]
    log = spark.createDataFrame(logs, "sn int, t long, v double")
    asked = spark.createDataFrame(tickets, "ticket_id int, sn int, fault_t long")
    written = []
    stored = lookback.stored
    monkeypatch.setattr(lookback, "stored", lambda df, name: written.append(name) or stored(df, name))
    times = {r.ticket_id: r for r in lookback.lookback_time_stats(log, asked, 3).collect()}
    assert not written
    medians = {r.ticket_id: r.q for r in lookback.lookback_quantile(log, asked, "v", {"q": 0.3}, 3).collect()}
    assert len(written) <= 3
    for i, sn, at in tickets:
        mine = [] if at is None else sorted(((t, v) for m, t, v in logs if m == sn and at - 3 * DAY < t <= at), key=lambda r: r[0])
        r = times[i]
        if not mine:
            assert r.rel_min is None and r.gap_mean is None and r.gap_median is None
        else:
            t = np.array([t for t, _ in mine])
            assert (r.rel_min, r.rel_max) == (t[0] / at, t[-1] / at)
            assert np.allclose([r.rel_mean, r.rel_median, r.rel_std], [t.mean() / at, np.median(t) / at, t.std() / at])
            gaps = np.diff(t)
            if len(gaps):
                assert (r.gap_min, r.gap_max, r.gap_median) == (gaps.min(), gaps.max(), np.median(gaps))
                assert np.allclose([r.gap_mean, r.gap_std], [gaps.mean(), gaps.std()])
        values = sorted((v for _, v in mine if v is not None), key=lambda v: (v != v, v))
        if not values:
            assert medians[i] is None
        else:
            place = 0.3 * (len(values) - 1)
            low, high = values[int(np.floor(place))], values[int(np.ceil(place))]
            want = low + (place - np.floor(place)) * (high - low)
            assert medians[i] == want or (want != want and medians[i] != medians[i]) or abs(medians[i] - want) < 1e-9 * abs(want)


def test_aggregated_families_are_stored_without_another_shuffle(spark, capsys):
    """a family that an aggregation by the key has placed is written where it is, and joined without an exchange."""
    from fleetlog.sources.logs import bucketed

    data = [(i % 7 if i % 11 else None, i % 50, i) for i in range(900)]
    log = spark.createDataFrame(data, "sn long, bin long, v long")
    key = ["sn", "bin"]
    family = log.groupBy(*key).agg(F.max("v").alias("v_max"))
    plain = bucketed(family, "family", key)
    placed = bucketed(family, "family", key, placed=True)
    assert rows(placed) == rows(plain) == rows(family)
    joined = bucketed(log.groupBy(*key).agg(F.min("v").alias("v_min")), "base", key, placed=True).join(placed.hint("merge"), key, "left")
    joined.explain("simple")
    assert "Exchange" not in capsys.readouterr().out
    low = {}
    for sn, at, v in data:
        low.setdefault((sn, at), []).append(v)
    want = sorted(((*k, min(v), max(v) if k[0] is not None else None) for k, v in low.items()), key=str)
    assert sorted((tuple(r) for r in joined.collect()), key=str) == want


def test_identifiers_and_transactions_are_counted_in_one_pass(spark):
    """one family with the columns of both, null identifiers left out."""
    from fleetlog.plans import memory_faults as mf

    data = [(1, 0, 0, "a", 1), (1, 60, 0, None, 2), (1, 301, 1, "b", None), (None, 5, 0, "a", 3)]
    log = spark.createDataFrame(data, "sn long, t long, bin long, mca_id string, transaction int").withColumn("edge", F.col("bin") * 300 + 300)
    families = mf.mce_families(log, 0)
    assert set(families) == {"mce_volume", "identifiers", "transactions"}
    found = {(r.sn, r.bin): (r.mca_5m_max, r.mca_15m_max, r.kinds_15m_max) for r in families["identifiers"].collect()}
    assert found == {(1, 0): (1, 1, 2), (1, 1): (1, 2, 2), (None, 0): (1, 1, 1)}
