"""Streams give the batch result, piece by piece; models learn an easy rule."""

import random

from conftest import rows
from pyspark.sql import functions as F

from fleetlog.operators import alarms, evaluate, models, splits
from fleetlog.registered import scoring
from fleetlog.streaming import jobs


def released(spark, live, pieces, schema):
    """A stream over a folder, and what puts the next piece of rows there."""
    spark.createDataFrame([], schema).write.parquet(live)
    queue = iter(pieces)

    def release() -> bool:
        piece = next(queue, None)
        if piece is None:
            return False
        spark.createDataFrame(piece, schema).write.mode("append").parquet(live)
        return True

    stream = jobs.events_stream(spark, live, spark.createDataFrame([], schema).schema)
    return stream.withColumn("ts", F.timestamp_seconds("t")), release


START = 1_704_067_200


def test_cooldown_released_day_by_day_forgets_silent_machines(spark, tmp_path):
    rng = random.Random(0)
    data = [(rng.randrange(3), START + rng.randrange(4 * 86_400)) for _ in range(300)] + [(9, START + 5)]
    days = [[r for r in data if (r[1] - START) // 86_400 == d] for d in range(4)]
    stream, release = released(spark, str(tmp_path / "live"), [*days, [(0, START + 20 * 86_400)]], "sn long, t long")
    folder = str(tmp_path / "state")
    got = jobs.run_to_table(jobs.alarm_cooldown_stream(stream, gap=50_000), ["sn"], "append", release, state=folder)
    assert rows(got) == rows(alarms.alarm_cooldown(spark.createDataFrame([*data, (0, START + 20 * 86_400)], "sn long, t long"), 50_000))
    left = spark.read.format("statestore").option("path", folder).option("stateVarName", "last").load()
    # twenty days later only the machine that has just spoken is remembered
    assert [r.key.sn for r in left.select("key").collect()] == [0]


def test_minutes_come_out_in_order_and_late_rows_do_not(spark, tmp_path):
    at = lambda m, s=0: START + 60 * m + s
    pieces = [
        [(1, at(1), "b"), (2, at(1), "a"), (3, at(1, 1), "a"), (4, at(0, 30), "a")],
        [(5, at(2), "a"), (6, at(3), "c"), (7, at(8), "a")],
        [(8, at(2, 10), "late"), (9, at(9), "a")],
        [(10, at(60), "end")],
    ]
    stream, release = released(spark, str(tmp_path / "live"), pieces, "id long, t long, cat string")
    found = jobs.minute_batches(stream, ["id", "t", "cat"], ["cat", "t", "id"], F.lit(0), delay="2 minutes")
    got = jobs.run_to_table(found, ["id"], "append", release)
    # (minute, place) of each row; 8 came when the watermark was at minute 6, minute 60 is still open
    want = {4: (1, 1), 2: (1, 2), 1: (1, 3), 3: (2, 1), 5: (2, 2), 6: (3, 1), 7: (8, 1), 9: (9, 1)}
    assert {r.id: ((r.minute_end - START) // 60, r.place) for r in got.collect()} == want


def test_panes_and_their_trailing_sums_come_from_the_stream(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, rng.randrange(4), START + int(rng.random() ** 2 * 86_400), rng.choice([None, 1, 5])) for i in range(400)]
    data.sort(key=lambda r: r[2])
    pieces = [data[:90], data[90:91], data[91:300], data[300:], [(999, None, START + 9 * 86_400, 0)]]
    stream, release = released(spark, str(tmp_path / "live"), pieces, "id long, sn long, t long, k long")
    found = jobs.bin_features(stream, {"n": F.lit(1), "k": F.col("k")}, trailing={"n": [10, 60], "k": [60]}, delay="1 minute")
    got = {(r.sn, r.edge): r for r in jobs.run_to_table(found, ["sn", "edge"], "append", release).collect()}
    panes = {}
    for _, sn, t, k in data:
        edge = -(-t // 300) * 300
        n, s = panes.get((sn, edge), (0, 0))
        panes[sn, edge] = (n + 1, s + (k or 0))
    assert set(got) == set(panes)
    for (sn, edge), (n, s) in panes.items():
        upto = lambda w, j: sum(v[j] for (m, e), v in panes.items() if m == sn and edge - 60 * w <= e <= edge)
        r = got[sn, edge]
        assert (r.n, r.k, r.n_10m, r.n_60m, r.k_60m) == (n, s, upto(10, 0), upto(60, 0), upto(60, 1))


def test_a_micro_batch_calls_once_a_shard_not_once_a_machine(spark, tmp_path):
    """many machines, large ids beside a missing one; the state has a key for each shard."""
    big = 2**60 + 1
    data = [(i, None if i == 7 else big + i, START + 10 + i % 3 * 300, i) for i in range(200)] + [(300 + i, big + i, START + 1000, 1) for i in range(50)]
    folder = str(tmp_path / "state")
    stream, release = released(spark, str(tmp_path / "live"), [data, [(999, 0, START + 3000, 0)]], "id long, sn long, t long, k long")
    found = jobs.bin_features(stream, {"k": F.col("k")}, trailing={"k": [60]}, shards=3)
    got = {(r.sn, r.edge - START): (r.k, r.k_60m) for r in jobs.run_to_table(found, ["sn", "edge"], "append", release, state=folder).collect()}
    want = {(None if i == 7 else big + i, 300 * (1 + i % 3)): (i, i) for i in range(200)}
    want |= {(big + i, 1200): (1, 1 + (0 if i == 7 else i)) for i in range(50)}
    assert got == want
    left = spark.read.format("statestore").option("path", folder).option("stateVarName", "panes").load()
    assert 0 < left.select("key").distinct().count() <= 3


def easy(spark):
    rng = random.Random(1)
    data = [(i, i % 9, x := rng.random(), rng.random(), int(x > 0.6), 0.01 if x > 0.6 else None, int(x * 4)) for i in range(240)]
    return spark.createDataFrame(data, "id int, sn int, a double, b double, y int, days double, label int")


def test_recall_and_regression(spark):
    small = [models.Boosting(2, 0.3, 5, 1.0, 1)]
    df = models.recall_ensemble(easy(spark), ["a", "b"], "y", F.col("id") < 160, F.col("id") >= 160, small)
    assert evaluate.roc_auc(df, "recall_proba", "y").first().roc_auc > 0.95
    judged = models.fault_time_regressor(easy(spark), ["a", "b"], "days", F.col("id") < 160, settings=small)
    wrong = judged.where(F.col("pred_label") != F.col("y")).count()
    assert wrong < 12


def test_multilabel_and_classifier(spark):
    df = easy(spark)
    scored, thresholds = models.multilabel_time_model(df, ["a", "b"], ["y"], F.lit(True), 20)
    assert evaluate.roc_auc(scored, "proba_0", "y").first().roc_auc > 0.95 and len(thresholds) == 1
    folded = splits.group_kfold(df, "sn", 3)
    assert folded.select("sn", "fold").distinct().count() == 9
    found = models.fault_classifier(folded, ["a", "b"], "label", "fold", 3, trees=5, depth=4)
    assert found.count() == 240
    assert evaluate.class_summary(found, "label", "pred").first().accuracy > 0.6


def test_unlabelled_rows_get_the_blend_of_all_models(spark):
    df = easy(spark).withColumn("label", F.when(F.col("id") % 6 == 0, -1).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("label")))
    truth = easy(spark).select(F.col("id").alias("i"), F.col("label").alias("truth"))
    folded = splits.group_kfold(df, "sn", 3)
    found = models.fault_classifier(folded, ["a", "b"], "label", "fold", 3, trees=5, depth=4)
    assert found.count() == df.count()
    new = found.where("label is null or label < 0").join(truth, F.col("id") == F.col("i"))
    assert new.count() == df.where("id % 6 < 2").count()
    for r in new.collect():
        assert abs(sum(r.probs) - 1) < 1e-9
    assert new.where("pred = truth").count() > 0.7 * new.count()


def test_the_chain_judges_recalled_rows_only(spark):
    small = [models.Boosting(2, 0.3, 5, 1.0, 1)]
    rows_ = easy(spark)
    scored = models.recall_ensemble(rows_, ["a", "b"], "y", F.col("id") < 160, None, small)
    kept = {r.id for r in models.recalled(scored, threshold=0.5).collect()}
    judged = models.alarm_chain(rows_, ["a", "b"], "y", "days", F.col("id") < 160, None, small, small, threshold=0.5).collect()
    assert {r.id for r in judged} == kept and 0 < len(kept) < rows_.count()
    assert all((r.pred_label == 1) == (r.pred_days <= 0.1) for r in judged)


def test_settings_are_drawn_with_a_seed():
    assert models.draw_settings(3, 10, seed=5) == models.draw_settings(3, 10, seed=5)


def test_training_parts_do_not_follow_the_input(spark):
    """Each task of each boosting job reports to the driver: their number is the cluster's, not that of the input's files."""
    few = models.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = spark.range(0, 2_000, 1, 500)
    assert models._in_few_parts(rows).rdd.getNumPartitions() == few
    assert models._in_few_parts(rows).count() == 2_000
    assert models._in_few_parts(spark.range(0, 2_000, 1, 2)).rdd.getNumPartitions() == 2


def rare(spark, n=6_000):
    """One row in fifty is told by ``a``; one in 139 fails without a sign."""
    data = [(i, 1.0 if i % 50 == 0 else (i * 37 % 11) / 22, i * 31 % 7 / 7, int(i % 50 == 0 or i % 139 == 7)) for i in range(n)]
    return spark.createDataFrame(data, "id int, a double, b double, y int")


def test_recall_drops_rows_far_from_failures(spark):
    """With the trees and the threshold of the registered query: ten trees left every row above it."""
    settings = models.draw_settings(1, scoring.TREES)
    found = models.recall_ensemble(rare(spark), ["a", "b"], "y", F.col("id") < 4_000, F.col("id") >= 4_000, settings)
    assert found.count() == 6_000
    kept = {r.id for r in models.recalled(found).collect()}
    assert {i for i in range(6_000) if i % 50 == 0} <= kept and len(kept) < 1_500


def test_one_class_or_no_row_to_learn_from(spark):
    none = rare(spark, 100).withColumn("y", F.lit(0)).withColumn("days", F.lit(None).cast("double"))
    found = models.recall_ensemble(none, ["a", "b"], "y", F.col("id") < 50, F.col("id") >= 50)
    assert {r.recall_proba for r in found.collect()} == {0.0} and models.recalled(found).count() == 0
    judged = models.fault_time_regressor(none, ["a", "b"], "days", F.lit(False)).collect()
    assert len(judged) == 100 and {(r.pred_days, r.score, r.pred_label) for r in judged} == {(0.25, 0.0, 0)}


def test_rows_that_share_their_classes_are_scored_once_and_all_returned(spark):
    once = easy(spark).withColumn("b", F.when(F.col("id") % 10 != 0, F.col("b"))).withColumn("_y", F.col("y").cast("double"))
    copies = once.crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    assert not models._Cells(once, ["a", "b"], F.lit(True), None).shared
    cells = models._Cells(copies, ["a", "b"], F.lit(True), None)
    fitted = cells.boosted(models.GBTRegressor, [models.Boosting(2, 0.3, 5, 1.0, 1)])
    assert cells.shared
    joined = rows(cells.scored(copies, fitted, F.col("prediction")), "id", "copy", "_m0")
    cells.shared = False
    assert joined == rows(cells.scored(copies, fitted, F.col("prediction")), "id", "copy", "_m0") and len(joined) == 4_800


def test_classes_of_features(spark):
    values = [(1.0 if i else 0.0, float(i), None if i == 5 else float("nan") if i == 6 else 3.0) for i in range(1_000)]
    df = spark.createDataFrame(values, "flag double, many double, gap double")
    cuts = models._cuts(df, ["flag", "many", "gap"])
    assert cuts[0] == [1.0] and len(cuts[1]) == models.BINS - 2 and cuts[2] == [3.0]
    classed = models._classed(df, ["flag", "many", "gap"], cuts)
    assert classed.where("_c0 = 0").count() == 1 and classed.where("_c2 = 2").count() == 2
    assert not any(classed.schema[f"_c{i}"].metadata for i in range(3))
    assert classed.groupBy("_c1").count().agg(F.max("count")).first()[0] <= 40
