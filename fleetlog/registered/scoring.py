"""Splits, models and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions import timegrid
from fleetlog.functions.encode import threshold_labels
from fleetlog.operators import alarms, evaluate, models, splits
from fleetlog.registered.core import ORIGIN, Tables, query, r6, rounded

_DAY = f"(t - {ORIGIN}) // 86400"


def _days(x: Tables):
    return x.ev().select("id", "sn", timegrid.elapsed_days(F.col("t"), ORIGIN).alias("day"))


@query(
    f"""WITH g AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS r, count(*) OVER () AS n FROM
      (SELECT DISTINCT {_DAY} AS day FROM ev)),
    f AS (SELECT day, r, fold, n - 4 * least(n // 5, 4) + fold * least(n // 5, 4) AS s, least(n // 5, 4) AS size
      FROM g, (SELECT unnest(range(4)) AS fold)),
    tags AS (SELECT day, fold, CASE WHEN r >= s AND r < s + size THEN 'test' WHEN r >= s - 2 AND r < s THEN 'gap'
      WHEN r >= greatest(0, s - 2 - 10) AND r < s - 2 THEN 'train' END AS role FROM f)
    SELECT id, {_DAY} AS day, fold, role FROM ev JOIN tags ON {_DAY} = tags.day WHERE role IS NOT NULL""",
    "ev",
)
def purged_time_split(x: Tables):
    rows = _days(x).drop("sn")
    return splits.purged_time_split(rows, "day", n_splits=5, gap=2, max_train=10, max_test=4)


@query(
    f"""SELECT id, {_DAY} AS day, fold, role FROM ev JOIN (VALUES (0, 'train', 0, 15), (0, 'valid', 18, 21), (1, 'train', 0, 12),
    (1, 'valid', 12, 15), (2, 'train', 0, 21), (2, 'valid', 18, 21)) f(fold, role, lo, hi) ON {_DAY} >= lo AND {_DAY} < hi""",
    "ev",
)
def range_split(x: Tables):
    folds = [((0, 15), (18, 21)), ((0, 12), (12, 15)), ((0, 21), (18, 21))]
    return splits.range_split(_days(x).drop("sn"), "day", folds)


@query("SELECT id, ntile(7) OVER (ORDER BY id) - 1 AS fold FROM ev", "ev")
def kfold_contiguous(x: Tables):
    return splits.kfold_contiguous(x.ev().select("id"), "id", 7)


@query(
    """WITH RECURSIVE ev AS (SELECT event_id AS id, user_id AS sn FROM events),
    g AS (SELECT sn, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sn) AS r,
      row_number() OVER (PARTITION BY count(*) ORDER BY sn) - 1 AS place FROM ev GROUP BY sn),
    s AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS n, 0 AS f, [0, 0, 0, 0, 0]::BIGINT[] AS loads
      UNION ALL SELECT g.r, g.n, list_position(loads, list_min(loads)),
        list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END)
      FROM s JOIN g ON g.r = s.r + 1),
    c AS (SELECT n, f, count(*) AS m FROM s WHERE r > 0 GROUP BY n, f),
    e AS (SELECT n, f - 1 AS fold, sum(m) OVER (PARTITION BY n ORDER BY f) - m AS lo, sum(m) OVER (PARTITION BY n ORDER BY f) AS hi FROM c)
    SELECT id, ev.sn AS sn, CAST(e.fold AS BIGINT) AS fold FROM ev JOIN g USING (sn) JOIN e ON e.n = g.n AND place >= lo AND place < hi""",
)
def group_kfold(x: Tables):
    return splits.group_kfold(x.ev().select("id", "sn"), "sn", 5)


def _model_rows(x: Tables):
    scored = x.scored()
    days = timegrid.elapsed_days(F.col("t"), ORIGIN)
    ahead = F.col("failure_t") - F.col("t")
    return scored.select(
        "id",
        "sn",
        "t",
        "y",
        "v",
        F.col("k").cast("double").alias("kd"),
        (F.col("t") % 86_400 / 3600.0).alias("hour"),
        F.when(F.col("cat") == "error", 1.0).otherwise(0.0).alias("is_error"),
        days.alias("day"),
        F.when(ahead.between(0, 15 * 86_400), ahead / 86_400.0).alias("days_to_failure"),
        (F.col("k") % 4).alias("label"),
    )


FEATURES = ["v", "kd", "hour", "is_error"]


#: As in production: the most trees a recall model may grow, of which its validation rows stop it, and those of a
#: regressor, which has no validation rows.
TREES, TIME_TREES = 5000, 100


@query()
def recall_ensemble(x: Tables):
    rows = _model_rows(x)
    found = models.recall_ensemble(rows, FEATURES, "y", F.col("day") < 20, F.col("day") >= 25, models.draw_settings(3, TREES))
    return models.recalled(found).select("id", r6("recall_proba").alias("recall_proba"))


def _judged(x: Tables):
    recall, time = models.draw_settings(3, TREES), models.draw_settings(3, TIME_TREES)
    return models.alarm_chain(_model_rows(x), FEATURES, "y", "days_to_failure", F.col("day") < 20, F.col("day") >= 25, recall, time)


@query()
def fault_time_regressor(x: Tables):
    """Days to failure of the rows that the recall models keep."""
    return _judged(x).select("id", r6("pred_days").alias("pred_days"), r6("score").alias("score"), "pred_label")


@query()
def fault_alarm_chain(x: Tables):
    """Recall, filter, days to failure, first alarms, and what they are worth."""
    late = _judged(x).where("day >= 20 and pred_label = 1")
    return rounded(alarms.alarm_f1(late, x.fail()), ["precision", "recall", "f1"])


@query(
    """SELECT id, round(d, 6) AS pred_days, round((0.25 - d) / 0.25, 6) AS score, CASE WHEN d <= 0.1 THEN 1 ELSE 0 END AS pred_label
    FROM (SELECT id, least(greatest(((k - 10) / 100.0::DOUBLE + v / 1000) / 2, 0.0), 0.25) AS d FROM ev)""",
    "ev",
)
def fault_time_judgement(x: Tables):
    rows = x.ev().select("id", ((F.col("k") - 10) / F.lit(100.0)).alias("a"), (F.col("v") / 1000).alias("b"))
    judged = models.judge(rows, ["a", "b"], 0.25, 0.1)
    return rounded(judged.drop("a", "b"), ["pred_days", "score"])


@query()
def multilabel_time_model(x: Tables):
    minutes = F.col("days_to_failure") * 1440
    labels = threshold_labels(minutes, classes=10, first=1440, gap=2880)
    rows = _model_rows(x).withColumn("_l", labels)
    names = [f"class_{i}" for i in range(10)]
    rows = rows.withColumns({n: F.col("_l")[i] for i, n in enumerate(names)}).drop("_l")
    scored, thresholds = models.multilabel_time_model(rows, FEATURES, names, F.col("day") < 20, 10, valid=F.col("day") >= 20)
    return scored.select(
        "id",
        *[r6(f"proba_{i}").alias(f"proba_{i}") for i in range(10)],
        *[F.when(F.col(f"proba_{i}") >= th, 1).otherwise(0).alias(f"pred_{i}") for i, th in enumerate(thresholds)],
    )


@query()
def fault_classifier(x: Tables):
    """Out-of-fold classes of labelled rows, blended ones of the tenth that has no label."""
    rows = _model_rows(x).withColumn("label", F.when(F.col("id") % 10 == 9, -1).otherwise(F.col("label")))
    folded = splits.group_kfold(rows, "sn", 5)
    found = models.fault_classifier(folded, FEATURES, "label", "fold", 5)
    return found.select("id", "fold", "label", "pred", *[r6(F.col("probs")[i]).alias(f"p{i}") for i in range(4)])


@query(
    """WITH p AS (SELECT id, 0.5 AS w, (k % 3)::DOUBLE AS p0, (k % 5)::DOUBLE AS p1 FROM ev
      UNION ALL SELECT id, 0.1, (k % 7)::DOUBLE, (k % 2)::DOUBLE FROM ev),
    m AS (SELECT id, sum(w * p0) / sum(w) AS p0, sum(w * p1) / sum(w) AS p1 FROM p GROUP BY id)
    SELECT id, round(p0, 6) AS p0, round(p1, 6) AS p1, CASE WHEN round(p0, 9) >= round(p1, 9) THEN 0 ELSE 1 END AS label FROM m""",
    "ev",
)
def weighted_blend(x: Tables):
    k = F.col("k")
    both = F.array(
        F.struct(F.lit(0.5).alias("w"), (k % 3).cast("double").alias("p0"), (k % 5).cast("double").alias("p1")),
        F.struct(F.lit(0.1).alias("w"), (k % 7).cast("double").alias("p0"), (k % 2).cast("double").alias("p1")),
    )
    rows = x.ev().select("id", F.explode(both).alias("m")).select("id", "m.*")
    return rounded(evaluate.weighted_blend(rows, ["id"], ["p0", "p1"], "w"), ["p0", "p1"])


_F1 = """SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""


@query(
    "WITH c AS (SELECT count(*) FILTER (y = 1 AND proba > 0.2) AS tp, count(*) FILTER (y = 0 AND proba > 0.2) AS fp, "
    f"count(*) FILTER (y = 1 AND proba <= 0.2) AS fn FROM scored) {_F1} FROM c",
    "scored",
)
def binary_f1(x: Tables):
    return rounded(evaluate.binary_f1(x.scored(), "proba", "y", 0.2), ["precision", "recall", "f1"])


_BEST = """, f AS (SELECT th, count(*) FILTER (y = 1 AND p > th) AS tp, count(*) FILTER (y = 0 AND p > th) AS fp,
      count(*) FILTER (y = 1 AND p <= th) AS fn FROM th, s GROUP BY th),
    b AS (SELECT th, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM f)
    SELECT round(max(f1), 6) AS best_f1, round(CASE WHEN max(f1) > 0 THEN arg_max(th, (round(f1, 12), -th)) ELSE 0 END, 6) AS best_threshold FROM b"""


@query(
    "WITH s AS (SELECT proba AS p, y FROM scored), th AS (SELECT unnest(range(512)) * (0.9 / 511) AS th)" + _BEST,
    "scored",
)
def best_f1_threshold(x: Tables):
    return rounded(evaluate.best_f1_threshold(x.scored(), "proba", "y"), ["best_f1", "best_threshold"])


@query(
    "WITH s AS (SELECT k / 100.0::DOUBLE AS p, y FROM scored), th AS (SELECT DISTINCT p AS th FROM s)" + _BEST, "scored"
)
def best_f1_threshold_few(x: Tables):
    rows = x.scored().select((F.col("k") / F.lit(100.0)).alias("p"), "y")
    return rounded(evaluate.best_f1_threshold(rows, "p", "y", candidates="scores"), ["best_f1", "best_threshold"])


@query(
    f"""WITH s AS (SELECT sn, {_DAY} // 16 AS month, proba AS p, y FROM scored),
    th AS (SELECT unnest(range(2048)) AS i), g AS (SELECT i, i * (0.25 / 2047) AS th FROM th),
    r AS (SELECT month, i, count(*) FILTER (y = 1 AND p > th) AS tp, count(*) FILTER (y = 0 AND p > th) AS fp,
      count(*) FILTER (y = 1 AND p <= th) AS fn FROM s, g GROUP BY month, i),
    m AS (SELECT month, sn, max(p) AS p, max(y) AS y FROM s GROUP BY month, sn),
    c AS (SELECT month, i, count(*) FILTER (y = 1 AND p > th) / CAST(count(*) FILTER (y = 1) AS DOUBLE) AS caught,
      count(*) FILTER (p > th) / CAST(count(*) AS DOUBLE) AS flagged FROM m, g GROUP BY month, i)
    SELECT i, round(i * (0.25 / 2047), 6) AS threshold, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)), 6) AS sample_f1,
    round(avg(caught), 6) AS machine_recall, round(avg(flagged), 6) AS flagged_share
    FROM r JOIN c USING (month, i) GROUP BY i""",
    "scored",
)
def recall_threshold_curve(x: Tables):
    half = F.floor(timegrid.elapsed_days(F.col("t"), ORIGIN) / 16)
    rows = x.scored().withColumn("month", half)
    curve = evaluate.recall_threshold_curve(rows, "proba", "y", n=2048)
    return rounded(curve, ["threshold", "sample_f1", "machine_recall", "flagged_share"])


@query(
    """WITH d AS (SELECT proba AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY s),
    c AS (SELECT s, pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM d),
    q AS (SELECT s, pos, tp / CAST(tp + fp AS DOUBLE) AS p, coalesce(lag(tp / CAST(tp + fp AS DOUBLE)) OVER (ORDER BY s DESC), 1) AS p0 FROM c)
    SELECT round(sum(pos * (p + p0) / 2) / (SELECT sum(y) FROM scored), 6) AS pr_auc FROM q""",
    "scored",
)
def pr_auc(x: Tables):
    return rounded(evaluate.pr_auc(x.scored(), "proba", "y"), ["pr_auc"])


def _auc_sql(label):
    return f"""(SELECT (sum(CASE WHEN {label} = 1 THEN r END) - {{n1}} * ({{n1}} + 1) / 2.0) / ({{n1}}::DOUBLE * {{n0}}) FROM
      (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d))""".format(
        n1=f"(SELECT count(*) FROM d WHERE {label} = 1)", n0=f"(SELECT count(*) FROM d WHERE {label} = 0)"
    )


@query(
    f"""WITH d AS (SELECT proba AS s, y, CASE WHEN cat = 'error' THEN 1 ELSE 0 END AS y2, v, pred_min FROM scored)
    SELECT round((SELECT avg(abs(v - pred_min)) FROM d), 6) AS mae, round({_auc_sql('y')}, 6) AS auc,
    round(({_auc_sql('y')} + {_auc_sql('y2')}) / 2, 6) AS macro_auc""",
    "scored",
)
def regression_and_rank_metrics(x: Tables):
    rows = x.scored().withColumn("y2", F.when(F.col("cat") == "error", 1).otherwise(0))
    found = evaluate.regression_and_rank_metrics(rows, "v", "pred_min", "proba", ["y", "y2"])
    return rounded(found, ["mae", "auc", "macro_auc"])


def _classes(x: Tables):
    k = F.col("k")
    pred = F.when(k % 3 == 0, (k + 1) % 4).otherwise(k % 4)
    return x.ev().select("id", (k % 4).alias("label"), pred.alias("pred"), (F.col("id") % 5).alias("fold"))


_CLASSES = """WITH p AS (SELECT k % 4 AS label, CASE WHEN k % 3 = 0 THEN (k + 1) % 4 ELSE k % 4 END AS pred, id % 5 AS fold FROM ev),
    c AS (SELECT {by} CAST(class AS BIGINT) AS class, count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted,
      count(*) FILTER (label = class AND pred = class) AS tp FROM p, (SELECT unnest(range(4)) AS class) GROUP BY ALL),
    f AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
      coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1, CASE class WHEN 0 THEN 5 / 11.0 WHEN 1 THEN 4 / 11.0 ELSE 1 / 11.0 END AS w FROM c)"""


@query(_CLASSES.format(by="") + "SELECT round(sum(CAST(w AS DOUBLE) * f1), 6) AS weighted_f1 FROM f", "ev")
def weighted_class_f1(x: Tables):
    return rounded(evaluate.weighted_class_f1(_classes(x), "label", "pred"), ["weighted_f1"])


@query(
    _CLASSES.format(by="")
    + """SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""",
    "ev",
)
def classification_report(x: Tables):
    return rounded(evaluate.class_report(_classes(x), "label", "pred"), ["precision", "recall", "f1"])


@query(
    _CLASSES.format(by="fold,")
    + """, s AS (SELECT fold, sum(CAST(w AS DOUBLE) * f1) AS a, avg(f1) AS b, sum(tp) / sum(support)::DOUBLE AS c FROM f GROUP BY fold)
    SELECT round(avg(a), 6) AS weighted_f1, round(avg(b), 6) AS macro_f1, round(avg(c), 6) AS accuracy FROM s""",
    "ev",
)
def classification_report_folds(x: Tables):
    per_fold = evaluate.class_summary(_classes(x), "label", "pred", ["fold"])
    return rounded(evaluate.fold_means(per_fold), ["weighted_f1", "macro_f1", "accuracy"])


_FIRST = """WITH a AS (SELECT sn, min(t) AS t, arg_min(pred_min, (t, id)) AS pm FROM scored WHERE {cond} GROUP BY sn),
    span AS (SELECT min(t) AS lo, max(t) AS hi FROM scored),
    fl AS (SELECT * FROM fail{inside}),
    h AS (SELECT a.sn, a.t, pm, (failure_t - t) / 60.0 AS tm FROM a JOIN fl ON a.sn = fl.sn AND t > failure_t - 604800 AND t < failure_t),
    n AS (SELECT (SELECT count(*) FROM a) AS alarms, (SELECT count(*) FROM fl) AS failures, {earned} AS e)"""
_RATES = """round(e / alarms::DOUBLE, 6) AS precision, round(e / failures::DOUBLE, 6) AS recall,
    round(2 * e / (alarms + failures)::DOUBLE, 6) AS f1"""


@query(
    _FIRST.format(cond="proba > 0.2", inside="", earned="(SELECT count(*) FROM h)")
    + f"SELECT e AS hits, alarms, failures, {_RATES} FROM n",
    "scored",
)
def alarm_f1(x: Tables):
    rows = x.scored().where("proba > 0.2").select("sn", "t", "id")
    return rounded(alarms.alarm_f1(rows, x.fail()), ["precision", "recall", "f1"])


@query(
    _FIRST.format(
        cond="proba > 0.2",
        inside=", span WHERE failure_t > lo AND failure_t < hi",
        earned="(SELECT coalesce(sum(CASE WHEN pm >= 0 AND pm <= tm THEN 1 / (1 + exp(-pm / tm)) ELSE 0 END), 0) FROM h)",
    )
    + f"SELECT round(e, 6) AS credit, alarms, failures, {_RATES}, round(alarms / failures::DOUBLE, 6) AS alarms_per_failure FROM n",
    "scored",
)
def alarm_lead_time_score(x: Tables):
    rows = x.scored().withColumn("pred_label", F.when(F.col("proba") > 0.2, 1).otherwise(0))
    found = alarms.alarm_lead_time_score(rows.drop("failure_t"), x.fail())
    return rounded(found, ["credit", "precision", "recall", "f1", "alarms_per_failure"])


@query(
    """WITH d AS (SELECT CAST(k - 20 AS DOUBLE) AS p, v AS tr FROM ev)
    SELECT round(avg(CASE WHEN greatest(p, 0) > tr THEN 0 ELSE 1 / (1 + exp(-greatest(p, 0) / (tr + 1e-8))) END), 6) AS score,
    round(1 - avg(CASE WHEN greatest(p, 0) > tr THEN 1 ELSE 0 END), 6) AS not_late FROM d""",
    "ev",
)
def lead_time_score(x: Tables):
    rows = x.ev().select((F.col("k") - 20).cast("double").alias("p"), "v")
    return rounded(evaluate.lead_time_score(rows, "p", "v"), ["score", "not_late"])
