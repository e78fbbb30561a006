"""Scores of rows, classes and machines.

Threshold scans collapse the rows to distinct scores (or to slots between the thresholds) first
and then use running counts, so one pass serves every threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.functions.encode import CLASS_WEIGHTS
from fleetlog.functions.scores import f1, lead_time_credit, share
from fleetlog.operators import scan


def _confusion(predicted: Column, label: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & predicted).alias("tp"),
        F.count_if((label == 0) & predicted).alias("fp"),
        F.count_if((label == 1) & ~predicted).alias("fn"),
    ]


def _with_f1(counts: DataFrame) -> DataFrame:
    tp = F.col("tp")
    return counts.withColumns(
        {"precision": share(tp, tp + F.col("fp")), "recall": share(tp, tp + F.col("fn"))}
    ).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def binary_f1(
    df: DataFrame, score: str, label: str, threshold: float, inclusive: bool = False
) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; positive means above the threshold."""
    s = F.col(score)
    predicted = s >= threshold if inclusive else s > threshold
    return _with_f1(df.agg(*_confusion(predicted, F.col(label))))


def ranked_scores(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives, and both counted from the top (tp, fp).

    Rows without a score (null or NaN) have no place in the order and are left out.
    """
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = scored.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    chunked = scan.by_quantile(counts, score).withColumn(scan.CHUNK, -F.col(scan.CHUNK))
    return scan.running_sums(
        chunked, by, -F.col(score), {"tp": F.col("pos"), "fp": F.col("neg")}, totals=True
    )


def pr_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, starting at recall 0, precision 1."""
    r = ranked_scores(df, score, label, by)
    tp, fp, all_pos = F.col("tp"), F.col("fp"), F.col("tp_total")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision = tp / (tp + fp)
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    area = F.try_divide(F.col("pos"), all_pos) * (precision + before) / 2
    return r.groupBy(*by).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties as one half."""
    r = ranked_scores(df, score, label, by)
    above = F.col("tp") - F.col("pos")
    won = F.sum(F.col("neg").cast("double") * (above + F.col("pos") / 2))
    pairs = F.max(F.col("tp_total").cast("double") * F.col("fp_total"))
    return r.groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def regression_and_rank_metrics(
    df: DataFrame, truth: str, prediction: str, score: str, labels: Sequence[str]
) -> DataFrame:
    """Mean absolute error, ROC AUC of the first label, macro mean of the AUC over all labels."""
    mae = df.agg(F.avg(F.abs(F.col(truth) - F.col(prediction))).alias("mae"))
    long = df.select(
        F.col(score).alias("_s"),
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("_l"), F.col(c).alias("_y")) for i, c in enumerate(labels)])
        ).alias("_e"),
    ).select("_s", "_e.*")
    auc = roc_auc(long, "_s", "_y", ["_l"])
    macro = auc.agg(
        F.max(F.when(F.col("_l") == 0, F.col("roc_auc"))).alias("auc"),
        F.avg("roc_auc").alias("macro_auc"),
    )
    return macro.select(mae.scalar().alias("mae"), "auc", "macro_auc")


def _slot(score: Column, low: float, step: float, n: int) -> Column:
    """How many of the thresholds ``low + i·step`` lie below the score (exact comparison)."""
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((score - low) / step))).cast("long")
    at = lambda i: i * F.lit(step) + F.lit(low)
    up = (guess < n) & (at(guess) < score)
    down = (guess > 0) & (at(guess - 1) >= score)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def _over_thresholds(slots: DataFrame, by: Sequence[str], n: int, counts: Sequence[str]) -> DataFrame:
    """Counts per slot -> counts above each of the n thresholds (a table of fixed length)."""
    grid = slots.select(*by).distinct() if by else slots.agg(F.count(F.lit(1)).alias("_one"))
    grid = grid.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("_slot"))
    full = slots.unionByName(grid.select("*", *[F.lit(0).cast("long").alias(c) for c in counts]))
    full = full.groupBy(*by, "_slot").agg(*[F.sum(c).alias(c) for c in counts])
    order = (Window.partitionBy(*by) if by else Window).orderBy(F.col("_slot").desc())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return full.select(
        *by,
        F.col("_slot").alias("i"),
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in counts],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in counts],
    ).where(F.col("i") < n)


def f1_over_thresholds(
    df: DataFrame, score: str, label: str, low: float, high: float, n: int, by: Sequence[str] = ()
) -> DataFrame:
    """F1 of ``score > threshold`` at n evenly spaced thresholds."""
    step = (high - low) / (n - 1)
    slots = df.groupBy(*by, _slot(F.col(score), low, step, n).alias("_slot")).agg(
        F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp")
    )
    table = _over_thresholds(slots, by, n, ["tp", "fp"])
    table = table.withColumn("fn", F.col("all_tp") - F.col("tp"))
    return _with_f1(table).select(
        *by, "i", (F.col("i") * F.lit(step) + F.lit(low)).alias("threshold"), "f1", "precision", "recall"
    )


def best_f1_threshold(
    df: DataFrame,
    score: str,
    label: str,
    low: float = 0.0,
    high: float = 0.9,
    n: int = 512,
    candidates: str = "grid",
) -> DataFrame:
    """Best F1 and its threshold; (0, 0) if no threshold does better than 0.

    Candidates are n even steps from low to high (``grid``) or all distinct scores (``scores``),
    whatever the data; the smallest of the best wins.
    """
    if candidates not in ("grid", "scores"):
        raise ValueError("candidates are 'grid' or 'scores'")
    if candidates == "scores":
        r = ranked_scores(df, score, label)
        table = _with_f1(
            r.select(
                F.col(score).alias("threshold"),
                (F.col("tp") - F.col("pos")).alias("tp"),
                (F.col("fp") - F.col("neg")).alias("fp"),
                (F.col("tp_total") - F.col("tp") + F.col("pos")).alias("fn"),
            )
        )
    else:
        table = f1_over_thresholds(df, score, label, low, high, n)
    place = F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))
    best = table.agg(F.max(place).alias("_b"))
    won = F.col("_b.f1") > 0
    return best.select(
        F.when(won, F.col("_b.f1")).otherwise(0.0).alias("best_f1"),
        F.when(won, -F.col("_b.t")).otherwise(0.0).alias("best_threshold"),
    )


def recall_threshold_curve(
    df: DataFrame,
    score: str,
    label: str,
    machine: str = "sn",
    month: str = "month",
    low: float = 0.0,
    high: float = 0.25,
    n: int = 2048,
) -> DataFrame:
    """Per threshold, averaged over months: row F1, share of faulty machines caught, share flagged.

    A machine is flagged when its highest score is above the threshold.
    """
    step = (high - low) / (n - 1)
    rows = f1_over_thresholds(df, score, label, low, high, n, [month])
    machines = df.groupBy(month, machine).agg(
        F.max(score).alias("_s"), F.max(label).alias("_y")
    )
    # A faulty machine is caught by any of its rows, not only by the faulty ones.
    slots = machines.groupBy(month, _slot(F.col("_s"), low, step, n).alias("_slot")).agg(
        F.count(F.lit(1)).alias("flagged"), F.count_if(F.col("_y") == 1).alias("caught")
    )
    per_month = _over_thresholds(slots, [month], n, ["flagged", "caught"]).select(
        month,
        "i",
        share(F.col("caught"), F.col("all_caught")).alias("caught_share"),
        share(F.col("flagged"), F.col("all_flagged")).alias("flagged_share"),
    )
    return (
        rows.join(per_month, [month, "i"])
        .groupBy("i", "threshold")
        .agg(
            F.avg("f1").alias("sample_f1"),
            F.avg("caught_share").alias("machine_recall"),
            F.avg("flagged_share").alias("flagged_share"),
        )
    )


def caught_machines(
    df: DataFrame, score: str, label: str, threshold: float, machine: str = "sn"
) -> DataFrame:
    """Faulty machines predicted at least once, as a share of the faulty ones."""
    per = df.groupBy(machine).agg(F.max(label).alias("_y"), F.max(score).alias("_s"))
    counts = per.agg(
        F.count_if(F.col("_y") == 1).alias("faulty"),
        F.count_if((F.col("_y") == 1) & (F.col("_s") > threshold)).alias("caught"),
    )
    return counts.withColumn("caught_share", share(F.col("caught"), F.col("faulty")))


def class_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1 — from one confusion table."""
    confusion = df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("_n"))
    zero, n = F.lit(0).cast("long"), F.col("_n")
    right = F.when(F.col(label) == F.col(prediction), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col(label).alias("class"), n.alias("s"), zero.alias("p"), right.alias("tp")),
        F.struct(F.col(prediction).alias("class"), zero.alias("s"), n.alias("p"), zero.alias("tp")),
    )
    per = (
        confusion.select(*by, F.explode(sides).alias("_e"))
        .select(*by, "_e.*")
        .groupBy(*by, "class")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    )
    return per.withColumns(
        {
            "precision": share(F.col("tp"), F.col("predicted")),
            "recall": share(F.col("tp"), F.col("support")),
        }
    ).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def class_summary(
    df: DataFrame,
    label: str,
    prediction: str,
    by: Sequence[str] = (),
    weights: Mapping[int, float] = CLASS_WEIGHTS,
) -> DataFrame:
    """Weighted F1, macro F1 and accuracy, per fold with ``by``."""
    weight = F.coalesce(*[F.when(F.col("class") == k, F.lit(w)) for k, w in weights.items()], F.lit(0.0))
    return class_report(df, label, prediction, by).groupBy(*by).agg(
        F.sum(weight * F.col("f1")).alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
    )


def weighted_class_f1(
    df: DataFrame, label: str, prediction: str, weights: Mapping[int, float] = CLASS_WEIGHTS
) -> DataFrame:
    return class_summary(df, label, prediction, weights=weights).select("weighted_f1")


def fold_means(summary: DataFrame) -> DataFrame:
    """Mean of the per-fold scores."""
    return summary.agg(*[F.avg(c).alias(c) for c in ("weighted_f1", "macro_f1", "accuracy")])


def lead_time_score(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """Mean credit of the predicted times, and the share that is not too long."""
    p, t = F.col(predicted), F.col(true)
    return df.agg(
        F.avg(lead_time_credit(p, t)).alias("score"),
        (F.lit(1.0) - F.avg(F.when(F.greatest(p, F.lit(0)) > t, 1.0).otherwise(0.0))).alias("not_late"),
    )


def weighted_blend(
    predictions: DataFrame, key: Sequence[str], probabilities: Sequence[str], weight: str
) -> DataFrame:
    """Weighted mean of class probabilities over models, and the winning class."""
    w = F.col(weight)
    mixed = predictions.groupBy(*key).agg(
        *[(F.sum(w * F.col(p)) / F.sum(w)).alias(p) for p in probabilities]
    )
    ps = F.array(*probabilities)
    return mixed.withColumn("label", (F.array_position(ps, F.array_max(ps)) - 1).cast("long"))
