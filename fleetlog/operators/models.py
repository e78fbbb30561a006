"""Fault models on Spark ML, with the reference settings as parameters.

Training data is assembled into one vector column and, where several models are fitted on it,
persisted for the fits (disk allowed, so it survives memory pressure).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.encode import failure_target, sample_weight
from fleetlog.operators.evaluate import f1_over_thresholds
from fleetlog.operators.vectors import scale_features
from fleetlog.session import shared_dir, stored

# The probability a row needs to be recalled.
RECALL_THRESHOLD = 0.0183195


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


@dataclass
class Boosting:
    """Settings of one boosted model of an ensemble; with validation rows ``trees`` is the most it may grow."""

    depth: int = 4
    rate: float = 0.05
    trees: int = 100
    subsample: float = 0.98
    seed: int = 2021


# The choices the ensemble members draw from.
RECALL_CHOICES = {
    "depth": [3, 4, 5],
    "rate": [0.03, 0.04, 0.05, 0.06],
    "subsample": [0.97, 0.98, 0.985, 0.99],
}


def draw_settings(n: int, trees: int, seed: int = 2021, choices=RECALL_CHOICES) -> list[Boosting]:
    import random

    rng = random.Random(seed)
    return [
        Boosting(
            rng.choice(choices["depth"]),
            rng.choice(choices["rate"]),
            trees,
            rng.choice(choices["subsample"]),
            rng.randrange(4096),
        )
        for _ in range(n)
    ]


def _mean(columns: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return total / len(columns)


#: Partitions of training rows per core of the cluster.
PARTS_PER_CORE = 4


def _in_few_parts(rows: DataFrame) -> DataFrame:
    """Rows in a number of partitions that the cluster gives and not the input.

    Boosting runs several jobs for each level of each tree, and each task of them reports to the driver.
    """
    return rows.coalesce(PARTS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


#: Boosting stops when a tree lowers the error of the validation rows by less than this share of it. Spark's own
#: hundredth ends it while the probabilities of rows far from failures are still on their way down.
LEAST_GAIN = 1e-4
#: The most trees of a model that was to have validation rows and has none.
FIXED_TREES = 600


#: Classes of values that a feature is cut into for boosting, as many as the trees of Spark ML tell apart, one for unknown ones.
BINS = 32
#: Training rows for which a further partition is worth its tasks.
CELLS_PER_PART = 50_000


def _cuts(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Where the classes of each feature begin: at each of its values if they are few, else at quantiles."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    kinds = rows.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(known.values())]).first()
    few = [c for i, c in enumerate(features) if kinds[f"n{i}"] < BINS - 1]
    many = [c for c in features if c not in few]
    found = {}
    if few:
        sets = rows.agg(*[F.collect_set(known[c]).alias(f"s{i}") for i, c in enumerate(few)]).first()
        found.update({c: sorted(sets[f"s{i}"]) for i, c in enumerate(few)})
    if many:
        doubles = rows.select(*[known[c].alias(c) for c in many])
        shares = [i / (BINS - 1) for i in range(BINS - 1)]
        found.update(zip(many, map(sorted, doubles.approxQuantile([f"`{c}`" for c in many], shares, 0.001))))
    starts = [sorted({v for v in found[c] if abs(v) < float("inf")}) for c in features]
    return [v[1:] or v or [0.0] for v in starts]


def _classed(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Add the class of each feature, ``_c0``, ``_c1``, ..., which is never null."""
    inf, values = float("inf"), [f"_v{i}" for i in range(len(features))]
    known = df.withColumns({v: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for v, c in zip(values, features)})
    cut = Bucketizer(
        splitsArray=[[-inf, *c, inf] for c in cuts],
        inputCols=values,
        outputCols=[f"_c{i}" for i in range(len(features))],
        handleInvalid="keep",
    )
    # classes have an order: without the bucketizer's metadata trees split them as numbers and not as names
    return reduce(lambda d, i: d.withMetadata(f"_c{i}", {}), range(len(features)), cut.transform(known).drop(*values))


class _Cells:
    """Training rows for boosting: equal rows, by the classes of their features, are one row with their number.

    Trees only see the classes, so the number of rows they are grown on does not rise with the log where features
    are few. ``subsample`` takes from these rows. ``least`` and ``most`` are the border labels to learn from (None without
    a training row); ``validated`` says whether any row validates, None that none were asked for.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str], train: Column, valid: Column | None):
        picked = rows.where(train) if valid is None else rows.where(train | valid)
        validates = F.lit(False) if valid is None else F.coalesce(valid, F.lit(False))
        picked = _in_few_parts(picked.select(*features, "_y", validates.alias("_valid"))).persist(StorageLevel.MEMORY_AND_DISK)
        found = picked.groupBy("_valid").agg(F.min("_y").alias("least"), F.max("_y").alias("most"), F.count(F.lit(1)).alias("n")).collect()
        self.least, self.most = next(((r.least, r.most) for r in found if not r._valid), (None, None))
        self.validated = None if valid is None else any(r._valid for r in found)
        self.features, self.cuts = list(features), _cuts(picked, features)
        self.classes = [f"_c{i}" for i in range(len(features))]
        keys = [*self.classes, "_y", "_valid"]
        cells = _classed(picked, features, self.cuts).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        # boosting runs thousands of jobs: no more tasks than the rows need, and a fixed order whatever the layout of the log
        count = cells.count()
        self.shared = 2 * count <= sum(r.n for r in found)
        parts = min(1 + count // CELLS_PER_PART, PARTS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
        # few cells are dealt out again, up to a row each, or a tree's sample would leave out a lot at once and the
        # validation error go up and down with it
        dealt = F.least("_n", F.lit(float(max(1, CELLS_PER_PART // max(1, count)))))
        ordered = assemble(cells.repartition(parts, *keys).sortWithinPartitions(*keys), self.classes)
        told = ordered.select("features", "_y", "_valid", (F.col("_n") / dealt).alias("_n"), F.explode(F.sequence(F.lit(1), dealt.cast("int"))))
        self.used = told.drop("col").persist(StorageLevel.MEMORY_AND_DISK)
        self.used.count()
        cells.unpersist()
        picked.unpersist()

    def boosted(self, kind, settings: Sequence[Boosting]) -> list:
        """The fitted models of an ensemble, grown side by side: a model takes its trees one after the other."""
        shared_dir(self.used.sparkSession, "boosting")  # sets a checkpoint folder, or the lineage grows with the trees
        stop = {"validationIndicatorCol": "_valid", "validationTol": LEAST_GAIN} if self.validated else {}
        fits = [
            kind(
                featuresCol="features",
                labelCol="_y",
                weightCol="_n",
                maxDepth=s.depth,
                stepSize=s.rate,
                maxIter=min(s.trees, FIXED_TREES) if self.validated is False else s.trees,
                subsamplingRate=s.subsample,
                seed=s.seed,
                maxBins=BINS,
                maxMemoryInMB=1024,
                **stop,
            ).fit
            for s in settings
        ]
        with ThreadPool(len(fits)) as pool:
            tasks = [inheritable_thread_target(self.used.sparkSession)(partial(fit, self.used)) for fit in fits]
            models = pool.map(lambda task: task(), tasks)
        self.used.unpersist()
        return models

    def scored(self, df: DataFrame, models: Sequence, score) -> DataFrame:
        """Add ``_m0``, ``_m1``, ...: ``score`` of what each model adds. Where rows share their classes, each is scored once."""
        rows = _classed(df, self.features, self.cuts)
        told = assemble(rows.select(*self.classes).distinct() if self.shared else rows, self.classes)
        for i, model in enumerate(models):
            told = model.transform(told).withColumn(f"_m{i}", score).drop("rawPrediction", "probability", "prediction")
        told = told.drop("features")
        return rows.join(stored(told, "class-scores"), self.classes) if self.shared else told


def recall_ensemble(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    train: Column,
    valid: Column | None = None,
    settings: Sequence[Boosting] = (),
    out: str = "recall_proba",
) -> DataFrame:
    """Mean probability of several boosted classifiers for every row.

    With ``valid`` each model grows until these rows gain nothing more: the threshold of ``recalled`` is a share of
    failures, and the first trees are far above it on every row. Training rows of one class have that class only.
    """
    labelled = df.withColumn("_y", F.col(label).cast("double"))
    cells = _Cells(labelled, features, train, valid)
    if cells.least is not None and cells.least == cells.most:
        cells.used.unpersist()
        return df.withColumn(out, F.lit(cells.least))
    settings = settings or draw_settings(3, 100)
    rows = cells.scored(df, cells.boosted(GBTClassifier, settings), vector_to_array("probability")[1])
    return rows.select(*df.columns, _mean([f"_m{i}" for i in range(len(settings))]).alias(out))


def recalled(df: DataFrame, proba: str = "recall_proba", threshold: float = RECALL_THRESHOLD) -> DataFrame:
    return df.where(F.col(proba) >= threshold)


def judge(df: DataFrame, predicted: Sequence[str], limit: float, alarm_at: float) -> DataFrame:
    """Mean of the models' days clipped to [0, limit], the score, and the alarm flag."""
    days = F.least(F.greatest(_mean(predicted), F.lit(0.0)), F.lit(limit))
    return df.withColumn("pred_days", days).withColumns(
        {
            "score": (F.lit(limit) - F.col("pred_days")) / F.lit(limit),
            "pred_label": F.when(F.col("pred_days") <= alarm_at, 1).otherwise(0),
        }
    )


def fault_time_regressor(
    df: DataFrame,
    features: Sequence[str],
    days: str,
    train: Column,
    limit: float = 0.25,
    alarm_at: float = 0.1,
    settings: Sequence[Boosting] = (),
) -> DataFrame:
    """Boosted regression of the clipped days to failure, turned into scores and alarms.

    Without a training row nothing is known of failures: every row has ``limit`` days and no alarm.
    """
    cells = _Cells(df.withColumn("_y", failure_target(F.col(days), limit)[0]), features, train, None)
    settings = settings or draw_settings(3, 100)
    names = [f"_m{i}" for i in range(len(settings))]
    if cells.least is None:
        cells.used.unpersist()
        rows = df.withColumns({n: F.lit(limit) for n in names})
    else:
        rows = cells.scored(df, cells.boosted(GBTRegressor, settings), F.col("prediction"))
    judged = judge(rows, names, limit, alarm_at)
    return judged.select(*df.columns, "pred_days", "score", "pred_label")


def multilabel_time_model(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[str],
    train: Column,
    iterations: int = 50,
    n_thresholds: int = 512,
    valid: Column | None = None,
) -> tuple[DataFrame, list[float]]:
    """One probability per time label over scaled features, and the best threshold of each.

    Thresholds are chosen on the ``valid`` rows only (all rows if not given).
    """
    scaled = assemble(scale_features(df, features, train), features)
    used = scaled.where(train).persist(StorageLevel.MEMORY_AND_DISK)
    rows, outs = scaled, []
    for i, label in enumerate(labels):
        model = LogisticRegression(
            featuresCol="features",
            labelCol="_y",
            maxIter=iterations,
            regParam=1e-3,
            standardization=False,
            predictionCol=f"_p{i}",
            probabilityCol=f"_proba{i}",
            rawPredictionCol=f"_raw{i}",
        ).fit(used.withColumn("_y", F.col(label).cast("double")))
        proba = vector_to_array(f"_proba{i}")
        # With one class in the training rows the model has one probability only.
        value = proba[1] if model.numClasses > 1 else F.lit(0.0)
        rows = model.transform(rows).withColumn(f"proba_{i}", value)
        outs.append(f"proba_{i}")
    used.unpersist()
    scored = rows.select(*[c for c in df.columns if c not in features], *outs)
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    judged = scored if valid is None else scored.where(valid)
    # all labels in one pass: long rows of (label, score, truth)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(p).alias("p"), F.col(y).cast("int").alias("y")) for i, (p, y) in enumerate(zip(outs, labels))])
    long = judged.select(F.explode(cells).alias("_c")).select("_c.*").withColumnRenamed("i", "_label")
    table = f1_over_thresholds(long, "p", "y", 0.0, 0.9, n_thresholds, ["_label"]).where("f1 > 0")
    best = table.groupBy("_label").agg(F.min_by("threshold", F.struct(-F.col("f1"), "threshold")).alias("t")).collect()
    found = {r["_label"]: r["t"] for r in best}
    scored.unpersist()
    return scored, [found.get(i, 0.0) for i in range(len(labels))]


#: The weights of a fold's model and of the one on all data, in the blend for unlabelled rows.
FOLD_WEIGHT, FULL_WEIGHT = 0.08, 0.5


def fault_classifier(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    fold: str,
    folds: int,
    trees: int = 100,
    depth: int = 4,
    seed: int = 2022,
) -> DataFrame:
    """Weighted four-class forests, one per fold and one on all labelled rows: ``probs`` and ``pred`` of every row.

    A labelled row gets the probabilities of the model that has not seen its fold. A row without a label
    (null or negative) gets the weighted mean of all models, the fold's ones and the full one.
    """
    known = F.coalesce(F.col(label) >= 0, F.lit(False))
    rows = assemble(df, features).withColumns(
        {"_y": F.when(known, F.col(label)).cast("double"), "_w": sample_weight(F.when(known, F.col(label)))}
    )
    rows = stored(rows, "classifier-rows")
    labelled, new = rows.where(known), rows.where(~known)

    def fit(part: DataFrame, number: int):
        return RandomForestClassifier(
            featuresCol="features", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed + number
        ).fit(part)

    def add(part: DataFrame, model, name: str) -> DataFrame:
        scored = model.transform(part).withColumn(name, vector_to_array("probability"))
        return scored.drop("rawPrediction", "probability", "prediction")

    parts, blend = [], []
    for i in [*range(folds), None]:
        model = fit(labelled if i is None else labelled.where(F.col(fold) != i), folds if i is None else i)
        if i is not None:
            parts.append(add(labelled.where(F.col(fold) == i), model, "probs").select(*df.columns, "probs"))
        new = add(new, model, f"_p{len(blend)}")
        blend.append(FULL_WEIGHT if i is None else FOLD_WEIGHT)
    mixed = F.transform(
        F.arrays_zip(*[f"_p{j}" for j in range(len(blend))]),
        lambda p: sum((p[f"_p{j}"] * w for j, w in enumerate(blend)), F.lit(0.0)) / sum(blend),
    )
    out = new.withColumn("probs", mixed).select(*df.columns, "probs")
    for part in parts:
        out = out.unionByName(part)
    best = F.array_position(F.col("probs"), F.array_max("probs")) - 1
    return out.withColumn("pred", best.cast("long"))


def alarm_chain(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    days: str,
    train: Column,
    valid: Column | None = None,
    recall_settings: Sequence[Boosting] = (),
    time_settings: Sequence[Boosting] = (),
    threshold: float = RECALL_THRESHOLD,
    limit: float = 0.25,
    alarm_at: float = 0.1,
) -> DataFrame:
    """From rows to judged rows: recall, the filter at its threshold, days to failure of what is left, alarms.

    The regressor learns from recalled training rows only; rows that are not recalled raise no alarm
    and are not returned. ``valid`` rows say when the recall models have learned enough.
    """
    scored = stored(recall_ensemble(df, features, label, train, valid, recall_settings), "recall")
    return fault_time_regressor(recalled(scored, threshold=threshold), features, days, train, limit, alarm_at, time_settings)
