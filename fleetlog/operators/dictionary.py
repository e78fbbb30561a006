"""Category dictionaries, target encoding and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.operators import scan


def fit_dictionary(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """(cat, id): dense ids in the order of first appearance; ties by the value itself."""
    first = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("cat"))
        .agg(F.min(order_by).alias("_first"))
    )
    return scan.ordinal(scan.by_quantile(first, "_first"), [], ["_first", "cat"], "id").select(
        "cat", "id"
    )


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """(cat, id): dense ids in sorted order."""
    values = df.select(F.col(column).alias("cat")).where("cat is not null").distinct()
    return scan.ordinal(scan.by_quantile(values, "cat"), [], ["cat"], "id").select("cat", "id")


def encode(df: DataFrame, dictionary: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Replace known values by their id; unseen values stay as they are."""
    kind = df.schema[column].dataType
    known = dictionary.select(F.col("cat").alias("_cat"), F.col("id").alias("_id"))
    code = F.col("_id").cast(kind) if isinstance(kind, T.StringType) else F.col("_id")
    coded = df.join(known, F.col(column) == F.col("_cat"), "left")
    value = F.coalesce(code, F.col(column))
    return coded.select(*[c for c in df.columns if c != (out or column)], value.alias(out or column))


def decode(df: DataFrame, dictionary: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Back from ids to values; unknown ids stay as they are."""
    kind = dictionary.schema["cat"].dataType
    known = dictionary.select(F.col("cat").alias("_cat"), F.col("id").alias("_id"))
    value = F.coalesce(F.col("_cat"), F.col(column).cast(kind))
    return df.join(known, F.col(column).try_cast("long") == F.col("_id"), "left").select(
        *[c for c in df.columns if c != (out or column)], value.alias(out or column)
    )


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    labels = fit_labels(df, column).select(F.col("cat").alias("_cat"), F.col("id").alias(out))
    return df.join(labels, F.col(column) == F.col("_cat"), "left").drop("_cat")


def target_encode(df: DataFrame, category: str, target: str, m: float = 1) -> DataFrame:
    """Category mean pulled towards the overall mean: ``w = n/(n+m)``."""
    overall = df.agg(F.avg(target).alias("a")).scalar()
    n, mean = F.count(target), F.avg(target)
    stats = df.groupBy(category).agg(n.alias("n"), mean.alias("_mean"))
    w = F.col("n") / (F.col("n") + F.lit(float(m)))
    return stats.select(category, "n", (w * F.col("_mean") + (1 - w) * overall).alias("score"))


def feature_report(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.95, 0.99),
) -> DataFrame:
    """Per column: nulls, distinct values (null is one), type; of numbers also mean, std, least, largest, quantiles.

    Columns become (feature, value, count) rows, so distinct values and exact quantiles of all
    columns come from the same counts without one task holding a column. Values that are no numbers are
    told apart by their text and have nulls in the columns of numbers.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name in columns]
    number = lambda c: F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
    points = scan.cut_points(df, {c: F.col(c).cast("double") for c in numbers}) if numbers else {}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                number(c).alias("_x"),
                # whole numbers and decimals that are one double are still different values
                (F.lit(None).cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string")).alias("_own"),
                scan.chunk_of(number(c), points.get(c, [])).alias(scan.CHUNK),
            )
            for c in columns
        ]
    )
    counts = (
        df.select(F.explode(cells).alias("_c"))
        .select("_c.*")
        .groupBy("feature", "_x", scan.CHUNK, "_own")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("feature", "_x", scan.CHUNK)
        .agg(
            F.sum("_n").alias("_n"),
            F.sum(F.when(F.col("_x").isNull() & F.col("_own").isNull(), F.col("_n")).otherwise(0)).alias("_missing"),
            F.count(F.lit(1)).alias("_own"),
        )
    )
    x, n = F.col("_x"), F.col("_n")
    known = F.when(x.isNotNull(), n).otherwise(0)
    ranked = scan.rank_counts(counts.withColumn("_k", known), ["feature"], "_x", F.col("_k"))
    # Squares are taken around a value from the middle of the column.
    middle = F.coalesce(
        *[F.when(F.col("feature") == c, F.lit(p[len(p) // 2])) for c, p in points.items() if p],
        F.lit(0.0),
    )
    off, count = x - middle, F.sum("_k")
    squares = F.sum(off * off * n) - F.sum(off * n) * F.sum(off * n) / count
    named = {f"p{round(q * 100)}": q for q in quantiles}
    kind = F.create_map(*[F.lit(v) for c in columns for v in (c, kinds[c])])
    return ranked.groupBy("feature").agg(
        F.sum("_missing").alias("missing"),
        F.sum("_own").alias("uniques"),
        F.sum(n - F.col("_missing")).alias("count"),
        F.try_divide(F.sum(x * n), count).alias("mean"),
        F.when(F.max("_x").isNotNull(), F.sqrt(F.try_divide(F.greatest(squares, F.lit(0.0)), count - 1))).alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        *scan.quantile_aggregates("_x", "_k", named),
    ).withColumn("type", kind[F.col("feature")])


def failure_from_log(
    log: DataFrame,
    failure_time: str = "failure_t",
    tag: str = "tag",
    by: Sequence[str] = ("sn",),
    order: Sequence[str] = ("t", "id"),
) -> DataFrame:
    """Failure time and tag on the last log row of a machine that carries a failure time."""
    place = F.when(F.col(failure_time).isNotNull(), F.struct(*order))
    last = log.groupBy(*by).agg(F.max_by(F.struct(failure_time, tag), place).alias("_last"))
    return last.where("_last is not null").select(*by, "_last.*")


def top_by_size(table: DataFrame, size: str, n: int) -> DataFrame:
    """Rows whose size is at least that of the n-th largest: ties are kept."""
    limit = table.select(size).orderBy(F.col(size).desc()).limit(n).agg(F.min(size).alias("m")).scalar()
    return table.where(F.col(size) >= limit)
