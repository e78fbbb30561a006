"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources, ordered by code point with the missing one last, have the weights 1, 2, 3, 1, 2, 3, ... A
source's target is its share by weight of all words, but at most three times its own words; what
is over goes to the others by weight until none is above. Within a source every document has an
exponential key ``-ln(u) / weight`` (``u`` from a hash of the id, ``weight`` from its quality);
whole passes over the source come first, then documents in the order of their keys until the
budget is used up. The document at the border gives the words that still fit, so a source's
sum is its target without the fraction.

No source is sorted as a whole. Keys are cut into ranges, each range's words are added up before
the shuffle, a running sum over the (few) ranges finds the one that holds the border, and only
that range is put in order, to find the border itself: a key. Every document then decides alone. The
number of ranges follows the source's documents, so a source may hold any share of the rows.

All this runs on a narrow table (source, id, size, key) that is stored once; texts are not shuffled
but where quality labels are joined to whole rows. What comes to the documents by source, one row a
source, is broadcast if it has at most ``BROADCAST_SOURCES`` rows (counted) and joined otherwise.

Defined cases: a missing or empty text has size 0 and gives nothing. A source of size 0 has target
0. A missing id is hashed as empty text. Rows equal in id and text are one in the order; at the border they
share what fits evenly, and the remainder of that division is left out. Repeated quality labels: the highest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.base import fresh, stored, word_count

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Documents that a key range holds on average; the load of a task, not the result, depends on it.
RANGE_ROWS = 4_000
BROADCAST_SOURCES = 100_000
#: Sampling weight of a document by its quality label; unlabelled ones are in between.
QUALITY_WEIGHTS = {0: 1.0, 1: 2.0}
UNLABELLED_WEIGHT = 1.5


def uniform(doc_id: Column, tie: Column) -> Column:
    """A number in (0, 1] from the md5 of id and text hash."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), tie)
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 1.0) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, size, n) -> (source, source_size, n, target), by filling up to the caps.

    With x words for each unit of weight, a source gets min(3 * size, x * weight). Sources reach
    their cap in the order of cap / weight. What the sources from the k-th on would get for a unit of
    weight rises with k until no cap below binds and falls from there, so x is its largest value.
    """
    # one row a source: a list of corpora, not of documents
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = ranked.select("source", "size", "n", w.alias("w"), (F.col("size") * MAX_PASSES).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "left": F.sum("size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    level = F.col("left") / F.col("weight_left")
    rows = rows.withColumn("level", F.max(level).over(everything))
    return rows.select("source", F.col("size").alias("source_size"), "n", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """What the sampling needs of each row: source, id, size and text hash; and ``row``, the columns to carry."""
    kept = carry if carry is not None else [doc_id]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{doc_id}`").alias("id"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("tie"),
        word_count(F.col(f"`{text}`")).alias("size"),
    )


def keyed(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows of ``sized`` with their sampling key, weighted by quality labels if there are any."""
    weight = F.lit(1.0)
    if labels is not None:
        known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("q"))
        # labels grow with the documents: the same join at every size
        rows = rows.join(known.hint("merge"), rows.id == known.labelled, "left")
        weight = F.lit(UNLABELLED_WEIGHT)
        for q, w in QUALITY_WEIGHTS.items():
            weight = F.when(F.col("q") == q, F.lit(w)).otherwise(weight)
    key = -F.log(uniform(F.col("id"), F.col("tie"))) / weight
    return rows.select("row", "source", "id", "tie", "size", key.alias("key"))


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join a stored table of one row a source (column s); broadcast if its counted rows are few."""
    small = F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source
    return rows.join(small, rows.source.eqNullSafe(small.s))


def mix(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The carried columns of all rows of ``keyed`` with ``size``, ``source_size``, ``target`` and ``taken``.

    Returns also the names under which these stand.
    """
    columns = rows.schema["row"].dataType.names
    names: dict[str, str] = {}
    for n in ("size", "source_size", "target", "taken"):
        names[n] = fresh(n, [*columns, *names.values()])
    light = stored(rows.drop("row"), "mixing")
    goal = targets(light.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = goal.select(F.col("source").alias("s"), "source_size", "target", passes.alias("passes"), F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"))
    budget = stored(budget.withColumn("rest", F.floor("target").cast("long") - F.col("passes") * F.col("source_size")), "budget")
    # grows with the key, so ranges are in the order of the keys
    placed = _by_source(light, budget).withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))
    sums = placed.groupBy("s", "part", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("part"))
    at = sums.withColumn("before", upto - F.col("words")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    at = stored(at.select("s", F.col("part").alias("at_part"), (F.col("rest") - F.col("before")).alias("open")), "borders")
    inside = _by_source(placed.drop("s"), at).where(F.col("part") == F.col("at_part"))
    place = F.struct("key", "id", "size", "tie")
    inside = inside.groupBy("s", place.alias("place"), "open").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = inside.withColumn("left", F.col("open") - before).where((F.col("left") >= 0) & (F.col("left") < F.col("words")))
    border = border.select(F.col("s").alias("bs"), F.col("place").alias("border"), F.floor(F.col("left") / F.col("rows")).alias("partly"))
    plan = stored(budget.join(border, budget.s.eqNullSafe(border.bs), "left").select("s", "source_size", "target", "passes", "border", "partly"), "plan")
    part = F.when(F.col("border").isNull() | (place > F.col("border")), F.lit(0)).when(place < F.col("border"), F.col("size")).otherwise(F.col("partly"))
    return _by_source(rows, plan).select(
        "row.*",
        F.col("size").alias(names["size"]),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
        (F.col("passes") * F.col("size") + part).cast("long").alias(names["taken"]),
    ), names


def taken_rows(mixed: DataFrame, names: dict[str, str], columns: list[str], text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The mix itself: a document once for each pass, and at the border with the words that fit.

    Whole copies stay as they are. A cut document's text ends with the last word taken, and its column
    ``length``, if there is one, says how long that is.
    """
    size, taken = F.col(names["size"]), F.col(names["taken"])
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(0).cast("int")
    copy, cut = fresh("copy", mixed.columns), fresh("cut", mixed.columns)
    times = whole + F.when(rest > 0, 1).otherwise(0)
    out = mixed.where(taken > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    out = out.withColumn(cut, F.when(F.col(copy) > whole, F.concat_ws("", F.slice(words, 1, F.greatest(rest, F.lit(1))))))
    kinds = dict(mixed.dtypes)
    new = {text: F.coalesce(cut, F.col(f"`{text}`"))}
    if length in columns:
        new[length] = F.coalesce(F.length(cut).cast(kinds[length]), F.col(f"`{length}`"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])
