"""From the three hardware logs of a machine to one labelled feature table.

Every family is a table with one row per machine and observation window. The logs are collapsed
to distinct rows per second with a count first, once for all families; an error storm shrinks to
its distinct addresses there. The collapsed logs and the families are written to the shared
folder: no log is read more than once, and the final join has a short plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions import encode, timegrid
from fleetlog.operators import bins, joins, trailing
from fleetlog.operators.dictionary import encode as apply_dictionary
from fleetlog.session import stored
from fleetlog.sources.logs import KERNEL_FLAGS, bucketed

KEY = ["sn", "bin"]

# Window lengths in minutes.
ADDRESS_COUNT = [15, 120, 360, 720, 1440, 2880]
ADDRESS_DISTINCT = [5, 15, 120, 720, 1440, 2880]
ADDRESS_HOURS = [1440, 2880]
ADDRESS_SPREAD = [5, 30, 360, 1440, 2880]
KERNEL_COUNT = [15, 360, 720, 1440, 2160]
KERNEL_SUM = [120, 720, 1440, 2880]
MCE_COUNT = [15, 120, 360, 720, 1440, 2160]
MCE_DISTINCT = [5, 15, 60, 720, 1440, 2880]
TRANSACTION_DISTINCT = [15, 120, 720, 1440, 2880]
TRANSACTION_SUM = [30, 720, 1440, 2880]

#: Families whose last step goes along a machine; the others end with an aggregation by the key.
ALONG_MACHINE = ("volume", "recency", "transactions")

PARTS = ["memory", "rankid", "bankid", "row", "col"]
IDENTITIES = {
    "memory": ["memory"],
    "rank": ["memory", "rankid"],
    "bank": ["memory", "rankid", "bankid"],
    "row": ["memory", "rankid", "bankid", "row"],
    "col": ["memory", "rankid", "bankid", "col"],
    "cell": PARTS,
}


def on_grid(log: DataFrame, origin: int = timegrid.ORIGIN_2019) -> DataFrame:
    """Parse machine and time of a raw log and place its rows on the window grid."""
    parsed = log.withColumns(
        {
            "sn": encode.parse_entity_id(F.col("serial_number")),
            "t": timegrid.parse_time(F.col("collect_time")),
        }
    )
    return with_bins(parsed.drop("serial_number", "collect_time"), origin)


def with_bins(df: DataFrame, origin: int) -> DataFrame:
    binned = df.withColumn("bin", timegrid.time_bin(F.col("t"), origin))
    return binned.withColumn("edge", timegrid.bin_edge(F.col("bin"), origin))


def prepare_address(log: DataFrame, order: Sequence[str] = ("t", "id"), sentinel: int = -1) -> DataFrame:
    """Fill unknown address parts forward on each machine."""
    return bins.forward_fill(log, PARTS, order=order, sentinel=sentinel)


def origin_flags(log: DataFrame) -> DataFrame:
    """One-hot vendor and manufacturer per window; the highest flag if rows disagree."""
    flags = [
        *encode.one_hot(F.col("vendor"), [0, 1, 2], "vendor"),
        *encode.one_hot(F.col("manufacturer"), [0, 1, 2, 3], "manufacturer"),
    ]
    coded = log.select(*KEY, *flags)
    names = [c for c in coded.columns if c not in KEY]
    return bins.bin_stats(coded, {n: ["max"] for n in names})


def _highest(per_second: DataFrame, columns: Sequence[str], origin: int) -> DataFrame:
    placed = per_second.withColumn("bin", timegrid.time_bin(F.col("t"), origin))
    return bins.bin_stats(placed, {c: ["max"] for c in columns})


def collapse(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows per machine and second in the given columns, with their number ``n``."""
    return log.groupBy("sn", "t", "bin", "edge", *columns).agg(F.count(F.lit(1)).alias("n"))


def _counts(
    log: DataFrame, windows: Sequence[int], stat: str, origin: int, weight: Column | None
) -> DataFrame:
    """Trailing counts: max per window, and mean or median of their change over the log rows."""
    # The window of zero minutes is the second itself: how many log rows a row stands for.
    counts = trailing.trailing_count(log, [0, *windows], weight=weight, change=True)
    placed = counts.withColumn("bin", timegrid.time_bin(F.col("t"), origin))
    stats = {f"cnt_{w}m": ["max"] for w in windows} | {f"cnt_{w}m_change": [stat] for w in windows}
    return bins.bin_stats(placed, stats, weight="cnt_0m")


def address_families(
    log: DataFrame, origin: int = timegrid.ORIGIN_2019, weight: Column | None = None
) -> dict[str, DataFrame]:
    """Volume, active hours, recency, distinct parts and spread of memory-error addresses."""
    volume = _counts(log, ADDRESS_COUNT, "median", origin, weight)
    shifted = [c for c in volume.columns if c not in KEY]
    # all parts of an address, and its hours, are counted in one pass over the log
    parts = {"hours": ["_hour"], **IDENTITIES}
    windows = {name: ADDRESS_HOURS if name == "hours" else ADDRESS_DISTINCT for name in parts}
    timed = log.withColumn("_hour", timegrid.elapsed_hours(F.col("t"), origin))
    found = trailing.trailing_distinct(timed, windows, parts)
    recency = bins.time_since_nth_last(log, [5, 50])
    spread = trailing.trailing_variance(log, ADDRESS_SPREAD, ["row", "col"], weight=weight)
    spreads = [f"{part}_var_{w}m" for part in ("row", "col") for w in ADDRESS_SPREAD]
    return {
        "volume": bins.shift_bins(volume, shifted, [10, 50, 150]),
        "parts": _highest(found, [f"{name}_{w}m" for name, some in windows.items() for w in some], origin),
        "recency": bins.shift_bins(recency, ["since_5_mean", "since_50_mean"], [10, 50]),
        "spread": _highest(spread.select("sn", "t", *spreads), spreads, origin),
    }


def kernel_families(
    log: DataFrame,
    flags: Sequence[str] = KERNEL_FLAGS,
    origin: int = timegrid.ORIGIN_2019,
    windows: Sequence[int] = KERNEL_SUM,
    weight: Column | None = None,
) -> dict[str, DataFrame]:
    """Volume and trailing flag sums of the kernel log; missing flags count as 0."""
    amounts = {f: F.coalesce(F.col(f"`{f}`"), F.lit(0)) for f in flags}
    sums = trailing.trailing_sums(log, windows, amounts)
    outs = [f"{f}_{w}m" for f in flags for w in windows]
    return {
        "kernel_volume": _counts(log, KERNEL_COUNT, "mean", origin, weight),
        "kernel_flags": _highest(sums, outs, origin),
    }


def prepare_mce(log: DataFrame, mca_ids: DataFrame, order: Sequence[str] = ("t", "id")) -> DataFrame:
    """Encode and fill the machine-check identifiers; still unknown values become -1."""
    coded = apply_dictionary(log, mca_ids, "mca_id")
    filled = bins.forward_fill(coded, ["mca_id", "transaction"], order=order)
    return filled.fillna("-1", subset=["mca_id"]).fillna(-1, subset=["transaction"])


def mce_families(
    log: DataFrame, origin: int = timegrid.ORIGIN_2019, weight: Column | None = None
) -> dict[str, DataFrame]:
    """Volume, distinct identifiers and transactions, and trailing transaction sums over windows."""
    windows = {"mca": MCE_DISTINCT, "kinds": TRANSACTION_DISTINCT}
    found = trailing.trailing_distinct(log, windows, {"mca": ["mca_id"], "kinds": ["transaction"]})
    # An unknown transaction counts as transaction 0, as in the one-hot encoding.
    coded = log.withColumn("_tx", F.when(F.col("transaction").isin(1, 2, 3), F.col("transaction")).otherwise(0))
    one = F.lit(1) if weight is None else weight
    amounts = {f"tx{i}": F.when(F.col("_tx") == i, one).otherwise(0) for i in range(4)}
    return {
        "mce_volume": _counts(log, MCE_COUNT, "mean", origin, weight),
        "identifiers": _highest(found, [f"{name}_{w}m" for name, some in windows.items() for w in some], origin),
        "transactions": trailing.trailing_bin_sums(coded, TRANSACTION_SUM, amounts, change=True),
    }


def join_families(base: DataFrame, families: dict[str, DataFrame], fill: float | None = None) -> DataFrame:
    return joins.feature_join(base, list(families.values()), KEY, fill)


def memory_table(
    address: DataFrame,
    mce: DataFrame,
    kernel: DataFrame,
    failures: DataFrame,
    origin: int = timegrid.ORIGIN_2019,
    flags: Sequence[str] = KERNEL_FLAGS,
) -> DataFrame:
    """Address features ⟕ mce ⟕ kernel, missing values 0, with calendar and time to failure."""
    n = F.col("n")
    makers = [c for c in ("vendor", "manufacturer") if c in address.columns]
    address = stored(collapse(address, [*PARTS, *makers]), "address")
    mce = stored(collapse(mce, ["mca_id", "transaction"]), "mce")
    kernel = kernel.groupBy("sn", "t", "bin", "edge").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"`{f}`").alias(f) for f in flags]
    )
    kernel = stored(kernel, "kernel")
    families = address_families(address, origin, n)
    if len(makers) == 2:
        families["origin"] = origin_flags(address)
    # The volume families of the two other logs are not part of this table.
    families |= {k: v for k, v in mce_families(mce, origin, n).items() if k != "mce_volume"}
    families |= {
        k: v for k, v in kernel_families(kernel, flags, origin, weight=n).items() if k != "kernel_volume"
    }
    # at most a shuffle by the key for each family when it is stored, none when they are joined
    families = {name: bucketed(family, name, KEY, placed=name not in ALONG_MACHINE) for name, family in families.items()}
    table = join_families(bucketed(bins.bin_last(address), "windows", KEY, placed=True), families, fill=0)
    fields = timegrid.calendar_fields(F.col("last_t"))
    table = table.withColumns(
        {"month": fields["month"], "global_day": timegrid.elapsed_days(F.col("last_t"), origin)}
    )
    return joins.time_to_failure_label(table, failures, time="last_t")
