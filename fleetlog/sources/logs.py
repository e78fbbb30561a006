"""Reading, joining up and storing logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.session import shared_dir

# The 24 kernel-log flags.
KERNEL_FLAGS = [
    "1_hwerr_f", "1_hwerr_e", "2_hwerr_c", "2_sel", "3_hwerr_n", "2_hwerr_s",
    "3_hwerr_m", "1_hwerr_st", "1_hw_mem_c", "3_hwerr_p", "2_hwerr_ce", "3_hwerr_as",
    "1_ke", "2_hwerr_p", "3_hwerr_kp", "1_hwerr_fl", "3_hwerr_r", "_hwerr_cd",
    "3_sup_mce_note", "3_cmci_sub", "3_cmci_det", "3_hwerr_pi", "3_hwerr_o", "3_hwerr_mce_l",
]

_ORIGIN = "collect_time string, manufacturer int, vendor int"
ADDRESS_LOG = (
    "serial_number string, memory int, rankid int, bankid int, row int, col int, " + _ORIGIN
)
MCE_LOG = "serial_number string, mca_id string, transaction int, " + _ORIGIN
KERNEL_LOG = (
    "serial_number string, " + ", ".join(f"`{f}` int" for f in KERNEL_FLAGS) + ", " + _ORIGIN
)
FAILURE_TAG = "serial_number string, failure_time string, tag string, manufacturer int, vendor int"
EVENT_LOG = "sn string, time string, msg string, server_model string"
TICKET = "sn string, fault_time string, label int"
MODULE_CAUSES = "sn string, fault_time string, module string, module_cause string"
CRASH_DUMP = "sn string, fault_time string, fault_code string"

CORRUPT = "_corrupt_record"


def read_log(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV with a header and a declared schema; ``columns`` are pruned in the scan.

    With ``keep_corrupt`` lines that do not fit are kept and shown in ``_corrupt_record``.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    # Columns in the file but not in the schema are matched by position, so the header is checked.
    if keep_corrupt:
        declared = T.StructType(declared.fields + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    log = reader.schema(declared).option("enforceSchema", False).csv(path)
    if columns is not None:
        log = log.select(*[f"`{c}`" for c in columns])
    return log.limit(limit) if limit is not None else log


def union_logs(
    logs: Sequence[DataFrame],
    columns: Sequence[str] | None = None,
    fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """UNION ALL by name; columns a log does not have become null or their ``fill`` constant."""
    fill = fill or {}
    prepared = []
    for log in logs:
        missing = {c: F.lit(v) for c, v in fill.items() if c not in log.columns}
        log = log.withColumns(missing) if missing else log
        prepared.append(log.select(*[c for c in columns if c in log.columns]) if columns else log)
    out = prepared[0]
    for log in prepared[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def save_features(df: DataFrame, path: str, by: Sequence[str] = (), rows_per_file: int = 5_000_000) -> None:
    """Write an intermediate table as Parquet, replacing what was there.

    Partition values are spread by the writer's own rebalancing, so one busy month does not end
    in one task.
    """
    out = df.hint("rebalance", *by) if by else df
    writer = out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bucketed(df: DataFrame, purpose: str, key: Sequence[str], buckets: int | None = None, placed: bool = False) -> DataFrame:
    """Store an intermediate table in buckets of its key, and read it back.

    Joins and aggregations on the whole key of tables with as many buckets (by default the session's shuffle
    partitions) need no exchange. A bucket is one file of one task. A table that an aggregation by the key has just
    ``placed`` is written where it is. The table's name is given back at
    once: its files lie in the shared folder like those of ``stored``.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, purpose)
    name = "stored_" + path.rsplit("-", 1)[1]
    spread = df if placed else df.repartition(buckets, *key)
    spread.write.option("path", path).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_replay(log: DataFrame, path: str, time: str = "t", by: str = "day") -> None:
    """Store history for replay: one folder per day, rows of a day ordered by time.

    A day of any size is cut into time ranges first, so it is written by several tasks.
    """
    dated = log.withColumn(by, F.date_format(F.timestamp_seconds(F.col(time)), "yyyy-MM-dd"))
    ranged = dated.repartitionByRange(F.col(by), F.col(time)).sortWithinPartitions(by, time)
    ranged.write.mode("overwrite").partitionBy(by).parquet(path)


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Stream the stored history in file order."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def replay_logs(
    spark: SparkSession, logs: Mapping[str, tuple[str, T.StructType]], common: Sequence[str], files_per_trigger: int = 1
) -> DataFrame:
    """Stored logs of different columns as one stream: ``log`` (their name), the common columns, and ``body``.

    ``logs`` gives each log's folder and schema. ``body`` holds the columns of a log that are not common as JSON, missing ones
    left out.
    """
    streams = []
    for name, (path, schema) in logs.items():
        own = [F.col(f.name) for f in schema.fields if f.name not in common]
        body = F.to_json(F.struct(*own)) if own else F.lit("{}")
        rows = replay(spark, path, schema, files_per_trigger)
        streams.append(rows.select(F.lit(name).alias("log"), *common, body.alias("body")))
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out
