"""What the operators of this folder share: sessions, tables, and work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlog.session import configure, shared_dir, stored

__all__ = ["append", "batches_to_rows", "crc32_of_id", "fresh", "held_out", "shared_dir", "start", "stored", "table", "word_count"]

#: Python tasks hold one Arrow batch; rows and bytes bound it, whatever the texts' lengths.
BATCH_ROWS = "2000"
BATCH_BYTES = "16m"


def start(spark: SparkSession) -> SparkSession:
    """Settings for tasks that get whole texts: small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return start(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a missing id counts as empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from. A missing id is held out."""
    return crc32_of_id(doc_id) % 5 == 0


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores put behind until no column has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; 0 for a missing one.

    A word starts where a character follows a separator or the beginning, so counting starts
    is enough; Spark does it in generated code.
    """
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def append(df: DataFrame, fields: dict[str, str], work: Callable[[list], list], column: str = "text") -> DataFrame:
    """Add columns that ``work`` makes from the list of one column's values, batch by batch.

    ``work`` returns one list or array per field. All other columns pass unchanged; the caller
    gives names that are not taken.
    """
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    schema = T.StructType([*df.schema.fields, *added.fields])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(added)
        for batch in batches:
            made = [pa.array(x, type=f.type) for x, f in zip(work(batch.column(at).to_pylist()), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *types.names])

    return df.mapInArrow(run, schema)


def batches_to_rows(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """Turn every Arrow batch into rows of another shape: ``work`` returns a list per column."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(kind)
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in types], schema=types)

    return df.mapInArrow(run, kind)
