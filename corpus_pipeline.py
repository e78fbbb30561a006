"""A training corpus from raw documents: language, near copies, benchmark passages, mix, token files.

Every stage gets what the stage before kept, read back from Parquet in the session's shared
folder, and returns the columns of documents; the last one returns what the token files say
of each document (doc_id, start, n_tokens, ids_crc32).

Empty tables pass through every stage. Columns beside doc_id, text, lang and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.llm import decontaminate, language, mixing, setsketch, tokens
from fleetlog.llm.base import shared_dir, start, table
from fleetlog.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with confidence."""
    start(spark)
    found, _, _, rejected = language.identify(docs, language.fit(docs))
    return found.where(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    start(spark)
    return setsketch.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    found, flag = decontaminate.verdicts(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each time that their source's target takes them."""
    start(spark)
    rows = mixing.keyed(mixing.sized(docs, carry=docs.columns), table(spark, sf_dir, "labels"))
    return mixing.taken_rows(*mixing.mix(rows), docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; per document, what reading them back gives."""
    start(spark)
    return tokens.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", token_files),
]

#: A trained model decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
