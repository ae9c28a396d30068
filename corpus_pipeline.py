"""The training-data pipeline: language, lines, near copies, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result as Parquet in the shared checkpoint folder and reads it as the next one's
docs, so a lost executor never repeats an earlier stage.  All stages but the last return
the columns of ``documents``; the last adds ``copies``, how often the mix takes a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tenura.llm import decontaminate, langid, linededup, minhash, mixing
from tenura.llm.frames import read_table
from tenura.session import checkpoint_dir, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; ``und`` and doubtful ones go."""
    ship_package(spark)
    return langid.known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of many sources go but for their first occurrence; every row stays."""
    ship_package(spark)
    return linededup.without_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return minhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies),
          ("benchmark_leaks", benchmark_leaks), ("mix", mix)]

# A trained language model and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
