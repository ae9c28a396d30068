"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.session import checkpoint_dir, ship_package

NO_ID = (1 << 63) - 1      # stands for a null id: later than any other


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut_lineage, for larger intermediate results: a Parquet table in the shared folder,
    which takes a third of a checkpoint's space.  It is left there like a checkpoint."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_are_unique(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Reads the id column only."""
    did = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("did")
    return docs.select(did).groupBy("did").count().filter("count > 1").isEmpty()


def keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         unique: bool | None = None) -> tuple[Column, Column]:
    """(did, uid): ``did`` is the id, a null last; ``uid`` is 0 where ids are unique and a
    hash of the text otherwise, so rows of equal id and other text stay apart and repeated
    rows count as one document."""
    did = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("did")
    if unique is None:
        unique = ids_are_unique(docs, doc_id)
    return did, (F.lit(0).cast("long") if unique else text_uid(text)).alias("uid")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(did, uid, text) of every row, and of every document (equal rows once)."""
    unique = ids_are_unique(docs, doc_id)
    did, uid = keys(docs, doc_id, text, unique)
    rows = docs.select(did, uid, F.col(text).cast("string").alias("text"))
    return rows, rows if unique else rows.dropDuplicates(["did", "uid"])


def text_uid(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(text).isNull())
