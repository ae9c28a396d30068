"""Window building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest_row(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """``QUALIFY ROW_NUMBER() OVER (PARTITION BY p ORDER BY o) = 1``.

    ``row_number() = 1`` is planned with a partial window-group limit ahead of
    the shuffle, so a hot partition key sends one row per map task.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def top_n_per_key(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in ``order`` (``order`` must be total for determinism)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
