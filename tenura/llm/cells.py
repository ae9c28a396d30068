"""Dealing the members of buckets that still hold several components into bounded cells.

Of such a bucket every pair of different components has to be looked at.  The members of
its largest component need no pairs among themselves, so they are dealt into blocks once;
the others are dealt into blocks too and meet every block.  A bucket with one component
and a few outsiders therefore ships each member about once, however large it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.frames import cut_lineage


def deal(at: DataFrame, key: list[str], node: str, cell: int) -> DataFrame:
    """at (key.., node, comp, ..) -> the same with (c0, c1, i): ``i`` is the member's block in its
    bucket, (c0, c1) with c0 <= c1 the two blocks that meet.  Buckets of one component go.
    Block c0 never belongs to the largest component."""
    sizes = (at.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*key).agg(F.sum("n").alias("k"), F.max("n").alias("most"), F.max_by("comp", "n").alias("largest")))
    sizes = cut_lineage(sizes.filter("k > most").select(
        *key, "largest", F.ceil(F.col("most") / cell).cast("int").alias("nb"),
        F.ceil((F.col("k") - F.col("most")) / cell).cast("int").alias("mb")))
    dealt = F.xxhash64(node)
    inside = F.col("comp") == F.col("largest")
    own = F.when(inside, F.col("mb") + F.pmod(dealt, F.col("nb"))).otherwise(F.pmod(dealt, F.col("mb"))).cast("int")
    last = F.when(inside, F.col("mb")).otherwise(F.col("mb") + F.col("nb")) - 1
    return (at.join(sizes, key).withColumn("i", own)
            .withColumn("j", F.explode(F.sequence(F.lit(0), last.cast("int"))))
            .withColumn("c0", F.least("i", "j")).withColumn("c1", F.greatest("i", "j"))
            .drop("largest", "nb", "mb", "j"))
