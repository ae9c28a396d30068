"""Data-quality operators.

Each check is a DataFrame of findings (empty = pass), computed in one job;
``assert_empty`` turns a finding set into a failing query with
``raise_error`` so a pipeline stops on the executor side without collecting
the findings to the driver first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tenura.operators.ordering import union_counts


def table_counts(dfs: dict[str, DataFrame], extract_date: str | None = None,
                 label: str = "table_name", value: str = "row_count") -> DataFrame:
    """Labelled row counts (one UNION ALL job, no driver loop)."""
    out = union_counts(dfs, label, value)
    if extract_date is not None:
        out = out.withColumn("extract_date", F.lit(extract_date).cast("date"))
    return out


def present_tables(dfs: dict[str, DataFrame]) -> DataFrame:
    """One row for each table that exists and can be read, an empty one too; ``has_rows`` looks at
    one row of it and counts nothing."""
    looked = [df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("table_name"), (F.col("n") > 0).alias("has_rows")) for name, df in dfs.items()]
    return reduce(DataFrame.unionByName, looked)


def require_tables(spark: SparkSession, required: list[str], present: DataFrame,
                   name_col: str = "table_name") -> DataFrame:
    """Required names missing from ``present`` (left anti join)."""
    req = spark.createDataFrame([(n,) for n in required], f"{name_col} string")
    return req.join(present.select(name_col), name_col, "left_anti")


def assert_empty(findings: DataFrame, message: str, show: int = 50) -> DataFrame:
    """Fail the job with ``message`` + the finding list when ``findings`` has rows.

    The list holds the first ``show`` distinct findings in sorted order (then
    ``...`` when there are more), taken with a top-k that is bounded per task;
    it is built by an aggregate and raised by ``raise_error`` inside the query,
    so it runs where the data is and never gathers the whole finding set.
    """
    first = findings.columns[0]
    top = (findings.select(F.col(first).cast("string").alias("__v")).distinct()
                   .orderBy(F.col("__v").asc_nulls_first()).limit(show + 1))
    listed = top.agg(F.slice(F.array_sort(F.collect_list("__v")), 1, show).alias("l"),
                     F.count(F.lit(1)).alias("n"))
    text = F.concat(F.array_join(F.col("l"), ", "), F.when(F.col("n") > show, F.lit(", ...")).otherwise(F.lit("")))
    return listed.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit(message), text)))
                          .otherwise(F.lit("ok")).alias("check"))


def column_completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-NULL count, total and share per column, in one aggregate
    (``stack`` turns the single result row into one row per column)."""
    aggs = [F.count(F.lit(1)).alias("__total")] + [F.count(F.col(c)).alias(f"__nn_{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    stack = "stack({n}, {items}) as (column_name, non_null)".format(
        n=len(cols), items=", ".join(f"'{c}', __nn_{i}" for i, c in enumerate(cols)))
    return row.select("__total", F.expr(stack)).select(
        "column_name", "non_null", F.col("__total").alias("total"),
        F.round(F.when(F.col("__total") > 0, F.col("non_null") / F.col("__total")), 6).alias("non_null_share"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def empty_tables(counts: DataFrame, value: str = "row_count") -> DataFrame:
    """Tables whose count is zero."""
    return counts.where(F.col(value) == 0)


def count_drops(audit: DataFrame, pct: float, table: str = "table_name", date: str = "extract_date",
                value: str = "row_count") -> DataFrame:
    """Counts that fell by more than ``pct`` percent since the table's previous extract.

    The audit holds one row per (table, extract); the window is partitioned by
    table over that small history, not over data rows.
    """
    w = Window.partitionBy(table).orderBy(date)
    a = audit.withColumn("prev_count", F.lag(value).over(w))
    drop = F.round((F.col("prev_count") - F.col(value)) * 100.0 / F.col("prev_count"), 4)
    return (a.where(F.col("prev_count").isNotNull() & (F.col("prev_count") > 0))
             .withColumn("drop_pct", drop).where(F.col("drop_pct") > pct)
             .select(table, date, value, "prev_count", "drop_pct"))


def link_band(bridge: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Keys whose number of links lies outside [lo, hi]."""
    return bridge.groupBy(key).agg(F.count(F.lit(1)).alias("links")).where(~F.col("links").between(lo, hi))


def row_parity(gold: DataFrame, base: DataFrame) -> DataFrame:
    """Row counts of a derived table and its base, and whether they agree."""
    c = union_counts({"gold": gold, "base": base}, "side", "n")
    out = c.agg(F.max(F.when(F.col("side") == "gold", F.col("n"))).alias("gold_rows"),
                F.max(F.when(F.col("side") == "base", F.col("n"))).alias("base_rows"))
    return out.withColumn("rows_match", F.col("gold_rows") == F.col("base_rows"))


def flag_split(dfs: dict[str, DataFrame], flag: str = "is_current") -> DataFrame:
    """P5: TRUE / FALSE / total per table after flagging (one UNION ALL job)."""
    parts = [df.agg(F.count_if(F.col(flag)).cast("bigint").alias("n_true"),
                    F.count_if(~F.col(flag)).cast("bigint").alias("n_false"),
                    F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("table_name"), "*")
             for name, df in dfs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
