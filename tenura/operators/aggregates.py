"""Aggregate building blocks.

Counts, conditional counts, min/max and ``max_by`` are hash aggregates with a
map-side partial step, so a hot key costs one partial row per map task.  The
list-building aggregates (A8-A12, A16) produce one value per key that holds
the whole group; where the result is a set, values are de-duplicated first by
a (key, value) aggregate (partial, skew-safe) so each group carries distinct
values only.  Every list is sorted so results are deterministic (``sort_array``: the
collected lists hold no nulls, and ``array_sort`` compares through a lambda).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_rows() -> Column:
    """A1."""
    return F.count(F.lit(1))


def n_where(pred) -> Column:
    """A2: conditional count as BIGINT."""
    return F.count_if(_c(pred)).cast("bigint")


def n_where_sum(pred) -> Column:
    """A2, second spelling: ``SUM(CASE WHEN pred THEN 1 ELSE 0 END)``."""
    return F.sum(F.when(_c(pred), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def n_distinct(col) -> Column:
    """A3."""
    return F.countDistinct(_c(col))


def n_distinct_listed(col) -> Column:
    """A3 beside a list-building aggregate of the same group: ``count(DISTINCT)`` there would build the lists
    per (key, value) first and shuffle them twice."""
    return F.size(F.collect_set(_c(col))).cast("bigint")


def any_true(pred) -> Column:
    """A4: ``MAX(CASE WHEN pred THEN TRUE ELSE FALSE END)``."""
    return F.bool_or(F.coalesce(_c(pred), F.lit(False)))


def latest_by(value, date, tie, default_date: str = "1900-01-01") -> Column:
    """Value of the latest row; NULL dates count as ``default_date``,
    ties go to the larger ``tie``.  Use a struct ``value`` to take several
    attributes from the same row."""
    order = F.struct(F.coalesce(_c(date), F.lit(default_date).cast("date")).alias("d"),
                     _c(tie).alias("t"))
    return F.max_by(_c(value), order)


def latest_by_raw(value, date, tie) -> Column:
    """Like ``latest_by`` but rows with a NULL date never win; a group with
    only NULL dates gives NULL.  ``tie`` makes equal dates deterministic."""
    order = F.when(_c(date).isNotNull(), F.struct(_c(date).alias("d"), _c(tie).alias("t")))
    return F.max_by(_c(value), order)


def latest_key(date, tie, default_date: str | None = "1900-01-01") -> Column:
    """A6/A7 in a hash aggregate: one number that orders by date, then by the BIGINT ``tie``, so
    ``max`` of it finds the latest row without carrying its attributes through the shuffle.  With
    ``default_date`` None a NULL date gives NULL and never wins.  ``key_tie`` gives the tie back."""
    day = _c(date) if default_date is None else F.coalesce(_c(date), F.lit(default_date).cast("date"))
    number = F.unix_date(day).cast("decimal(10,0)") + F.lit(10_000_000).cast("decimal(10,0)")      # year 1 is positive
    return (number * F.lit(str(_TIES)).cast("decimal(20,0)") + _c(tie).cast("decimal(20,0)")
            + F.lit(str(_TIES // 2)).cast("decimal(20,0)")).cast("decimal(38,0)")


def key_tie(key) -> Column:
    """The ``tie`` of a ``latest_key``."""
    return (_c(key) % F.lit(str(_TIES)).cast("decimal(38,0)") - F.lit(str(_TIES // 2)).cast("decimal(38,0)")).cast("bigint")


_TIES = 1 << 64       # as many as there are BIGINTs; the tie has bytes of its own in the number, which compress better


def collect_structs(*fields) -> Column:
    """Sorted array of structs (sorted by the first field, then the rest)."""
    return F.sort_array(F.collect_list(F.struct(*[_c(f) for f in fields])))


def sorted_set(col) -> Column:
    """Sorted distinct non-NULL values."""
    return F.sort_array(F.collect_set(_c(col)))


def concat_summary(col, sep: str = "; ") -> Column:
    """A10: sep-joined non-NULL values, in sorted order (deterministic)."""
    return F.array_join(F.sort_array(F.collect_list(_c(col))), sep)


def list_distinct(col, sep: str = ", ") -> Column:
    """``LISTAGG(DISTINCT x, sep) WITHIN GROUP (ORDER BY x)``; no values -> NULL."""
    s = F.sort_array(F.collect_set(_c(col)))
    return F.when(F.size(s) > 0, F.array_join(s, sep))


def list_ordered(col, order, tie, sep: str = " | ") -> Column:
    """Non-distinct list ordered by ``order`` then ``tie``; no values -> NULL."""
    items = F.sort_array(F.collect_list(
        F.when(_c(col).isNotNull(), F.struct(_c(order).alias("o"), _c(tie).alias("t"), _c(col).alias("v")))))
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda s: s["v"]), sep))


def pivot_eav(df: DataFrame, key: str, attr: str, value: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Attribute rows -> columns, ``MAX(CASE WHEN attr IN names THEN value END)``.

    ``names`` maps an output column to the attribute names it accepts (one
    attribute may have two spellings, which ``DataFrame.pivot`` cannot express).
    One hash aggregate; partial aggregation keeps a hot key cheap.
    """
    return df.groupBy(key).agg(*[
        F.max(F.when(F.col(attr).isin(*accepted), F.col(value))).alias(out)
        for out, accepted in names.items()
    ])


def preview(df: DataFrame, key: str, value, n: int = 8, sep: str = " | ", out: str = "preview") -> DataFrame:
    """First ``n`` of the sorted distinct values, joined by ``sep``.

    Distinct (key, value) first, then ``row_number() <= n`` per key, which
    Spark plans with a partial window-group limit before the shuffle, so a hot
    key ships at most ``n`` rows per map task and the final list is bounded.
    """
    d = df.select(F.col(key), _c(value).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    w = Window.partitionBy(key).orderBy("__v")
    top = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return top.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("__v")), sep).alias(out))


def monthly_activity(df: DataFrame, ts: str, dims: list[str], distinct_of: str,
                     count_name: str = "instrument_count", distinct_name: str = "titles_affected") -> DataFrame:
    """Rows and distinct ``distinct_of`` by month of ``ts`` and ``dims``."""
    return (df.where(F.col(ts).isNotNull())
              .groupBy(F.trunc(F.col(ts), "month").alias("lodged_month"), *dims)
              .agg(F.count(F.lit(1)).alias(count_name),
                   F.countDistinct(distinct_of).alias(distinct_name)))


def bag_text(col, sep: str = " ", distinct: bool = True) -> Column:
    """Concatenated child text (sorted; distinct by default)."""
    coll = F.collect_set(_c(col)) if distinct else F.collect_list(_c(col))
    return F.array_join(F.sort_array(coll), sep)
