"""Sort, paging and top-k (O1-O3), plus set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sortable search columns (request name -> column of the search table).
SEARCH_SORT_COLUMNS = {
    "title_no": "title_no",
    "issue_date": "issue_date",
    "latest_lodged_date": "latest_instrument_date",
    "instrument_count": "instrument_count",
    "encumbrance_count": "encumbrance_count",
    "updated_at": "refreshed_at",
}


def page_bounds(limit, offset) -> tuple[int, int]:
    """Checked (limit, offset) of a page; anything but whole numbers >= 0 is refused, none is rewritten."""
    bounds = []
    for name, given in (("limit", limit), ("offset", offset)):
        text = str(given).strip()
        if not text.isdecimal():
            raise ValueError(f"{name} must be a whole number of at least 0, not {given!r}")
        bounds.append(int(text))
    return bounds[0], bounds[1]


def sort_column(sort_by: str | None, columns: dict[str, str] = SEARCH_SORT_COLUMNS) -> str:
    """The table's column behind a request's sort name."""
    name = (sort_by or "").strip().lower() or "issue_date"
    if name not in columns:
        raise ValueError(f"sort_by must be one of {', '.join(columns)}, not {sort_by!r}")
    return columns[name]


def search_order(sort_by: str = "issue_date", sort_dir: str = "desc", key: str = "title_no",
                 columns: dict[str, str] = SEARCH_SORT_COLUMNS) -> list[Column]:
    """O1: current first, then the named column (NULLs last), then key ascending.

    No name means the issue date, no direction descending; other names and directions are refused."""
    c = F.col(sort_column(sort_by, columns))
    way = (sort_dir or "").strip().upper() or "DESC"
    if way not in ("ASC", "DESC"):
        raise ValueError(f"sort_dir must be asc or desc, not {sort_dir!r}")
    second = c.asc_nulls_last() if way == "ASC" else c.desc_nulls_last()
    return [F.col("is_current").desc_nulls_last(), second, F.col(key).asc()]


def sort_rows(df: DataFrame, sort_by: str = "issue_date", sort_dir: str = "desc", key: str = "title_no") -> DataFrame:
    """O1: total order for the search table."""
    return df.orderBy(*search_order(sort_by, sort_dir, key))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """O2: ordered page.  ``orderBy().offset().limit()`` plans as a single
    TakeOrderedAndProject: each task keeps only ``offset + limit`` rows."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def top_k(df: DataFrame, col: str, k: int, key: str) -> DataFrame:
    """O3: top ``k`` rows by ``col`` descending, key ascending as tie-break."""
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(key).asc()).limit(k)


def union_counts(counts: dict[str, DataFrame], label: str = "view_name", value: str = "row_count") -> DataFrame:
    """Labelled row counts of several DataFrames as one job (UNION ALL of
    global aggregates; each branch is a partial + final count)."""
    parts = [df.agg(F.count(F.lit(1)).alias(value)).select(F.lit(name).alias(label), value)
             for name, df in counts.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """SELECT DISTINCT projection (partial distinct before the shuffle)."""
    return df.select(*cols).distinct()
