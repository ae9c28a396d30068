"""Filters and predicates.

All are Column expressions, so Catalyst pushes them into the parquet scan
where the referenced columns come straight from the file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura.functions.text import OPEN_END_VALUES

CURRENT_CODES = ("LIVE", "REGD")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def current_flag(status, codes=CURRENT_CODES) -> Column:
    """TRUE when status is one of ``codes``; NULL status -> FALSE."""
    return F.when(_c(status).isin(*codes), F.lit(True)).otherwise(F.lit(False))


def in_codes(col, codes) -> Column:
    """F1."""
    return _c(col).isin(*codes)


def still_open(end_col) -> Column:
    """open validity interval (NULL or one of the 'no end' spellings)."""
    c = _c(end_col)
    return c.isNull() | c.isin(*OPEN_END_VALUES)


def not_code(col, code) -> Column:
    """``col <> code``; NULL stays unknown, so NULL rows are dropped (SQL logic)."""
    return _c(col) != F.lit(code)


def both_current(left, right) -> Column:
    """F4."""
    return (_c(left) == F.lit(True)) & (_c(right) == F.lit(True))


def both_present(a, b) -> Column:
    """F5."""
    return _c(a).isNotNull() & _c(b).isNotNull()


def blank_safe_eq(a, b) -> Column:
    """NULL and '' are one value on both sides."""
    return F.nullif(_c(a), F.lit("")).eqNullSafe(F.nullif(_c(b), F.lit("")))
