"""Registry code list (code_group, code, description).

The seed is a small, bounded lookup table (a few dozen rows), so joining it to
any fact table is a broadcast of a proven size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The registry's seeded system codes, as (code_group, code, description).
# Groups: TTLS title status, TTLT title type, TTLR register type, TTLG guarantee
# status, ETTT estate type, TSDS general record status.
SYSTEM_CODES = [
    ("TTLS", "LIVE", "Live"),
    ("TTLS", "HIST", "Historical"),
    ("TTLS", "CANC", "Cancelled"),
    ("TTLS", "REGD", "Registered"),
    ("TTLT", "FHOL", "Freehold"),
    ("TTLT", "LEHI", "Leasehold Interest"),
    ("TTLT", "LHLH", "Leasehold"),
    ("TTLT", "UNIT", "Unit Title"),
    ("TTLT", "MORI", "Māori Land"),
    ("TTLT", "MOTR", "Miscellaneous Owners"),
    ("TTLT", "F", "Fee Simple"),
    ("TTLT", "LH", "Leasehold"),
    ("TTLT", "SRS", "Unit Title (SRS)"),
    ("TTLT", "ML", "Māori Land"),
    ("TTLT", "MOT", "Miscellaneous Owners"),
    ("TTLR", "FREE", "Freehold Register"),
    ("TTLR", "LEAS", "Lease Register"),
    ("TTLR", "UNIT", "Unit Register"),
    ("TTLR", "CF", "Computer Freehold Register"),
    ("TTLR", "CI", "Computer Interest Register"),
    ("TTLG", "GURT", "Guaranteed"),
    ("TTLG", "PROV", "Provisional"),
    ("TTLG", "LIMI", "Limited as to Parcels"),
    ("TTLG", "NONE", "Not Guaranteed"),
    ("TTLG", "SATF", "Satisfied"),
    ("ETTT", "FSIM", "Fee Simple"),
    ("ETTT", "LIFE", "Life Estate"),
    ("ETTT", "LEAS", "Leasehold"),
    ("ETTT", "UNIT", "Unit Title"),
    ("ETTT", "RCLS", "Remainder / Contingent Life Estate"),
    ("ETTT", "STRM", "Stratum Estate"),
    ("ETTT", "TIMR", "Timeshare"),
    ("ETTT", "PRTL", "Partial"),
    ("TSDS", "LIVE", "Live"),
    ("TSDS", "HIST", "Historical"),
    ("TSDS", "CANC", "Cancelled"),
    ("TSDS", "REGD", "Registered"),
]

SYSTEM_CODE_SCHEMA = T.StructType([
    T.StructField("code_group", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])


def system_code_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEM_CODES, SYSTEM_CODE_SCHEMA)


def system_code_sql_values() -> str:
    """The seed as a SQL VALUES list (for oracle queries)."""
    rows = ", ".join("('%s', '%s', '%s')" % r for r in SYSTEM_CODES)
    return f"SELECT * FROM (VALUES {rows}) AS v(code_group, code, description)"
