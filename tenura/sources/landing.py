"""Landing helpers: bronze string tables, field decoding, provenance, CSV extracts
(S4-S7).  All are narrow Column transformations — no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.plans.conform import numeric_text, to_long
from tenura.sources.csv_extract import read_csv_extract

# Characters Python's str.strip() treats as ASCII whitespace.
_WS = "\t\n\x0b\x0c\r "


def strip(c: Column) -> Column:
    """Strip leading/trailing whitespace (tab, LF, VT, FF, CR, space)."""
    return F.btrim(c, F.lit(_WS))


def clean_value(c: Column) -> Column:
    """C15 (strictest): strip; blank, all-'*' and all-NUL filler -> NULL.

    Plain trims instead of regular expressions: this runs on every landed value.
    A value is filler when trimming its filler character leaves nothing; only a value
    that begins with the character is trimmed.
    """
    s = strip(c.cast("string"))
    filler = (s == "") | _all_of(s, "*") | _all_of(s, "\x00")
    return F.when(filler, F.lit(None).cast("string")).otherwise(s)


def _all_of(s: Column, char: str) -> Column:
    return s.startswith(char) & (F.btrim(s, F.lit(char)) == "")


def land(df: DataFrame) -> DataFrame:
    """Bronze landing — lower-case names, every value a cleaned STRING."""
    return df.select(*[clean_value(F.col(c)).alias(c.lower()) for c in df.columns])


def decode(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Decode fixed-width text fields by field type.

    ``spec`` maps column -> type code: ``C`` text, ``N`` integer number,
    ``F`` floating number (DECIMAL(38,10)), ``D`` yyyyMMdd date, ``L`` logical
    (T/Y/1 true, other non-filler false).  Filler (blank, '*', NUL) -> NULL.
    """
    out = []
    for c in df.columns:
        t = spec.get(c, "C")
        v = clean_value(F.col(c))
        if t == "N":
            e = to_long(v)
        elif t == "F":
            e = F.when(numeric_text(v), v.try_cast("decimal(38,10)"))
        elif t == "D":
            # '00000000' (no date) is common; skip the parse, which would throw per row
            e = (F.when(v == "00000000", F.lit(None).cast("date"))
                  .otherwise(F.try_to_date(v, "yyyyMMdd")))
        elif t == "L":
            e = F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(F.upper(v).isin("T", "Y", "1"))
        else:
            e = v
        out.append(e.alias(c))
    return df.select(*out)


def stamp(df: DataFrame, source_table: str, extract_date: str, run_id: str, batch_id: str | None = None,
          source_file: Column | None = None, ingested_at: Column | None = None) -> DataFrame:
    """Provenance columns.  ``source_file`` defaults to the scan's
    ``_metadata.file_path`` when the frame comes straight from files."""
    if source_file is None:
        source_file = F.col("_metadata.file_path") if _has_metadata(df) else F.lit(None).cast("string")
    return df.withColumns({
        "source_file": source_file,
        "source_table": F.lit(source_table),
        "source_extract_date": F.lit(extract_date).cast("date"),
        "ingested_at": ingested_at if ingested_at is not None else F.current_timestamp(),
        "ingest_batch_id": F.lit(batch_id or run_id),
        "run_id": F.lit(run_id),
    })


def _has_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path").schema
        return True
    except Exception:  # noqa: BLE001 - not a file scan
        return False


def read_extract_csv(spark: SparkSession, path: str, col_map: dict[str, str] | None = None,
                     timestamp_cols: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a CSV extract by header name; see ``csv_extract`` for its rejects."""
    return read_csv_extract(spark, path, col_map, timestamp_cols).rows.drop("source_file")


def write_extract_csv(df: DataFrame, path: str) -> None:
    """Result as CSV with a header (one part file per partition, written in parallel)."""
    df.write.mode("overwrite").option("header", True).csv(path)
