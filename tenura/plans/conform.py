"""Conforming bronze -> silver.

A silver spec is data: a list of ``(target, source, kind)`` entries.  ``conform``
turns it into one ``select`` of Column expressions — rename, lenient cast,
blank -> NULL and the current flag — so a table of any size is conformed in a
single narrow (shuffle-free) stage.  Casts are ``try_cast``-style, so dirty
strings become NULL instead of failing the job under ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators.filters import CURRENT_CODES, current_flag

# Silver specs (target column, bronze column, kind).  Kinds:
# str = string, nstr = string with blank -> NULL, long = BIGINT, date = DATE,
# ts = TIMESTAMP, dec = DECIMAL(20,4), flag = current flag from the status column.
SILVER_SPECS: dict[str, list[tuple[str, str, str]]] = {
    "title": [
        ("title_no", "title_no", "str"), ("ldt_loc_id", "ldt_loc_id", "long"),
        ("register_type", "register_t", "str"), ("ste_id", "ste_id", "long"),
        ("issue_date", "issue_date", "date"), ("guarantee_status", "guarantee_", "str"),
        ("status", "status", "str"), ("type", "type", "str"), ("provisional", "provisiona", "str"),
        ("sur_wrk_id", "sur_wrk_id", "long"), ("ttl_title_no_srs", "ttl_title_", "nstr"),
        ("ttl_title_no_head_srs", "ttl_titl_1", "nstr"), ("maori_land", "maori_land", "nstr"),
        ("audit_id", "audit_id", "long"), ("is_current", "status", "flag"),
    ],
    "title_estate": [
        ("id", "id", "long"), ("ttl_title_no", "ttl_title_", "str"), ("type", "type", "str"),
        ("status", "status", "str"), ("lgd_id", "lgd_id", "long"), ("share", "share", "nstr"),
        ("timeshare_week_no", "timeshare_", "nstr"), ("purpose", "purpose", "nstr"),
        ("act_tin_id_crt", "act_tin_id", "long"), ("act_id_crt", "act_id_crt", "long"),
        ("original_flag", "original_f", "nstr"), ("term", "term", "nstr"), ("tin_id_orig", "tin_id_ori", "long"),
        ("is_current", "status", "flag"),
    ],
    "title_instrument": [
        ("id", "id", "long"), ("inst_no", "inst_no", "str"), ("trt_grp", "trt_grp", "str"),
        ("trt_type", "trt_type", "str"), ("ldt_loc_id", "ldt_loc_id", "long"), ("status", "status", "str"),
        ("lodged_date", "lodged_dat", "date"), ("dlg_id", "dlg_id", "long"),
        ("priority_no", "priority_n", "long"), ("tin_id_parent", "tin_id_par", "long"),
        ("audit_id", "audit_id", "long"), ("is_current", "status", "flag"),
    ],
    "title_instrument_title": [
        ("tin_id", "tin_id", "long"), ("ttl_title_no", "ttl_title_", "str"), ("audit_id", "audit_id", "long"),
    ],
    "title_hierarchy": [
        ("id", "id", "long"), ("status", "status", "str"), ("ttl_title_no_prior", "ttl_title_", "nstr"),
        ("ttl_title_no_flw", "ttl_titl_1", "nstr"), ("tdr_id", "tdr_id", "long"),
        ("act_tin_id_crt", "act_tin_id", "long"), ("act_id_crt", "act_id_crt", "long"),
        ("is_current", "status", "flag"),
    ],
    "encumbrance": [
        ("id", "id", "long"), ("status", "status", "str"), ("act_tin_id_crt", "act_tin_id", "long"),
        ("act_tin_id_orig", "act_tin__1", "long"), ("act_id_crt", "act_id_crt", "long"),
        ("act_id_orig", "act_id_ori", "long"), ("term", "term", "nstr"), ("is_current", "status", "flag"),
    ],
    "title_encumbrance": [
        ("id", "id", "long"), ("ttl_title_no", "ttl_title_", "str"), ("enc_id", "enc_id", "long"),
        ("status", "status", "str"), ("act_tin_id_crt", "act_tin_id", "long"), ("act_id_crt", "act_id_crt", "long"),
        ("is_current", "status", "flag"),
    ],
    "encumbrance_share": [
        ("id", "id", "long"), ("enc_id", "enc_id", "long"), ("status", "status", "str"),
        ("act_tin_id_crt", "act_tin_id", "long"), ("act_id_crt", "act_id_crt", "long"),
        ("act_id_ext", "act_id_ext", "long"), ("act_tin_id_ext", "act_tin__1", "long"),
        ("system_created", "system_crt", "nstr"), ("system_extinguished", "system_ext", "nstr"),
        ("is_current", "status", "flag"),
    ],
    "title_document_reference": [
        ("id", "id", "long"), ("type", "type", "str"), ("tin_id", "tin_id", "long"),
        ("reference", "reference_", "nstr"),
    ],
    "transaction_type": [
        ("grp", "grp", "str"), ("type", "type", "str"), ("description", "descriptio", "nstr"),
        ("audit_id", "audit_id", "long"),
    ],
    "title_parcel_association": [
        ("id", "id", "long"), ("ttl_title_no", "ttl_title_", "str"), ("par_id", "par_id", "long"),
        ("source", "source", "nstr"),
    ],
    "legal_description": [
        ("id", "id", "long"), ("type", "type", "str"), ("status", "status", "str"),
        ("total_area", "total_area", "dec"), ("ttl_title_no", "ttl_title_", "nstr"),
        ("legal_desc_text", "legal_desc", "nstr"), ("audit_id", "audit_id", "long"),
        ("is_current", "status", "flag"),
    ],
    "legal_description_parcel": [
        ("lgd_id", "lgd_id", "long"), ("par_id", "par_id", "long"), ("sequence", "sequence", "long"),
        ("part_affected", "part_affec", "nstr"), ("share", "share", "nstr"), ("audit_id", "audit_id", "long"),
        ("sur_wrk_id", "sur_wrk_id", "long"),
    ],
    "appellation": [
        ("id", "id", "long"), ("par_id", "par_id", "long"), ("type", "type", "str"), ("title_flag", "title", "str"),
        ("survey_flag", "survey", "str"), ("status", "status", "str"), ("part_indicator", "part_indic", "str"),
        ("maori_name", "maori_name", "nstr"), ("sub_type", "sub_type", "str"),
        ("appellation_value", "appellatio", "nstr"), ("parcel_type", "parcel_typ", "str"),
        ("parcel_value", "parcel_val", "nstr"), ("second_parcel_type", "second_par", "str"),
        ("second_prcl_value", "second_prc", "nstr"), ("block_number", "block_numb", "nstr"),
        ("sub_type_position", "sub_type_p", "str"), ("other_appellation", "other_appe", "nstr"),
        ("act_id_crt", "act_id_crt", "long"), ("act_tin_id_crt", "act_tin_id", "long"),
        ("act_id_ext", "act_id_ext", "long"), ("act_tin_id_ext", "act_tin__1", "long"),
        ("audit_id", "audit_id", "long"), ("height_limited", "height_lim", "str"), ("is_current", "status", "flag"),
    ],
    "statute": [
        ("id", "id", "long"), ("section", "section", "nstr"), ("name_and_description", "name_and_d", "nstr"),
        ("still_in_force", "still_in_f", "str"), ("in_force_date", "in_force_d", "date"),
        ("repeal_date", "repeal_dat", "date"), ("type", "type", "str"), ("default_flag", "default", "str"),
        ("audit_id", "audit_id", "long"),
    ],
    "statute_action": [
        ("id", "id", "long"), ("type", "type", "str"), ("status", "status", "str"), ("ste_id", "ste_id", "long"),
        ("sur_wrk_id", "sur_wrk_id", "long"), ("gazette_year", "gazette_ye", "long"),
        ("gazette_page", "gazette_pa", "long"), ("gazette_type", "gazette_ty", "str"),
        ("other_legal_description", "other_lega", "nstr"), ("recorded_date", "recorded_d", "date"),
        ("gazette_number", "gazette_no", "nstr"), ("audit_id", "audit_id", "long"), ("is_current", "status", "flag"),
    ],
    "statutory_action_parcel": [
        ("sta_id", "sta_id", "long"), ("par_id", "par_id", "long"), ("status", "status", "str"),
        ("action", "action", "str"), ("purpose", "purpose", "nstr"), ("name", "name", "nstr"),
        ("comments", "comments", "nstr"), ("audit_id", "audit_id", "long"), ("img_id", "img_id", "long"),
        ("description", "descriptio", "nstr"), ("is_current", "status", "flag"),
    ],
    # address register extracts
    "address_point": [
        ("address_id", "address_id", "long"), ("change_id", "change_id", "long"),
        ("primary_address", "primary_ad", "str"), ("address_lifecycle_stage", "address_li", "str"),
        ("status", "address_li", "str"),
        ("address_position_type", "address_pr", "str"), ("alternative_address_type", "address_ma", "str"),
        ("addressable_object_id", "addressabl", "long"), ("address_class", "address_cl", "str"),
        ("parcel_id", "parcel_id", "long"),
    ],
    "address_component": [
        ("address_component_id", "address_co", "long"), ("address_id", "address_id", "long"),
        ("component_type", "address__1", "str"), ("component_value", "address__2", "nstr"),
        ("sequence", "address__3", "long"), ("language_code", "address__4", "str"),
        ("begin_lifecycle", "begin_life", "str"), ("end_lifecycle", "end_lifesp", "str"),      # text: an open end is spelled in several ways
    ],
    "address_component_type": [
        ("component_type", "address_co", "str"), ("description", "address__1", "nstr"),
        ("active_flag", "address__2", "str"), ("notes", "address__3", "nstr"),
    ],
    "address_reference": [
        ("address_reference_id", "address_re", "long"), ("address_id", "address_id", "long"),
        ("reference_object_type", "address__1", "str"), ("reference_value", "address__2", "nstr"),
    ],
    "address_reference_object_type": [
        ("reference_object_type", "address_re", "str"), ("description", "address__1", "nstr"),
    ],
    "address_class": [("address_class", "address_cl", "str"), ("description", "address__1", "nstr")],
    "address_lifecycle_stage": [
        ("address_lifecycle_stage", "address_li", "str"), ("description", "address__1", "nstr"),
    ],
    "address_position_type": [
        ("address_position_type", "address_po", "str"), ("description", "address__1", "nstr"),
    ],
    "addressable_object": [
        ("addressable_object_id", "addressabl", "long"), ("object_type", "addressa_1", "str"),
        ("lifecycle_stage", "addressa_2", "str"), ("organisation_id", "organisati", "long"),
    ],
    "addressable_object_external": [
        ("addressable_object_id", "addressabl", "long"), ("object_type", "addressa_1", "str"),
        ("lifecycle_stage", "addressa_2", "str"), ("external_id", "external_i", "nstr"),
        ("external_system", "external_1", "nstr"),
    ],
    "addressable_object_lifecycle_stage": [
        ("lifecycle_stage", "addressabl", "str"), ("description", "addressa_1", "nstr"),
    ],
    "addressable_object_type": [("object_type", "addressabl", "str"), ("description", "addressa_1", "nstr")],
    "alternative_address_type": [
        ("alternative_address_type", "alternativ", "str"), ("description", "alternat_1", "nstr"),
    ],
    "address_organisation": [
        ("organisation_id", "organisati", "long"), ("organisation_name", "organisa_1", "nstr"),
        ("address_id", "address_id", "long"), ("addressable_object_id", "addressabl", "long"),
    ],
    # CSV extracts: header names are the target names; types as in the target DDL
    # (geometry columns are not carried)
    "estate_share": [
        ("id", "id", "long"), ("ett_id", "ett_id", "long"), ("status", "status", "str"), ("share", "share", "nstr"),
        ("act_tin_id_crt", "act_tin_id_crt", "long"), ("original_flag", "original_flag", "str"),
        ("system_crt", "system_crt", "str"), ("executorship", "executorship", "nstr"),
        ("act_id_crt", "act_id_crt", "long"), ("share_memorial", "share_memorial", "nstr"),
        ("is_current", "status", "flag"),
    ],
    "proprietor": [
        ("id", "id", "long"), ("ets_id", "ets_id", "long"), ("status", "status", "str"), ("type", "type", "str"),
        ("prime_surname", "prime_surname", "nstr"), ("prime_other_names", "prime_other_names", "nstr"),
        ("name_suffix", "name_suffix", "nstr"), ("original_flag", "original_flag", "str"),
    ],
    "encumbrancee": [
        ("id", "id", "long"), ("ens_id", "ens_id", "long"), ("status", "status", "str"), ("name", "name", "nstr"),
    ],
    "parcel": [
        ("id", "id", "long"), ("ldt_loc_id", "ldt_loc_id", "long"), ("img_id", "img_id", "long"),
        ("fen_id", "fen_id", "long"), ("toc_code", "toc_code", "str"), ("alt_id", "alt_id", "long"),
        ("area", "area", "dec"), ("nonsurvey_def", "nonsurvey_def", "nstr"),
        ("appellation_date", "appellation_date", "ts"), ("parcel_intent", "parcel_intent", "str"),
        ("status", "status", "str"), ("total_area", "total_area", "dec"),
        ("calculated_area", "calculated_area", "dec"), ("se_row_id", "se_row_id", "long"),
        ("audit_id", "audit_id", "long"),
    ],
    "land_district": [
        ("ldt_loc_id", "ldt_loc_id", "long"), ("off_code", "off_code", "str"), ("name", "name", "nstr"),
        ("abbrev", "abbrev", "str"), ("status", "status", "str"), ("default_ind", "default_ind", "str"),
        ("usr_tm_id", "usr_tm_id", "str"), ("audit_id", "audit_id", "long"),
    ],
}


def to_long(c: Column) -> Column:
    """Lenient BIGINT: '12' and '12.0' -> 12, junk -> NULL (through DECIMAL,
    since a direct cast of '12.0' to BIGINT gives NULL)."""
    s = F.trim(c.cast("string"))
    return (F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
             .when(numeric_text(s), s.try_cast("decimal(38,10)").try_cast("bigint")))


# Text that a numeric cast can accept: sign, digits with an optional point,
# optional exponent.  Other text gives NULL without attempting the cast, whose
# decimal path would throw (and catch) a JVM exception for every such row.
_NUMERIC = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def numeric_text(s: Column) -> Column:
    return s.rlike(_NUMERIC)


def to_decimal(c: Column, precision: int = 20, scale: int = 4) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(numeric_text(s), s.try_cast(f"decimal({precision},{scale})"))


def to_date_lenient(c: Column) -> Column:
    """ISO or yyyyMMdd text -> DATE; '00000000', blanks and junk -> NULL."""
    s = F.trim(c.cast("string"))
    iso, compact = F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "yyyyMMdd")
    # A failed parse costs a JVM exception per row, so each format is tried only
    # on text of its own shape; any other shape takes both, as before.
    return (F.when(s == "00000000", F.lit(None).cast("date"))
             .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso)
             .when(s.rlike(r"^[0-9]{8}$"), compact)
             .otherwise(F.coalesce(iso, compact)))


def blank_to_null(c: Column) -> Column:
    """``NULLIF(CAST(x AS STRING), '')``."""
    return F.nullif(c.cast("string"), F.lit(""))


def _expr(df: DataFrame, source: str, kind: str, codes) -> Column:
    if source not in df.columns:
        typ = {"long": "bigint", "date": "date", "ts": "timestamp", "dec": "decimal(20,4)",
               "flag": "boolean"}.get(kind, "string")
        return F.lit(False) if kind == "flag" else F.lit(None).cast(typ)
    c = F.col(source)
    if kind == "str":
        return c.cast("string")
    if kind == "nstr":
        return blank_to_null(c)
    if kind == "long":
        return to_long(c)
    if kind == "date":
        return to_date_lenient(c)
    if kind == "ts":
        # without a format this is the cast parser: NULL for bad text, no exception
        return F.try_to_timestamp(F.trim(c.cast("string")))
    if kind == "dec":
        return to_decimal(c)
    if kind == "flag":
        return current_flag(c, codes)
    raise ValueError(f"unknown kind {kind}")


def conform(df: DataFrame, spec, codes=CURRENT_CODES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One select that renames, casts, blanks -> NULL and flags, per spec;
    ``keep`` columns (e.g. provenance) are carried through unchanged."""
    spec = SILVER_SPECS[spec] if isinstance(spec, str) else spec
    return df.select(*[_expr(df, src, kind, codes).alias(tgt) for tgt, src, kind in spec], *keep)


def reflag(df: DataFrame, codes, status: str = "status", flag: str = "is_current") -> DataFrame:
    """Rewrite the current flag with another code list (e.g. title = LIVE only)."""
    return df.withColumn(flag, current_flag(status, codes))


# Provenance columns stamped at landing (excluded from dedupe).
PROVENANCE = ("source_file", "source_table", "source_extract_date", "ingested_at", "ingest_batch_id", "run_id")


def dedupe(df: DataFrame, exclude=PROVENANCE) -> DataFrame:
    """Drop duplicate rows by business columns (provenance excluded).
    A hash aggregate with a map-side partial step, so copies landed in many
    chunks or shards collapse before the shuffle."""
    keys = [c for c in df.columns if c not in exclude]
    return df.dropDuplicates(keys)


def align(df: DataFrame, target_cols: list[tuple[str, str]], renames: dict[str, str] | None = None) -> DataFrame:
    """Rename old columns, add missing ones as typed NULLs, drop extras, in target order."""
    out = df.withColumnsRenamed(renames or {})
    return out.select(*[(F.col(c).cast(t) if c in out.columns else F.lit(None).cast(t)).alias(c)
                        for c, t in target_cols])


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """Union frames with different column sets (missing columns -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_codes(target: DataFrame, seed: DataFrame, keys=("code_group", "code"),
                 desc: str = "description") -> DataFrame:
    """MERGE as a full outer join: seed rows missing from the target are
    inserted; a target row keeps its description unless that is NULL."""
    t = target.select(*keys, F.col(desc).alias("__t"))
    s = seed.select(*keys, F.col(desc).alias("__s"))
    j = t.join(s, list(keys), "full")
    return j.select(*keys, F.coalesce("__t", "__s").alias(desc))


def code_group_counts(codes: DataFrame) -> DataFrame:
    """P10: codes per group."""
    return codes.groupBy("code_group").agg(F.count(F.lit(1)).alias("code_count"))
