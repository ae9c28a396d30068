"""Gold products (G1-G22): dimension, fact, bridge, 360, search and report tables.

Design for scale:
* every one-to-many child table is aggregated to one row per title *before* it
  meets the title table (J10), so no branch multiplies another and the joins
  are key-to-key;
* all branches are grouped on the title key, so the shuffle that groups a branch
  also satisfies the following sort-merge join (no extra exchange per join),
  and AQE turns the small ones into broadcast joins from measured sizes;
* only bounded lookups (the code list) carry an explicit broadcast hint.

Tables are passed as an object with one attribute per silver table (see
``tenura.sources.adapters.RegistryTables``); optional source columns that a
given extract lacks are read as typed NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.text import code_label, fold_text, join_parts, party_name, street_no, type_code
from tenura.operators import aggregates as A
from tenura.operators.filters import CURRENT_CODES, current_flag, in_codes, not_code, still_open
from tenura.operators.joins import label_codes, settled, star_left
from tenura.operators.windows import latest_row

# Title code columns and the code group that labels each.
TITLE_CODE_GROUPS = {
    "title_status": "TTLS",
    "title_type": "TTLT",
    "register_type": "TTLR",
    "guarantee_status": "TTLG",
}

# Address component names -> pivoted column.
ADDRESS_COMPONENTS = {
    "unit_type": ("Unit Type",),
    "unit_value": ("Unit Value",),
    "street_number": ("Address Number",),
    "street_number_high": ("Address Number High",),
    "street_number_suffix": ("Address Number Suffix",),
    "road_name": ("Road Name",),
    "road_type": ("Road Type Name",),
    "road_suffix": ("Road Suffix", "Road Suffix Name"),
    "suburb": ("Suburb/Locality Name",),
    "city": ("Town/City Name",),
    "postcode": ("Postcode",),
}


def opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """Column ``name`` of ``df`` when the extract has it, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


# ---------------------------------------------------------------------------
# G1-G3 dimensions and bridge
# ---------------------------------------------------------------------------
def dim_title(title: DataFrame, land_district: DataFrame, active_codes=CURRENT_CODES) -> DataFrame:
    """G1: title + land district + active flag."""
    ld = land_district.select(F.col("ldt_loc_id").alias("__ld"), F.col("name").alias("land_district_name"),
                              F.col("abbrev").alias("land_district_abbrev"))
    t = title
    return t.join(ld, t["ldt_loc_id"] == ld["__ld"], "left").select(
        "title_no", "ldt_loc_id", "land_district_name", "land_district_abbrev",
        F.col("status").alias("title_status"), F.col("type").alias("title_type"),
        "register_type", "issue_date", "guarantee_status",
        opt(t, "provisional"), opt(t, "maori_land"), opt(t, "ste_id", "bigint"), opt(t, "sur_wrk_id", "bigint"),
        "is_current",
        current_flag("status", active_codes).alias("is_active"),
        opt(t, "ttl_title_no_srs"), opt(t, "ttl_title_no_head_srs"),
    )


def dim_appellation(a: DataFrame) -> DataFrame:
    """Appellation projection with renamed columns."""
    return a.select(
        F.col("id").alias("appellation_id"), "par_id", "appellation_value",
        opt(a, "type").alias("appellation_type"), "status", "title_flag",
        opt(a, "survey_flag"), opt(a, "part_indicator"), "parcel_type", "parcel_value",
        opt(a, "second_parcel_type"), opt(a, "second_prcl_value"), "block_number",
        opt(a, "sub_type"), opt(a, "sub_type_position"), opt(a, "maori_name"),
        opt(a, "height_limited"), opt(a, "other_appellation"),
    )


def bridge_title_parcel(tpa: DataFrame) -> DataFrame:
    """Title <-> parcel links."""
    return tpa.select(F.col("ttl_title_no").alias("title_no"), F.col("par_id").alias("parcel_id"), "id", "source")


# ---------------------------------------------------------------------------
# G4-G9 facts and navigation views
# ---------------------------------------------------------------------------
def fact_title_estate(te: DataFrame, es: DataFrame, p: DataFrame) -> DataFrame:
    """Estate -> share -> proprietor (left, left; fan-out intended).  Shares meet their proprietors first
    (the same rows, as a proprietor hangs on its share), so the estates, the widest, are shuffled once."""
    es2 = es.select(F.col("id").alias("estate_share_id"), F.col("ett_id").alias("__ett"),
                    F.col("share").alias("share_fraction"), F.col("is_current").alias("share_is_current"),
                    opt(es, "executorship"), opt(es, "share_memorial"))
    p2 = p.select(F.col("id").alias("proprietor_id"), F.col("ets_id").alias("__ets"),
                  F.col("type").alias("proprietor_type"), "prime_surname", "prime_other_names",
                  "name_suffix", F.col("status").alias("proprietor_status"))
    held = es2.join(p2, F.col("estate_share_id") == p2["__ets"], "left").drop("__ets")
    j = te.join(held, te["id"] == held["__ett"], "left")
    return j.select(
        F.col("id").alias("title_estate_id"), F.col("ttl_title_no").alias("title_no"),
        F.col("type").alias("estate_type"), F.col("status").alias("estate_status"),
        F.col("share").alias("estate_share_fraction"), opt(te, "purpose"), opt(te, "timeshare_week_no"),
        opt(te, "term"), opt(te, "original_flag"), opt(te, "lgd_id", "bigint"), "is_current",
        "estate_share_id", "share_fraction", "executorship", "share_memorial", "share_is_current",
        "proprietor_id", "proprietor_type", "prime_surname", "prime_other_names", "name_suffix",
        "proprietor_status",
        party_name("proprietor_type", "prime_other_names", "prime_surname", "name_suffix").alias("proprietor_name"),
    )


def instrument_detail(tit: DataFrame, ti: DataFrame, tt: DataFrame) -> DataFrame:
    """Link x instrument x transaction type, one row per (title, instrument)."""
    ti2 = ti.select(F.col("id").alias("tin_id"), "inst_no", "trt_grp", "trt_type",
                    F.col("status").alias("instrument_status"), "lodged_date", "priority_no",
                    opt(ti, "tin_id_parent", "bigint"), opt(ti, "dlg_id", "bigint"), opt(ti, "ldt_loc_id", "bigint"),
                    F.col("is_current").alias("instrument_is_current"))
    tt2 = tt.select(F.col("grp").alias("__grp"), F.col("type").alias("__type"),
                    F.col("description").alias("transaction_type_desc"))
    j = tit.select(F.col("ttl_title_no").alias("title_no"), F.col("tin_id").alias("__tin")) \
           .join(ti2, F.col("__tin") == F.col("tin_id"), "inner") \
           .join(tt2, (F.col("trt_grp") == F.col("__grp")) & (F.col("trt_type") == F.col("__type")), "left")
    return j.drop("__tin", "__grp", "__type")


def fact_title_instrument(tit: DataFrame, ti: DataFrame, tt: DataFrame) -> DataFrame:
    """Instruments per title with transaction-type label."""
    d = instrument_detail(tit, ti, tt)
    return d.select(
        "title_no", "tin_id", "inst_no", "trt_grp", "trt_type", "transaction_type_desc",
        type_code("trt_grp", "trt_type").alias("instrument_code"), "priority_no",
        "instrument_status", "lodged_date", "tin_id_parent", "dlg_id", "ldt_loc_id",
        F.col("instrument_is_current").alias("is_current"),
    )


def fact_title_encumbrance(te: DataFrame, e: DataFrame, enc: DataFrame, es: DataFrame,
                           via_share: bool = False, share_status: str = "REGD") -> DataFrame:
    """Encumbrance with holder and registered share.

    ``via_share=False`` joins the holder on ``encumbrancee.ens_id = encumbrance.id``
    as the gold view does; ``True`` uses the documented key (the share id).
    """
    e2 = e.select(F.col("id").alias("__eid"), F.col("status").alias("encumbrance_status"),
                  F.col("term").alias("encumbrance_term"))
    es2 = (es.where(F.col("status") == share_status)
             .select(F.col("id").alias("__esid"), F.col("enc_id").alias("__es_enc"),
                     F.col("status").alias("encumbrance_share_status")))
    enc2 = enc.select(F.col("ens_id").alias("__ens"), F.col("name").alias("encumbrancee_name"),
                      F.col("status").alias("encumbrancee_status"))
    j = te.join(e2, te["enc_id"] == e2["__eid"], "left")
    if via_share:
        j = j.join(es2, F.col("__eid") == F.col("__es_enc"), "left") \
             .join(enc2, F.col("__esid") == F.col("__ens"), "left")
    else:
        j = j.join(enc2, F.col("__ens") == F.col("__eid"), "left") \
             .join(es2, F.col("__es_enc") == F.col("__eid"), "left")
    return j.select(
        F.col("ttl_title_no").alias("title_no"), F.col("id").alias("title_encumbrance_id"), "enc_id",
        F.col("status").alias("title_encumbrance_status"), "encumbrance_status", "encumbrance_term",
        "encumbrancee_name", "encumbrancee_status", "encumbrance_share_status", "is_current",
    )


def title_lineage(h: DataFrame, t: DataFrame) -> DataFrame:
    """Hierarchy edge with both titles' attributes (same dimension twice, J7)."""
    tp = t.select(F.col("title_no").alias("__p"), F.col("status").alias("prior_title_status"),
                  F.col("type").alias("prior_title_type"), F.col("issue_date").alias("prior_issue_date"))
    tf = t.select(F.col("title_no").alias("__f"), F.col("status").alias("following_title_status"),
                  F.col("type").alias("following_title_type"), F.col("issue_date").alias("following_issue_date"))
    j = (h.join(tp, h["ttl_title_no_prior"] == tp["__p"], "left")
          .join(tf, h["ttl_title_no_flw"] == tf["__f"], "left"))
    return j.select(
        "id", "status", F.col("ttl_title_no_prior").alias("prior_title_no"),
        "prior_title_status", "prior_title_type", "prior_issue_date",
        F.col("ttl_title_no_flw").alias("following_title_no"),
        "following_title_status", "following_title_type", "following_issue_date",
        opt(h, "tdr_id", "bigint"),
    )


def title_appellation(tpa: DataFrame, a: DataFrame, title_flag: str = "Y") -> DataFrame:
    """Appellations of a title through its parcels (inner join + flag in ON)."""
    a2 = a.where(F.col("title_flag") == title_flag).select(
        F.col("par_id").alias("__par"), F.col("id").alias("appellation_id"), "appellation_value",
        opt(a, "type").alias("appellation_type"), F.col("status").alias("appellation_status"), "title_flag",
        opt(a, "part_indicator"), "parcel_type", "parcel_value", opt(a, "second_parcel_type"),
        opt(a, "second_prcl_value"), "block_number", opt(a, "sub_type"), opt(a, "maori_name"),
        opt(a, "height_limited"), opt(a, "other_appellation"))
    j = tpa.join(a2, tpa["par_id"] == a2["__par"], "inner")
    return j.select(F.col("ttl_title_no").alias("title_no"), "par_id", *[c for c in a2.columns if c != "__par"])


def title_legal(ld: DataFrame, ldp: DataFrame) -> DataFrame:
    """Legal descriptions with their parcels (left join)."""
    p = ldp.select(F.col("lgd_id").alias("__lgd"), "par_id", F.col("sequence").alias("parcel_sequence"),
                   opt(ldp, "part_affected"), opt(ldp, "share").alias("parcel_share"), opt(ldp, "sur_wrk_id", "bigint"))
    j = ld.join(p, ld["id"] == p["__lgd"], "left")
    return j.select(F.col("ttl_title_no").alias("title_no"), F.col("id").alias("legal_desc_id"),
                    F.col("type").alias("legal_desc_type"), F.col("status").alias("legal_desc_status"),
                    "total_area", "legal_desc_text", "par_id", "parcel_sequence", "part_affected", "parcel_share",
                    "sur_wrk_id")


# ---------------------------------------------------------------------------
# G10-G11 addresses
# ---------------------------------------------------------------------------
def address_parts(comp: DataFrame) -> DataFrame:
    """A13 over current components: one row per address with the named parts."""
    cur = comp.where(still_open("end_lifecycle"))
    return A.pivot_eav(cur, "address_id", "component_type", "component_value", ADDRESS_COMPONENTS)


def dim_address(a: DataFrame, comp: DataFrame, tpa: DataFrame, status: str = "Current") -> DataFrame:
    """G10 (C8): pivot current components, build street/full address, link titles."""
    b = address_parts(comp)
    unit = F.when(F.col("unit_type").isNotNull(),
                  F.concat(F.col("unit_type"), F.lit(" "), F.coalesce(F.col("unit_value"), F.lit(""))))
    number = street_no("street_number", "street_number_high", "street_number_suffix")
    b = b.withColumn("street_address", join_parts(" ", unit, number, "road_name", "road_type", "road_suffix"))
    b = b.withColumn("full_address", join_parts(", ", "street_address", "suburb", "city", "postcode"))
    aa = a.where(F.col("status") == status)
    t = tpa.select(F.col("par_id").alias("__par"), F.col("ttl_title_no").alias("title_no"))
    j = (aa.join(b.withColumnRenamed("address_id", "__aid"), aa["address_id"] == F.col("__aid"), "inner")
           .join(t, aa["parcel_id"] == t["__par"], "left"))
    return j.select("address_id", "parcel_id", "title_no", "unit_type", "unit_value", "street_number",
                    "street_number_high", "street_number_suffix", "road_name", "road_type", "suburb", "city",
                    "postcode", "street_address", "full_address", "status", "address_class")


TITLE_ADDRESS_COLS = ["title_no", "address_id", "parcel_id", "full_address", "street_address", "unit_type",
                      "unit_value", "street_number", "street_number_high", "street_number_suffix", "road_name",
                      "road_type", "suburb", "city", "postcode"]


def title_address(dim_addr: DataFrame) -> DataFrame:
    """Distinct title <-> address rows with a title."""
    return dim_addr.where(F.col("title_no").isNotNull()).select(*TITLE_ADDRESS_COLS).distinct()


def address_search_table(dim_addr: DataFrame) -> DataFrame:
    """Addresses with a title plus four pre-folded search columns."""
    return dim_addr.where(F.col("title_no").isNotNull()).select(
        *dim_addr.columns,
        fold_text("full_address").alias("full_address_norm"),
        fold_text("road_name").alias("road_name_norm"),
        F.lower(F.coalesce(F.col("street_number"), F.lit(""))).alias("street_number_norm"),
        F.lower(F.coalesce(F.col("unit_value"), F.lit(""))).alias("unit_value_norm"),
    )


def address_search_text(a: DataFrame, comp: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Text-only address search projection (component and reference text bags)."""
    ct = comp.groupBy("address_id").agg(
        A.bag_text("component_value", distinct=False).alias("component_text"),
        A.bag_text("component_type", distinct=False).alias("component_types"))
    out = a.join(ct.withColumnRenamed("address_id", "__c"), a["address_id"] == F.col("__c"), "left")
    if ref is not None:
        rt = ref.groupBy("address_id").agg(A.bag_text("reference_value", distinct=False).alias("reference_text"))
        out = out.join(rt.withColumnRenamed("address_id", "__r"), F.col("address_id") == F.col("__r"), "left")
    else:
        out = out.withColumn("reference_text", F.lit(None).cast("string"))
    comp_text = F.coalesce(F.col("component_text"), F.lit(""))
    ref_text = F.coalesce(F.col("reference_text"), F.lit(""))
    return out.select(
        "address_id", "parcel_id", opt(a, "primary_address"), "address_class", opt(a, "address_lifecycle_stage"),
        opt(a, "address_position_type"), opt(a, "alternative_address_type"), opt(a, "addressable_object_id", "bigint"),
        comp_text.alias("component_text"), ref_text.alias("reference_text"),
        F.lower(F.concat_ws(" ", F.col("address_id").cast("string"), comp_text, ref_text,
                            F.col("parcel_id").cast("string"))).alias("search_text"),
    )


# ---------------------------------------------------------------------------
# G12 360 view and G18 its search table
# ---------------------------------------------------------------------------
def latest_instruments(tit: DataFrame, ti: DataFrame, tt: DataFrame, latest: str = "struct") -> DataFrame:
    """Per title (k): instrument_count, registered_instrument_count, latest_lodged_date and the latest
    instrument's tin_id, inst_no, trt_grp, trt_type and transaction_type_desc.

    Only ids, dates and a flag are shuffled and aggregated, by hash: links and dates meet on the
    instrument, which also makes (title, instrument) distinct without another exchange, and the
    winner is the largest (date, id) in one number.  Its attributes and label are joined to one
    row per title."""
    links = tit.select(F.col("ttl_title_no").alias("k"), F.col("tin_id").alias("__tin"))
    dates = ti.select(F.col("id").alias("__id"), "lodged_date",
                      F.when(in_codes("status", ("REGD", "LIVE")), F.lit(1)).otherwise(F.lit(0)).alias("__live"))
    per = (links.join(dates, F.col("__tin") == F.col("__id")).groupBy("__tin", "k")
           .agg(F.max("lodged_date").alias("lodged_date"), F.sum("__live").alias("__live")))
    key = A.latest_key("lodged_date", "__tin", None if latest == "raw" else "1900-01-01")
    best = per.groupBy("k").agg(A.n_rows().alias("instrument_count"), F.sum("__live").cast("bigint").alias("registered_instrument_count"),
                                F.max("lodged_date").alias("latest_lodged_date"), F.max(key).alias("__key"))
    named = ti.select(F.col("id").alias("tin_id"), "inst_no", "trt_grp", "trt_type")
    label = tt.select(F.col("grp").alias("__grp"), F.col("type").alias("__type"), F.col("description").alias("transaction_type_desc"))
    return (best.withColumn("__latest", A.key_tie("__key"))
            .join(named, F.col("__latest") == F.col("tin_id"), "left")
            .join(label, (F.col("trt_grp") == F.col("__grp")) & (F.col("trt_type") == F.col("__type")), "left")
            .drop("__key", "__latest", "__grp", "__type"))


def title_360(t, latest: str = "struct", appellation_status: str = "CURR", edge_status: str = "CURR",
              as_of: Column | None = None) -> DataFrame:
    """One row per title with nine aggregated branches and four code labels."""
    codes = t.system_code
    # estates, with the estate-type label (bounded code list, broadcast)
    ettt = codes.where(F.col("code_group") == "ETTT").select(F.col("code").alias("__c"),
                                                             F.col("description").alias("__d"))
    te = t.title_estate.join(F.broadcast(ettt), F.col("type") == F.col("__c"), "left")
    estate = te.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_rows().alias("estate_count"),
        A.n_where("is_current").alias("current_estate_count"),
        A.list_distinct("type", ", ").alias("estate_types"),
        A.list_distinct(code_label("__d", "type"), ", ").alias("estate_types_desc"))
    # ownership: estate -> share -> proprietor, proprietors not historical
    es = t.estate_share.select(F.col("id").alias("__es"), F.col("ett_id").alias("__ett"))
    p = t.proprietor.where(not_code("status", "HIST"))
    # dealt by title as rows: lists of one, as a partial aggregate makes them here, are larger
    own = (t.title_estate.select(F.col("id").alias("__te"), "ttl_title_no")
           .join(es, F.col("__te") == F.col("__ett"))
           .join(p, F.col("__es") == p["ets_id"])
           .select("ttl_title_no", "id", "type", "prime_surname", "prime_other_names").repartition("ttl_title_no"))
    ownership = own.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_distinct_listed("id").alias("proprietor_count"),
        A.list_ordered(party_name("type", "prime_other_names", "prime_surname"), "prime_surname", "id",
                       " | ").alias("proprietors"))
    # instruments
    instr = latest_instruments(t.title_instrument_title, t.title_instrument, t.transaction_type, latest).select(
        "k", "instrument_count", F.col("latest_lodged_date").alias("latest_instrument_date"),
        F.col("inst_no").alias("latest_inst_no"),
        F.when(F.col("tin_id").isNotNull(), type_code("trt_grp", "trt_type")).alias("latest_inst_type"),
        F.col("transaction_type_desc").alias("latest_inst_type_desc"))
    # encumbrances, parcels
    enc = t.title_encumbrance.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_rows().alias("encumbrance_count"), A.n_where("is_current").alias("current_encumbrance_count"))
    par = t.title_parcel_association.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_distinct("par_id").alias("parcel_count"))
    # address and appellations
    addr = title_address(dim_address(t.address_point, t.address_component, t.title_parcel_association)) \
        .groupBy(F.col("title_no").alias("k")).agg(F.min("full_address").alias("primary_address"))
    appel = title_appellation(t.title_parcel_association, t.appellation) \
        .where(F.col("appellation_status") == appellation_status) \
        .groupBy(F.col("title_no").alias("k")).agg(A.list_distinct("appellation_value", " | ").alias("appellations"))
    # most recent predecessor
    lin = latest_row(t.title_hierarchy.where(F.col("status") == edge_status),
                     ["ttl_title_no_flw"], [F.col("id").desc()]) \
        .select(F.col("ttl_title_no_flw").alias("k"), F.col("ttl_title_no_prior").alias("prior_title_no"))

    base = dim_title(t.title, t.land_district)
    j = star_left(base, [estate, ownership, instr, enc, par, addr, appel, lin], "title_no", "k")
    j = label_codes(j, codes, TITLE_CODE_GROUPS)          # after the star: its shuffle carries no labels
    zero = F.lit(0).cast("bigint")
    cols = [
        "title_no", "title_status", "title_status_desc", "title_type", "title_type_desc",
        "register_type", "register_type_desc", "issue_date", "is_current", "is_active",
        "land_district_name", "ldt_loc_id", "maori_land", "guarantee_status", "guarantee_status_desc",
        F.coalesce("proprietor_count", zero).alias("proprietor_count"), "proprietors",
        F.coalesce("estate_count", zero).alias("estate_count"),
        F.coalesce("current_estate_count", zero).alias("current_estate_count"),
        "estate_types", "estate_types_desc",
        F.coalesce("instrument_count", zero).alias("instrument_count"),
        "latest_instrument_date", "latest_inst_no", "latest_inst_type", "latest_inst_type_desc",
        F.coalesce("encumbrance_count", zero).alias("encumbrance_count"),
        F.coalesce("current_encumbrance_count", zero).alias("current_encumbrance_count"),
        F.coalesce("parcel_count", zero).alias("parcel_count"),
        "primary_address", "appellations", "prior_title_no",
    ]
    if as_of is not None:
        cols.append(as_of.alias("refreshed_at"))
    return j.select(*cols)


def title_search_table(t360: DataFrame) -> DataFrame:
    """360 row + five pre-folded search columns (C21: title key folded like the query)."""
    def folded(c):
        return fold_text(F.coalesce(F.col(c), F.lit("")))
    return t360.select(
        *t360.columns,
        fold_text("title_no").alias("title_no_norm"),
        folded("primary_address").alias("primary_address_norm"),
        folded("appellations").alias("appellations_norm"),
        folded("proprietors").alias("proprietors_norm"),
        F.lower(F.coalesce(F.col("estate_types"), F.lit(""))).alias("estate_types_norm"),
    )


# ---------------------------------------------------------------------------
# G13-G15 title search tables
# ---------------------------------------------------------------------------
def _search_branches(t, with_arrays: bool, latest: str = "struct", primary_estate: str = "min"):
    # lists are larger than the rows they are made of, so rows are dealt by title (where they are not already)
    te = t.title_estate.repartition("ttl_title_no") if with_arrays else t.title_estate
    pick_type = F.max if primary_estate == "max" else F.min      # C2: smallest current type by default
    est_aggs = [
        A.n_rows().alias("estate_count"),
        A.n_where_sum("is_current").alias("current_estate_count"),
        pick_type(F.when(F.col("is_current"), F.col("type"))).alias("primary_estate_type"),
    ]
    if with_arrays:
        est_aggs += [
            A.sorted_set("type").alias("estate_types"),
            A.concat_summary("share", "; ").alias("estate_share_summary"),
            A.concat_summary(opt(te, "purpose"), "; ").alias("estate_purpose_summary"),
            A.any_true(opt(te, "timeshare_week_no").isNotNull()).alias("has_timeshare_estate"),
            A.any_true(opt(te, "term").isNotNull()).alias("has_term_estate"),
            A.collect_structs("id", "type", "status", "share", opt(te, "purpose"), opt(te, "term"),
                              opt(te, "original_flag")).alias("estates"),
        ]
    estate = te.groupBy(F.col("ttl_title_no").alias("k")).agg(*est_aggs)

    instr = latest_instruments(t.title_instrument_title, t.title_instrument, t.transaction_type, latest).select(
        "k", "instrument_count", "registered_instrument_count", "latest_lodged_date",
        F.col("tin_id").alias("latest_instrument_id"), F.col("inst_no").alias("latest_instrument_no"),
        F.col("trt_type").alias("latest_instrument_type"),
        F.col("transaction_type_desc").alias("latest_instrument_description"))
    if with_arrays:
        # dealt by title before the label
        ti = t.title_instrument.select(F.col("id").alias("tin_id"), "inst_no", "trt_grp", "trt_type", "status", "lodged_date",
                                       "priority_no")
        label = t.transaction_type.select(F.col("grp").alias("__grp"), F.col("type").alias("__type"), "description")
        d = (t.title_instrument_title.select(F.col("ttl_title_no").alias("__k"), F.col("tin_id").alias("__tin"))
             .join(ti, F.col("__tin") == F.col("tin_id")).drop("__tin").repartition("__k")
             .join(label, (F.col("trt_grp") == F.col("__grp")) & (F.col("trt_type") == F.col("__type")), "left"))
        lists = d.groupBy("__k").agg(
            A.collect_structs("tin_id", "inst_no", "trt_grp", "trt_type", "description", "status", "lodged_date",
                              "priority_no").alias("instruments"))
        instr = instr.join(lists, F.col("k") == F.col("__k"), "left").drop("__k")

    ten = t.title_encumbrance
    enc_aggs = [
        A.n_rows().alias("encumbrance_count"),
        A.n_where_sum("is_current").alias("current_encumbrance_count"),
        A.any_true("is_current").alias("has_current_encumbrance"),
    ]
    if with_arrays:
        e = t.encumbrance.select(F.col("id").alias("__eid"), F.col("status").alias("__estatus"),
                                 F.col("term").alias("__eterm"))
        ten = ten.join(e, ten["enc_id"] == e["__eid"], "left").drop("__eid").repartition("ttl_title_no")
        enc_aggs += [
            F.max("enc_id").alias("latest_encumbrance_id"),
            A.collect_structs(F.col("id").alias("title_encumbrance_id"), "enc_id", "status",
                              opt(ten, "act_tin_id_crt", "bigint"), opt(ten, "act_id_crt", "bigint"),
                              F.col("__estatus").alias("encumbrance_status"),
                              F.col("__eterm").alias("term")).alias("encumbrances"),
        ]
    enc = ten.groupBy(F.col("ttl_title_no").alias("k")).agg(*enc_aggs)

    h = t.title_hierarchy.where(F.col("ttl_title_no_prior").isNotNull() & F.col("ttl_title_no_flw").isNotNull())
    p_aggs = [A.n_rows().alias("prior_title_count")]
    f_aggs = [A.n_rows().alias("follow_on_title_count")]
    if with_arrays:
        p_aggs.append(A.sorted_set("ttl_title_no_prior").alias("prior_titles"))
        f_aggs.append(A.sorted_set("ttl_title_no_flw").alias("follow_on_titles"))
    prior = h.groupBy(F.col("ttl_title_no_flw").alias("k")).agg(*p_aggs)
    follow = h.groupBy(F.col("ttl_title_no_prior").alias("k")).agg(*f_aggs)
    branches = [estate, instr, enc, prior, follow]
    if with_arrays:
        dr = t.title_document_reference
        docs = (t.title_instrument_title.join(dr.withColumnRenamed("tin_id", "__dtin"),
                                              F.col("tin_id") == F.col("__dtin")).repartition("ttl_title_no")
                .groupBy(F.col("ttl_title_no").alias("k"))
                .agg(A.n_rows().alias("document_reference_count"),
                     A.collect_structs("id", "type", F.col("__dtin").alias("tin_id"),
                                       "reference").alias("document_references")))
        branches.append(docs)
    return branches


def _search_text() -> Column:
    return F.lower(F.concat_ws(" ", "title_no", "title_type", "register_type",
                               F.coalesce(F.col("latest_instrument_no"), F.lit("")),
                               F.coalesce(F.col("latest_instrument_description"), F.lit(""))))


def title_search_core(t, latest: str = "struct", as_of: Column | None = None,
                      primary_estate: str = "min") -> DataFrame:
    """One row per title, counts and latest instrument, no arrays (the hot table)."""
    base = t.title.select("title_no", F.col("status").alias("title_status"), F.col("type").alias("title_type"),
                          "register_type", "issue_date", "guarantee_status", opt(t.title, "maori_land"),
                          "is_current", opt(t.title, "ste_id", "bigint"), "ldt_loc_id")
    j = star_left(base, _search_branches(t, with_arrays=False, latest=latest, primary_estate=primary_estate),
                  "title_no", "k")
    zero = F.lit(0).cast("bigint")
    cols = [
        "title_no", "title_status", "title_type", "register_type", "issue_date", "guarantee_status",
        "maori_land", "is_current", "ste_id", "ldt_loc_id",
        F.coalesce("estate_count", zero).alias("estate_count"),
        F.coalesce("current_estate_count", zero).alias("current_estate_count"),
        "primary_estate_type",
        F.coalesce("instrument_count", zero).alias("instrument_count"),
        F.coalesce("registered_instrument_count", zero).alias("registered_instrument_count"),
        "latest_instrument_id", "latest_instrument_no", "latest_instrument_type",
        "latest_instrument_description", "latest_lodged_date",
        F.coalesce("encumbrance_count", zero).alias("encumbrance_count"),
        F.coalesce("current_encumbrance_count", zero).alias("current_encumbrance_count"),
        F.coalesce("has_current_encumbrance", F.lit(False)).alias("has_current_encumbrance"),
        F.coalesce("prior_title_count", zero).alias("prior_title_count"),
        F.coalesce("follow_on_title_count", zero).alias("follow_on_title_count"),
        _search_text().alias("search_text"),
    ]
    if as_of is not None:
        cols.append(as_of.alias("updated_at"))
    return j.select(*cols)


def title_search_wide(t, latest: str = "struct", as_of: Column | None = None,
                      primary_estate: str = "min") -> DataFrame:
    """One row per title with nested arrays, counts, lineage lists and search text."""
    tt = t.title
    base = tt.select("title_no", F.col("status").alias("title_status"), F.col("type").alias("title_type"),
                     "register_type", "issue_date", "guarantee_status", opt(tt, "provisional"),
                     opt(tt, "maori_land"), opt(tt, "ste_id", "bigint"), opt(tt, "sur_wrk_id", "bigint"),
                     "ldt_loc_id", opt(tt, "ttl_title_no_srs"), opt(tt, "ttl_title_no_head_srs"),
                     "is_current", F.coalesce(F.col("status") == "LIVE", F.lit(False)).alias("is_live"))
    j = star_left(base, _search_branches(t, with_arrays=True, latest=latest, primary_estate=primary_estate),
                  "title_no", "k")
    zero = F.lit(0).cast("bigint")

    def arr(c):
        return F.coalesce(F.col(c), F.array().cast(j.schema[c].dataType)).alias(c)
    lineage = (F.coalesce("prior_title_count", zero) > 0) | (F.coalesce("follow_on_title_count", zero) > 0)
    cols = [
        "title_no", "title_status", "title_type", "register_type", "issue_date", "guarantee_status",
        "provisional", "maori_land", "ste_id", "sur_wrk_id", "ldt_loc_id", "ttl_title_no_srs",
        "ttl_title_no_head_srs", "is_current", "is_live",
        F.coalesce("estate_count", zero).alias("estate_count"),
        F.coalesce("current_estate_count", zero).alias("current_estate_count"),
        "primary_estate_type", arr("estate_types"), "estate_share_summary", "estate_purpose_summary",
        F.coalesce("has_timeshare_estate", F.lit(False)).alias("has_timeshare_estate"),
        F.coalesce("has_term_estate", F.lit(False)).alias("has_term_estate"),
        arr("estates"),
        F.coalesce("instrument_count", zero).alias("instrument_count"),
        F.coalesce("registered_instrument_count", zero).alias("registered_instrument_count"),
        "latest_instrument_id", "latest_instrument_no", "latest_instrument_type",
        "latest_instrument_description", "latest_lodged_date", arr("instruments"),
        F.coalesce("encumbrance_count", zero).alias("encumbrance_count"),
        F.coalesce("current_encumbrance_count", zero).alias("current_encumbrance_count"),
        F.coalesce("has_current_encumbrance", F.lit(False)).alias("has_current_encumbrance"),
        "latest_encumbrance_id", arr("encumbrances"),
        F.coalesce("prior_title_count", zero).alias("prior_title_count"),
        F.coalesce("follow_on_title_count", zero).alias("follow_on_title_count"),
        arr("prior_titles"), arr("follow_on_titles"), lineage.alias("has_title_lineage"),
        F.coalesce("document_reference_count", zero).alias("document_reference_count"),
        arr("document_references"),
        _search_text().alias("search_text"),
    ]
    if as_of is not None:
        cols.append(as_of.alias("updated_at"))
    return j.select(*cols)


def _dealt(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``key`` and ``cols`` of ``df``, dealt by ``key`` in one exchange that all aggregates of it read: out of a
    generator, so that none of them cuts columns or rows below the exchange and has one of its own."""
    return settled(df.select(key, *cols).repartition(key), cols)


def title_search_enriched(core: DataFrame, t, preview_n: int = 8) -> DataFrame:
    """Core + parcels, appellations, legal text and an enriched search text."""
    tpa = t.title_parcel_association
    parcel = tpa.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_distinct("par_id").alias("parcel_count"), A.sorted_set("par_id").alias("parcel_ids"))
    a = t.appellation.select(F.col("par_id").alias("__apar"), F.col("id").alias("__aid"), "parcel_type",
                             "parcel_value", "appellation_value", "block_number")
    ta = tpa.select("ttl_title_no", "par_id").join(a, F.col("par_id") == F.col("__apar"), "left")
    ta = _dealt(ta, "ttl_title_no", ["__aid", "parcel_type", "parcel_value", "appellation_value", "block_number"])
    app = ta.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_distinct_listed("__aid").alias("appellation_count"),
        F.concat_ws(" ", A.bag_text("appellation_value"), A.bag_text("parcel_value"),
                    A.bag_text("block_number")).alias("appellation_search_text"))
    app_prev = A.preview(ta, "ttl_title_no",
                         F.when(F.col("__aid").isNotNull(),
                                F.concat_ws(" ", "parcel_type", "parcel_value", "appellation_value")),
                         preview_n, " | ", "appellation_preview").withColumnRenamed("ttl_title_no", "k")
    ld = t.legal_description.select(F.col("id").alias("__ld"), F.col("ttl_title_no").alias("__ldt"),
                                    "legal_desc_text")
    ldp = t.legal_description_parcel.select(F.col("lgd_id").alias("__lgd"), F.col("par_id").alias("__lpar"))
    tp2 = tpa.select(F.col("par_id").alias("__tpar"), F.col("ttl_title_no").alias("__tt"))
    lj = (ld.join(ldp, F.col("__ld") == F.col("__lgd"), "left")
            .join(tp2, F.col("__lpar") == F.col("__tpar"), "left")
            .withColumn("k", F.coalesce("__ldt", "__tt"))
            .where(F.col("k").isNotNull()))          # a NULL key never meets a title
    lj = _dealt(lj, "k", ["__ld", "legal_desc_text"])
    legal = lj.groupBy("k").agg(A.n_distinct_listed("__ld").alias("legal_description_count"),
                                A.bag_text("legal_desc_text").alias("legal_description_search_text"))
    legal_prev = A.preview(lj, "k", "legal_desc_text", preview_n, " | ", "legal_description_preview")
    j = star_left(core, [parcel, app, app_prev, legal, legal_prev], "title_no", "k")
    zero = F.lit(0).cast("bigint")
    return j.select(
        *core.columns,
        F.coalesce("parcel_count", zero).alias("parcel_count"),
        F.coalesce("appellation_count", zero).alias("appellation_count"),
        F.coalesce("legal_description_count", zero).alias("legal_description_count"),
        "appellation_preview", "legal_description_preview",
        F.concat_ws(" ", "search_text", F.coalesce(F.col("appellation_search_text"), F.lit("")),
                    F.coalesce(F.col("legal_description_search_text"), F.lit(""))).alias("search_text_enriched"),
        "parcel_ids",
    )


# ---------------------------------------------------------------------------
# G19-G22 reports
# ---------------------------------------------------------------------------
def rpt_instrument_activity(ti: DataFrame, tit: DataFrame, tt: DataFrame) -> DataFrame:
    """Instruments and distinct titles affected by month and type."""
    d = instrument_detail(tit, ti, tt).where(F.col("lodged_date").isNotNull())
    return d.groupBy(F.trunc("lodged_date", "month").alias("lodged_month"), "trt_grp", "trt_type",
                     "transaction_type_desc").agg(
        A.n_rows().alias("instrument_count"), A.n_distinct("title_no").alias("titles_affected"))


def rpt_active_encumbrances(te: DataFrame, t: DataFrame, e: DataFrame, enc: DataFrame) -> DataFrame:
    """Current encumbrances on current titles, with holder."""
    t2 = t.where(F.col("is_current")).select(F.col("title_no").alias("__t"), F.col("status").alias("title_status"),
                                             "ldt_loc_id")
    e2 = e.select(F.col("id").alias("__e"), F.col("term").alias("encumbrance_term"))
    enc2 = enc.select(F.col("ens_id").alias("__ens"), F.col("name").alias("encumbrancee_name"),
                      F.col("status").alias("encumbrancee_status"))
    j = (te.where(F.col("is_current"))
           .join(t2, F.col("ttl_title_no") == F.col("__t"))
           .join(e2, F.col("enc_id") == F.col("__e"))
           .join(enc2, F.col("__ens") == F.col("__e"), "left"))
    return j.select(F.col("ttl_title_no").alias("title_no"), "title_status", "ldt_loc_id",
                    F.col("id").alias("title_encumbrance_id"), "enc_id", "encumbrance_term",
                    "encumbrancee_name", "encumbrancee_status")


def rpt_estate_by_district(te: DataFrame, t: DataFrame, ld: DataFrame) -> DataFrame:
    """Current estates by land district and estate type."""
    t2 = t.select(F.col("title_no").alias("__t"), "ldt_loc_id")
    ld2 = ld.select(F.col("ldt_loc_id").alias("__l"), F.col("name").alias("land_district"))
    j = (te.where(F.col("is_current")).join(t2, F.col("ttl_title_no") == F.col("__t"))
           .join(ld2, F.col("ldt_loc_id") == F.col("__l"), "left"))
    return j.groupBy("ldt_loc_id", "land_district", F.col("type").alias("estate_type")).agg(
        A.n_rows().alias("title_count"))


def rpt_instrument_status(ti: DataFrame, tt: DataFrame) -> DataFrame:
    """Instruments by type and status."""
    tt2 = tt.select(F.col("grp").alias("__g"), F.col("type").alias("__t"),
                    F.col("description").alias("transaction_type_desc"))
    j = ti.join(tt2, (F.col("trt_grp") == F.col("__g")) & (F.col("trt_type") == F.col("__t")), "left")
    return j.groupBy("trt_grp", "trt_type", "transaction_type_desc",
                     F.col("status").alias("instrument_status")).agg(A.n_rows().alias("cnt"))
