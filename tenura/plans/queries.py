"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Each runs its operator over whole adapter tables (no id subsets or row caps);
limits appear only where paging / top-k is the operator itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators.filters import current_flag
from tenura.sources.adapters import ConformedTables, RegistryTables
from tenura.plans import gold as G
from tenura.plans import incremental as IN
from tenura.plans import layout as K

_CACHE: dict = {}


def tables(spark: SparkSession, sf_dir: str) -> RegistryTables:
    key = (id(spark), sf_dir)
    t = _CACHE.get(key)
    if t is None or t.spark is not spark:
        t = RegistryTables(spark, sf_dir)
        _CACHE.clear()
        _CACHE[key] = t
    return t


QUERIES: dict = {}


def register(key):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# Gold products
# ---------------------------------------------------------------------------
@register("title_search_core")
def q_title_search_core(spark, sf_dir) -> DataFrame:
    return G.title_search_core(tables(spark, sf_dir))


def as_json(df: DataFrame, *cols: str) -> DataFrame:
    """Nested columns as JSON text (NULL fields kept), for engine-neutral comparison."""
    opts = {"ignoreNullFields": "false"}
    return df.select(*[F.to_json(F.col(c), opts).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# F: filters
# ---------------------------------------------------------------------------
from tenura.functions import text as X  # noqa: E402
from tenura.operators import aggregates as A  # noqa: E402
from tenura.operators import filters as FL  # noqa: E402
from tenura.operators import joins as J  # noqa: E402
from tenura.operators import ordering as O  # noqa: E402
from tenura.operators.windows import latest_row  # noqa: E402


@register("filter_in_codes")
def q_filter_in_codes(spark, sf_dir):
    t = tables(spark, sf_dir).title
    return t.where(FL.in_codes("status", ("LIVE", "REGD"))).select("title_no", "status")


@register("filter_open_interval")
def q_filter_open_interval(spark, sf_dir):
    c = tables(spark, sf_dir).address_component
    return c.where(FL.still_open("end_lifecycle")).select("address_id", "component_type", "component_value")


@register("filter_not_hist")
def q_filter_not_hist(spark, sf_dir):
    p = tables(spark, sf_dir).proprietor
    return p.where(FL.not_code("status", "HIST")).select("id", "ets_id", "status")


@register("filter_current_both")
def q_filter_current_both(spark, sf_dir):
    t = tables(spark, sf_dir)
    te = t.title_encumbrance.select("id", "ttl_title_no", F.col("is_current").alias("te_cur"))
    ti = t.title.select(F.col("title_no"), F.col("is_current").alias("t_cur"))
    j = te.join(ti, te["ttl_title_no"] == ti["title_no"])
    return j.where(FL.both_current("te_cur", "t_cur")).select("id", "ttl_title_no")


@register("filter_not_null_pair")
def q_filter_not_null_pair(spark, sf_dir):
    h = tables(spark, sf_dir).title_hierarchy
    return h.where(FL.both_present("ttl_title_no_prior", "ttl_title_no_flw")) \
            .select("id", "ttl_title_no_prior", "ttl_title_no_flw")


@register("filter_any_contains")
def q_filter_any_contains(spark, sf_dir):
    t = tables(spark, sf_dir).title
    cols = [X.fold_text("title_no"), X.fold_text("type"), X.fold_text("register_type")]
    return t.where(X.any_contains(cols, "le")).select("title_no", "type", "register_type")


@register("filter_null_safe_equal")
def q_filter_null_safe_equal(spark, sf_dir):
    t = tables(spark, sf_dir)
    ld = t.legal_description
    tpa = t.title_parcel_association.select(F.col("ttl_title_no").alias("__t"))
    return ld.join(tpa, FL.blank_safe_eq(ld["ttl_title_no"], tpa["__t"]), "left_semi").select("id", "ttl_title_no")


# ---------------------------------------------------------------------------
# J: joins
# ---------------------------------------------------------------------------
@register("join_bridge_inner")
def q_join_bridge_inner(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = J.bridge_join(t.title_instrument_title, t.title_instrument, {"tin_id": "id"})
    return j.select("ttl_title_no", "tin_id", "inst_no", "status")


@register("join_lookup_composite")
def q_join_lookup_composite(spark, sf_dir):
    t = tables(spark, sf_dir)
    tt = t.transaction_type.withColumnRenamed("type", "tt_type")
    j = J.lookup(t.title_instrument, tt, [("trt_grp", "grp"), ("trt_type", "tt_type")])
    return j.select("id", "trt_grp", "trt_type", "description")


@register("join_lookup_code_group")
def q_join_lookup_code_group(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = J.label_codes(t.title, t.system_code, {"status": "TTLS", "type": "TTLT", "register_type": "TTLR",
                                               "guarantee_status": "TTLG"})
    return j.select("title_no", "status_desc", "type_desc", "register_type_desc", "guarantee_status_desc")


@register("join_chain_left")
def q_join_chain_left(spark, sf_dir):
    t = tables(spark, sf_dir)
    te = t.title_estate.select(F.col("id").alias("title_estate_id"))
    es = t.estate_share.select(F.col("id").alias("estate_share_id"), "ett_id")
    p = t.proprietor.select(F.col("id").alias("proprietor_id"), "ets_id")
    return J.chain_left([te, es, p], [{"title_estate_id": "ett_id"}, {"estate_share_id": "ets_id"}]) \
            .select("title_estate_id", "estate_share_id", "proprietor_id")


@register("join_left_residual")
def q_join_left_residual(spark, sf_dir):
    t = tables(spark, sf_dir)
    e = t.encumbrance.select(F.col("id").alias("enc_id"))
    es = t.encumbrance_share.select(F.col("id").alias("share_id"), F.col("enc_id").alias("es_enc"),
                                    F.col("status").alias("share_status"))
    j = J.left_where(e, es, {"enc_id": "es_enc"}, F.col("share_status") == "REGD")
    return j.select("enc_id", "share_id", "share_status")


@register("join_inner_residual")
def q_join_inner_residual(spark, sf_dir):
    t = tables(spark, sf_dir)
    a = t.appellation.select(F.col("par_id").alias("a_par"), F.col("id").alias("appellation_id"), "title_flag")
    j = J.inner_where(t.title_parcel_association, a, {"par_id": "a_par"}, F.col("title_flag") == "Y")
    return j.select("ttl_title_no", "par_id", "appellation_id")


@register("join_self_twice")
def q_join_self_twice(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = J.lookup_roles(t.title_hierarchy, t.title, "title_no", {
        "ttl_title_no_prior": ("p", {"status": "prior_title_status"}),
        "ttl_title_no_flw": ("f", {"status": "following_title_status"}),
    })
    return j.select("id", "prior_title_status", "following_title_status")


@register("join_anti_missing")
def q_join_anti_missing(spark, sf_dir):
    t = tables(spark, sf_dir)
    return J.missing(t.title.select("title_no"), t.title_parcel_association, {"title_no": "ttl_title_no"})


@register("join_anti_not_exists")
def q_join_anti_not_exists(spark, sf_dir):
    t = tables(spark, sf_dir)
    return J.without_match(t.title.select("title_no"), t.title_hierarchy, {"title_no": "ttl_title_no_flw"},
                           F.col("status") == "CURR")


@register("join_star_left")
def q_join_star_left(spark, sf_dir):
    t = tables(spark, sf_dir)
    e = t.title_estate.groupBy(F.col("ttl_title_no").alias("k")).agg(A.n_rows().alias("estate_count"))
    i = t.title_instrument_title.groupBy(F.col("ttl_title_no").alias("k")).agg(
        A.n_distinct("tin_id").alias("instrument_count"))
    n = t.title_encumbrance.groupBy(F.col("ttl_title_no").alias("k")).agg(A.n_rows().alias("encumbrance_count"))
    j = J.star_left(t.title.select("title_no"), [e, i, n], "title_no", "k")
    z = F.lit(0).cast("bigint")
    return j.select("title_no", *[F.coalesce(c, z).alias(c) for c in
                                  ("estate_count", "instrument_count", "encumbrance_count")])


@register("join_coalesced_key")
def q_join_coalesced_key(spark, sf_dir):
    t = tables(spark, sf_dir)
    ld = t.legal_description.select(F.col("id").alias("ld_id"), F.col("ttl_title_no").alias("ld_title"))
    ldp = t.legal_description_parcel.select("lgd_id", F.col("par_id").alias("ldp_par"))
    tpa = t.title_parcel_association.select(F.col("par_id").alias("tpa_par"), F.col("ttl_title_no").alias("tpa_title"))
    j = J.chain_left([ld, ldp, tpa], [{"ld_id": "lgd_id"}, {"ldp_par": "tpa_par"}])
    return j.groupBy(J.group_by_either_key(j, "ld_title", "tpa_title", "title_no")).agg(
        A.n_distinct("ld_id").alias("legal_description_count"))


@register("join_fallback_attr")
def q_join_fallback_attr(spark, sf_dir):
    t = tables(spark, sf_dir)
    addr = G.address_search_table(G.dim_address(t.address_point, t.address_component,
                                                t.title_parcel_association))
    j = J.inherit_attr(t.title_hierarchy, addr, "ttl_title_no_prior", "ttl_title_no_flw", "title_no",
                       "full_address", "address")
    return j.select("id", "ttl_title_no_prior", "ttl_title_no_flw", "address", "address_inherited")


# ---------------------------------------------------------------------------
# A: aggregates
# ---------------------------------------------------------------------------
def _detail(t):
    return G.instrument_detail(t.title_instrument_title, t.title_instrument, t.transaction_type)


@register("agg_count")
def q_agg_count(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    return te.groupBy("ttl_title_no").agg(A.n_rows().alias("estate_count"))


@register("agg_count_if")
def q_agg_count_if(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    return te.groupBy("ttl_title_no").agg(A.n_where("is_current").alias("current_count_if"),
                                          A.n_where_sum("is_current").alias("current_sum"))


@register("agg_count_distinct")
def q_agg_count_distinct(spark, sf_dir):
    d = _detail(tables(spark, sf_dir))
    return d.groupBy("title_no").agg(A.n_distinct("tin_id").alias("instrument_count"))


@register("agg_bool_any")
def q_agg_bool_any(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    return te.groupBy("ttl_title_no").agg(A.any_true(F.col("share").isNotNull()).alias("has_share"),
                                          A.any_true("is_current").alias("has_current"))


@register("agg_min_max")
def q_agg_min_max(spark, sf_dir):
    d = _detail(tables(spark, sf_dir))
    return d.groupBy("title_no").agg(F.max("lodged_date").alias("latest_date"), F.max("tin_id").alias("max_tin_id"),
                                     F.min("tin_id").alias("min_tin_id"))


def _latest(spark, sf_dir, fn):
    d = _detail(tables(spark, sf_dir))
    g = d.groupBy("title_no").agg(fn(F.struct("tin_id", "inst_no", "trt_type", "instrument_status"),
                                     "lodged_date", "tin_id").alias("l"))
    return g.select("title_no", F.col("l.tin_id").alias("latest_tin_id"), F.col("l.inst_no").alias("latest_inst_no"),
                    F.col("l.trt_type").alias("latest_trt_type"), F.col("l.instrument_status").alias("latest_status"))


@register("agg_latest_by")
def q_agg_latest_by(spark, sf_dir):
    return _latest(spark, sf_dir, A.latest_by)


@register("agg_latest_by_raw")
def q_agg_latest_by_raw(spark, sf_dir):
    return _latest(spark, sf_dir, A.latest_by_raw)


@register("agg_collect_structs")
def q_agg_collect_structs(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    g = te.groupBy("ttl_title_no").agg(A.collect_structs("id", "type", "status", "share").alias("estates"))
    return as_json(g, "estates")


@register("agg_sorted_set")
def q_agg_sorted_set(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    return as_json(te.groupBy("ttl_title_no").agg(A.sorted_set("type").alias("estate_types")), "estate_types")


@register("agg_concat_summary")
def q_agg_concat_summary(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    return te.groupBy("ttl_title_no").agg(A.concat_summary("share", "; ").alias("estate_share_summary"))


@register("agg_listagg_distinct")
def q_agg_listagg_distinct(spark, sf_dir):
    t = tables(spark, sf_dir)
    ettt = t.system_code.where(F.col("code_group") == "ETTT").select(F.col("code").alias("c"),
                                                                     F.col("description").alias("d"))
    te = t.title_estate.join(F.broadcast(ettt), F.col("type") == F.col("c"), "left")
    return te.groupBy("ttl_title_no").agg(
        A.list_distinct("type", ", ").alias("estate_types"),
        A.list_distinct(X.code_label("d", "type"), ", ").alias("estate_types_desc"))


@register("agg_listagg_ordered")
def q_agg_listagg_ordered(spark, sf_dir):
    t = tables(spark, sf_dir)
    es = t.estate_share.select(F.col("id").alias("es_id"), "ett_id")
    p = t.proprietor.where(FL.not_code("status", "HIST"))
    j = (t.title_estate.select(F.col("id").alias("te_id"), "ttl_title_no")
         .join(es, F.col("te_id") == F.col("ett_id")).join(p, F.col("es_id") == F.col("ets_id")))
    return j.groupBy("ttl_title_no").agg(
        A.n_distinct("id").alias("proprietor_count"),
        A.list_ordered(X.party_name("type", "prime_other_names", "prime_surname"), "prime_surname", "id",
                       " | ").alias("proprietors"))


@register("agg_pivot_eav")
def q_agg_pivot_eav(spark, sf_dir):
    return G.address_parts(tables(spark, sf_dir).address_component)


@register("agg_preview_top8")
def q_agg_preview_top8(spark, sf_dir):
    t = tables(spark, sf_dir)
    a = t.appellation.select(F.col("par_id").alias("a_par"), "parcel_type", "parcel_value", "appellation_value")
    ta = t.title_parcel_association.join(a, F.col("par_id") == F.col("a_par"))
    return A.preview(ta, "ttl_title_no", F.concat_ws(" ", "parcel_type", "parcel_value", "appellation_value"),
                     8, " | ", "appellation_preview")


@register("agg_month_activity")
def q_agg_month_activity(spark, sf_dir):
    d = _detail(tables(spark, sf_dir))
    return A.monthly_activity(d, "lodged_date", ["trt_type"], "title_no")


@register("agg_bag_text")
def q_agg_bag_text(spark, sf_dir):
    t = tables(spark, sf_dir)
    a = t.appellation.select(F.col("par_id").alias("a_par"), "appellation_value", "parcel_value", "block_number")
    ta = t.title_parcel_association.join(a, F.col("par_id") == F.col("a_par"), "left")
    return ta.groupBy("ttl_title_no").agg(
        F.concat_ws(" ", A.bag_text("appellation_value"), A.bag_text("parcel_value"),
                    A.bag_text("block_number")).alias("appellation_search_text"))


# ---------------------------------------------------------------------------
# W, O, U: windows, ordering, set operations
# ---------------------------------------------------------------------------
@register("win_latest_row")
def q_win_latest_row(spark, sf_dir):
    h = tables(spark, sf_dir).title_hierarchy.where(F.col("status") == "CURR")
    r = latest_row(h, ["ttl_title_no_flw"], [F.col("id").desc()])
    return r.select(F.col("ttl_title_no_flw").alias("title_no"), F.col("ttl_title_no_prior").alias("prior_title_no"),
                    "id")


def _t360(spark, sf_dir):
    return G.title_360(tables(spark, sf_dir))


@register("sort_multi_nulls_last")
def q_sort_multi_nulls_last(spark, sf_dir):
    return O.page(_t360(spark, sf_dir), O.search_order("latest_lodged_date", "desc"), 50, 0) \
            .select("title_no", "is_current", "latest_instrument_date")


@register("page_limit_offset")
def q_page_limit_offset(spark, sf_dir):
    lim, off = O.page_bounds("20", "100")
    return O.page(_t360(spark, sf_dir), O.search_order("instrument_count", "asc"), lim, off) \
            .select("title_no", "is_current", "instrument_count")


@register("topk_by_count")
def q_topk_by_count(spark, sf_dir):
    t = _t360(spark, sf_dir).where(F.col("is_active"))
    return O.top_k(t, "instrument_count", 5, "title_no").select("title_no", "instrument_count", "encumbrance_count")


@register("distinct_rows")
def q_distinct_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    d = G.dim_address(t.address_point, t.address_component, t.title_parcel_association)
    return O.distinct_cols(d.where(F.col("title_no").isNotNull()), ["title_no", "address_id", "full_address"])


# ---------------------------------------------------------------------------
# X: scalar functions
# ---------------------------------------------------------------------------
@register("fn_fold_text")
def q_fn_fold_text(spark, sf_dir):
    c = tables(spark, sf_dir).address_component
    return c.select("address_id", "component_type", X.fold_text("component_value").alias("folded"))


@register("fn_join_skip_null")
def q_fn_join_skip_null(spark, sf_dir):
    p = G.address_parts(tables(spark, sf_dir).address_component)
    return p.select("address_id", X.join_parts(", ", "road_name", "suburb", "city", "postcode").alias("joined"))


@register("fn_person_name")
def q_fn_person_name(spark, sf_dir):
    p = tables(spark, sf_dir).proprietor
    return p.select("id", X.party_name("type", "prime_other_names", "prime_surname", "name_suffix").alias("name"))


@register("fn_street_number")
def q_fn_street_number(spark, sf_dir):
    p = G.address_parts(tables(spark, sf_dir).address_component)
    return p.select("address_id", X.street_no("street_number", "street_number_high",
                                              "street_number_suffix").alias("street_no"))


@register("fn_code_label")
def q_fn_code_label(spark, sf_dir):
    t = tables(spark, sf_dir)
    ettt = t.system_code.where(F.col("code_group") == "ETTT").select(F.col("code").alias("c"),
                                                                     F.col("description").alias("d"))
    j = t.title_estate.join(F.broadcast(ettt), F.col("type") == F.col("c"), "left")
    return j.select("id", X.code_label("d", "type").alias("type_desc"))


# The literal CASE labels of the older 360 view.
TITLE_STATUS_CASE = {"LIVE": "Live", "HIST": "Historical", "CANC": "Cancelled"}
TITLE_TYPE_CASE = {"F": "Fee Simple", "LH": "Leasehold", "SRS": "Unit Title (SRS)", "ML": "Maori Land",
                   "MOT": "Miscellaneous Owners"}
REGISTER_TYPE_CASE = {"CF": "Computer Freehold Register", "CI": "Computer Interest Register"}


@register("fn_code_label_case")
def q_fn_code_label_case(spark, sf_dir):
    t = tables(spark, sf_dir).title
    return t.select("title_no", X.code_label_case("status", TITLE_STATUS_CASE).alias("title_status_desc"),
                    X.code_label_case("type", TITLE_TYPE_CASE).alias("title_type_desc"),
                    X.code_label_case("register_type", REGISTER_TYPE_CASE).alias("register_type_desc"))


@register("fn_type_code")
def q_fn_type_code(spark, sf_dir):
    ti = tables(spark, sf_dir).title_instrument
    return ti.select("id", X.type_code("trt_grp", "trt_type").alias("instrument_code"))


@register("fn_file_parts")
def q_fn_file_parts(spark, sf_dir):
    p = tables(spark, sf_dir).raw("pages").select("page_id", "url")
    name = X.file_name("url")
    return p.select("page_id", name.alias("file_name"), X.file_entity(name, 3, "-").alias("entity"))


@register("fn_address_query_parse")
def q_fn_address_query_parse(spark, sf_dir):
    t = tables(spark, sf_dir)
    p = G.address_parts(t.address_component)
    q = p.select("address_id", F.concat_ws(" ", F.concat(F.col("street_number"),
                                                          F.coalesce(F.col("street_number_suffix"), F.lit(""))),
                                            "road_name", "road_type").alias("q"))
    s = q.select("address_id", "q", X.parse_address_query("q").alias("p"))
    return s.select("address_id", "q", "p.norm", "p.spaced", "p.num", "p.unit", "p.road", "p.road_name")


@register("fn_valid_key")
def q_fn_valid_key(spark, sf_dir):
    c = tables(spark, sf_dir).raw("conversations").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", X.valid_key("text").alias("valid"))


@register("fn_array_ops")
def q_fn_array_ops(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    g = te.groupBy("ttl_title_no").agg(F.collect_set(F.when(F.col("is_current"), F.col("type"))).alias("cur"),
                                       F.collect_set("type").alias("all_types"))
    out = g.select("ttl_title_no", X.first_sorted("cur").alias("primary_estate_type"),
                   F.sort_array(X.non_null_items("all_types")).alias("estate_types"),
                   F.slice(F.sort_array("all_types"), 1, 2).alias("first_two"))
    return as_json(out, "estate_types", "first_two")


@register("fn_split_list")
def q_fn_split_list(spark, sf_dir):
    d = _detail(tables(spark, sf_dir))
    g = d.groupBy("inst_no").agg(A.list_distinct("title_no", ",").alias("title_nos_str"))
    return as_json(g.select("inst_no", X.split_list("title_nos_str").alias("title_nos")), "title_nos")


# ---------------------------------------------------------------------------
# G: gold products
# ---------------------------------------------------------------------------
from tenura.plans import search as S  # noqa: E402


def _dim_address(t):
    return G.dim_address(t.address_point, t.address_component, t.title_parcel_association)


@register("dim_title")
def q_dim_title(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.dim_title(t.title, t.land_district)


@register("dim_appellation")
def q_dim_appellation(spark, sf_dir):
    return G.dim_appellation(tables(spark, sf_dir).appellation)


@register("bridge_title_parcel")
def q_bridge_title_parcel(spark, sf_dir):
    return G.bridge_title_parcel(tables(spark, sf_dir).title_parcel_association)


@register("fact_title_estate")
def q_fact_title_estate(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.fact_title_estate(t.title_estate, t.estate_share, t.proprietor)


@register("fact_title_instrument")
def q_fact_title_instrument(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.fact_title_instrument(t.title_instrument_title, t.title_instrument, t.transaction_type)


@register("fact_title_encumbrance")
def q_fact_title_encumbrance(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.fact_title_encumbrance(t.title_encumbrance, t.encumbrance, t.encumbrancee, t.encumbrance_share)


@register("v_title_lineage")
def q_v_title_lineage(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.title_lineage(t.title_hierarchy, t.title)


@register("v_title_appellation")
def q_v_title_appellation(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.title_appellation(t.title_parcel_association, t.appellation)


@register("v_title_legal")
def q_v_title_legal(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.title_legal(t.legal_description, t.legal_description_parcel)


@register("dim_address")
def q_dim_address(spark, sf_dir):
    return _dim_address(tables(spark, sf_dir))


@register("v_title_address")
def q_v_title_address(spark, sf_dir):
    return G.title_address(_dim_address(tables(spark, sf_dir)))


@register("title_360")
def q_title_360(spark, sf_dir):
    return G.title_360(tables(spark, sf_dir))


@register("title_search_wide")
def q_title_search_wide(spark, sf_dir):
    return _wide_json(G.title_search_wide(tables(spark, sf_dir)))


def _wide_json(w):
    return as_json(w, "estate_types", "estates", "instruments", "encumbrances", "prior_titles", "follow_on_titles",
                   "document_references")


@register("title_search_enriched")
def q_title_search_enriched(spark, sf_dir):
    t = tables(spark, sf_dir)
    e = G.title_search_enriched(G.title_search_core(t), t)
    return as_json(e, "parcel_ids")


@register("address_search_text")
def q_address_search_text(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.address_search_text(t.address_point, t.address_component, t.address_reference)


@register("address_search_table")
def q_address_search_table(spark, sf_dir):
    return G.address_search_table(_dim_address(tables(spark, sf_dir)))


@register("title_search_table")
def q_title_search_table(spark, sf_dir):
    return G.title_search_table(G.title_360(tables(spark, sf_dir)))


# Gold from text extracts that were landed and conformed to silver (P1 -> G), with the results of the same products above
def _conformed(spark, sf_dir):
    return ConformedTables(tables(spark, sf_dir))


@register("conformed_dim_title")
def q_conformed_dim_title(spark, sf_dir):
    t = _conformed(spark, sf_dir)
    return G.dim_title(t.title, t.land_district)


@register("conformed_dim_appellation")
def q_conformed_dim_appellation(spark, sf_dir):
    return G.dim_appellation(_conformed(spark, sf_dir).appellation)


@register("conformed_fact_title_estate")
def q_conformed_fact_title_estate(spark, sf_dir):
    t = _conformed(spark, sf_dir)
    return G.fact_title_estate(t.title_estate, t.estate_share, t.proprietor)


@register("conformed_fact_title_instrument")
def q_conformed_fact_title_instrument(spark, sf_dir):
    t = _conformed(spark, sf_dir)
    return G.fact_title_instrument(t.title_instrument_title, t.title_instrument, t.transaction_type)


@register("conformed_v_title_appellation")
def q_conformed_v_title_appellation(spark, sf_dir):
    t = _conformed(spark, sf_dir)
    return G.title_appellation(t.title_parcel_association, t.appellation)


@register("conformed_v_title_legal")
def q_conformed_v_title_legal(spark, sf_dir):
    t = _conformed(spark, sf_dir)
    return G.title_legal(t.legal_description, t.legal_description_parcel)


@register("conformed_address_search_table")
def q_conformed_address_search_table(spark, sf_dir):
    return G.address_search_table(_dim_address(_conformed(spark, sf_dir)))


@register("conformed_address_search_text")
def q_conformed_address_search_text(spark, sf_dir):
    t = _conformed(spark, sf_dir)
    return G.address_search_text(t.address_point, t.address_component, t.address_reference)


@register("conformed_title_search_table")
def q_conformed_title_search_table(spark, sf_dir):
    return G.title_search_table(G.title_360(_conformed(spark, sf_dir)))


@register("conformed_title_search_wide")
def q_conformed_title_search_wide(spark, sf_dir):
    return _wide_json(G.title_search_wide(_conformed(spark, sf_dir)))


@register("rpt_instrument_activity")
def q_rpt_instrument_activity(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.rpt_instrument_activity(t.title_instrument, t.title_instrument_title, t.transaction_type)


@register("rpt_active_encumbrances")
def q_rpt_active_encumbrances(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.rpt_active_encumbrances(t.title_encumbrance, t.title, t.encumbrance, t.encumbrancee)


@register("rpt_estate_by_district")
def q_rpt_estate_by_district(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.rpt_estate_by_district(t.title_estate, t.title, t.land_district)


@register("rpt_instrument_status")
def q_rpt_instrument_status(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.rpt_instrument_status(t.title_instrument, t.transaction_type)


@register("union_all_counts")
def q_union_all_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    d = _dim_address(t)
    views = {
        "DIM_TITLE": G.dim_title(t.title, t.land_district),
        "DIM_APPELLATION": G.dim_appellation(t.appellation),
        "BRIDGE_TITLE_PARCEL": G.bridge_title_parcel(t.title_parcel_association),
        "FACT_TITLE_ESTATE": G.fact_title_estate(t.title_estate, t.estate_share, t.proprietor),
        "FACT_TITLE_INSTRUMENT": G.fact_title_instrument(t.title_instrument_title, t.title_instrument,
                                                         t.transaction_type),
        "FACT_TITLE_ENCUMBRANCE": G.fact_title_encumbrance(t.title_encumbrance, t.encumbrance, t.encumbrancee,
                                                           t.encumbrance_share),
        "V_TITLE_LINEAGE": G.title_lineage(t.title_hierarchy, t.title),
        "V_TITLE_APPELLATION": G.title_appellation(t.title_parcel_association, t.appellation),
        "V_TITLE_LEGAL": G.title_legal(t.legal_description, t.legal_description_parcel),
        "DIM_ADDRESS": d,
        "V_TITLE_ADDRESS": G.title_address(d),
        "RPT_INSTRUMENT_ACTIVITY": G.rpt_instrument_activity(t.title_instrument, t.title_instrument_title,
                                                             t.transaction_type),
        "RPT_ACTIVE_ENCUMBRANCES": G.rpt_active_encumbrances(t.title_encumbrance, t.title, t.encumbrance,
                                                             t.encumbrancee),
        "RPT_ESTATE_BY_LAND_DISTRICT": G.rpt_estate_by_district(t.title_estate, t.title, t.land_district),
        "RPT_INSTRUMENT_STATUS": G.rpt_instrument_status(t.title_instrument, t.transaction_type),
    }
    return O.union_counts(views)


# ---------------------------------------------------------------------------
# Q: search and detail queries (request tables derived from the data)
# ---------------------------------------------------------------------------
def _search_tbl(spark, sf_dir):
    return G.title_search_table(G.title_360(tables(spark, sf_dir)))


def _fact_ti(t):
    return G.fact_title_instrument(t.title_instrument_title, t.title_instrument, t.transaction_type)


@register("title_search")
def q_title_search(spark, sf_dir):
    return S.title_search(_search_tbl(spark, sf_dir), "Building", "latest_lodged_date", "desc", 25, 10)


@register("address_search")
def q_address_search(spark, sf_dir):
    tbl = G.address_search_table(_dim_address(tables(spark, sf_dir)))
    return S.address_search(tbl, "20A Āhuri Road", 50, 0)


@register("title_detail")
def q_title_detail(spark, sf_dir):
    t = tables(spark, sf_dir)
    req = t.title_encumbrance.select(F.col("ttl_title_no").alias("title_no"))
    return S.title_detail(_search_tbl(spark, sf_dir), req)


@register("title_instruments")
def q_title_instruments(spark, sf_dir):
    t = tables(spark, sf_dir)
    return S.title_instruments(_fact_ti(t), t.title.select("title_no"))


@register("title_encumbrances")
def q_title_encumbrances(spark, sf_dir):
    t = tables(spark, sf_dir)
    fact = G.fact_title_encumbrance(t.title_encumbrance, t.encumbrance, t.encumbrancee, t.encumbrance_share)
    return S.title_encumbrances(fact, t.title.select("title_no"))


@register("title_addresses")
def q_title_addresses(spark, sf_dir):
    t = tables(spark, sf_dir)
    tbl = G.address_search_table(_dim_address(t))
    return S.title_addresses(tbl, t.title.select("title_no"))


@register("instrument_search")
def q_instrument_search(spark, sf_dir):
    t = tables(spark, sf_dir)
    return as_json(S.instrument_search(_fact_ti(t), "Prom", 500), "title_nos")


@register("instrument_detail")
def q_instrument_detail(spark, sf_dir):
    t = tables(spark, sf_dir)
    return as_json(S.instrument_detail(_fact_ti(t), t.title_instrument.select("inst_no")), "title_nos")


# ---------------------------------------------------------------------------
# L: lineage
# ---------------------------------------------------------------------------
from tenura.plans import lineage as L  # noqa: E402


@register("lineage_depth")
def q_lineage_depth(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.lineage_depth(t.title, t.title_hierarchy)


@register("lineage_ancestors")
def q_lineage_ancestors(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.ancestors(t.title.select("title_no"), t.title_hierarchy, t.title)


@register("lineage_cycles")
def q_lineage_cycles(spark, sf_dir):
    """Titles on a cycle where lapsed links lead both ways and the others forward."""
    links = tables(spark, sf_dir).title_hierarchy.select("status", "ttl_title_no_prior", "ttl_title_no_flw")
    back = links.where("status <> 'CURR'").select(
        "status", F.col("ttl_title_no_flw").alias("ttl_title_no_prior"), F.col("ttl_title_no_prior").alias("ttl_title_no_flw"))
    return L.cycles(links.unionByName(back), edge_status=None)


@register("lineage_neighbours")
def q_lineage_neighbours(spark, sf_dir):
    t = tables(spark, sf_dir)
    lin = G.title_lineage(t.title_hierarchy, t.title)
    return L.neighbours(t.title.select("title_no"), lin, G.address_search_table(_dim_address(t)))


@register("lineage_ego_graph")
def q_lineage_ego_graph(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.ego_graph(t.title.select("title_no"), G.title_lineage(t.title_hierarchy, t.title))[0]


@register("lineage_ego_graph_edges")
def q_lineage_ego_graph_edges(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.ego_graph(t.title.select("title_no"), G.title_lineage(t.title_hierarchy, t.title))[1]


@register("lineage_adjacent_lists")
def q_lineage_adjacent_lists(spark, sf_dir):
    return as_json(L.adjacent_lists(tables(spark, sf_dir).title_hierarchy), "prior_titles", "follow_on_titles")


# ---------------------------------------------------------------------------
# D: data quality
# ---------------------------------------------------------------------------
from tenura.plans import conform as P  # noqa: E402
from tenura.plans import quality as D  # noqa: E402
from tenura.sources import landing as LD  # noqa: E402
from tenura.sources import manifest as M  # noqa: E402

ADAPTER_TABLES = ["title", "title_estate", "title_instrument", "title_instrument_title", "transaction_type",
                  "title_document_reference", "title_encumbrance", "encumbrance", "encumbrance_share",
                  "encumbrancee", "title_hierarchy", "title_parcel_association", "appellation", "legal_description",
                  "legal_description_parcel", "estate_share", "proprietor", "land_district", "address_point",
                  "address_component"]
# Silver tables the gold build requires.
REQUIRED_SILVER = ADAPTER_TABLES + ["statute", "statute_action", "statutory_action_parcel"]


def _adapter_dict(t, names=ADAPTER_TABLES):
    return {n: getattr(t, n) for n in names}


@register("dq_missing_tables")
def q_dq_missing_tables(spark, sf_dir):
    t = tables(spark, sf_dir)
    return D.require_tables(spark, REQUIRED_SILVER, D.present_tables(_adapter_dict(t)))


@register("dq_required_columns")
def q_dq_required_columns(spark, sf_dir):
    p = tables(spark, sf_dir).proprietor
    return D.column_completeness(p, ["id", "ets_id", "status", "type", "prime_surname", "prime_other_names",
                                     "name_suffix"])


KEY_TABLE_LABELS = {"SILVER.TITLE": "title", "SILVER.TITLE_ESTATE": "title_estate",
                    "SILVER.TITLE_INSTRUMENT": "title_instrument", "SILVER.TITLE_ENCUMBRANCE": "title_encumbrance",
                    "SILVER.TITLE_PARCEL_ASSOCIATION": "title_parcel_association", "SILVER.PROPRIETOR": "proprietor",
                    "SILVER.APPELLATION": "appellation"}


@register("dq_table_counts")
def q_dq_table_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    dfs = {label: getattr(t, n) for label, n in KEY_TABLE_LABELS.items()}
    dfs["GOLD.DIM_ADDRESS_SEARCH"] = G.address_search_table(_dim_address(t))
    return D.table_counts(dfs)


@register("dq_unique_key")
def q_dq_unique_key(spark, sf_dir):
    return D.duplicate_keys(tables(spark, sf_dir).title_parcel_association, ["par_id"])


@register("dq_nonzero")
def q_dq_nonzero(spark, sf_dir):
    t = tables(spark, sf_dir)
    counts = D.table_counts(_adapter_dict(t))
    req = spark.createDataFrame([(n,) for n in REQUIRED_SILVER], "table_name string")
    full = req.join(counts, "table_name", "left").select(
        "table_name", F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"))
    return D.empty_tables(full)


def _audit_history(t):
    e = t.raw("events")
    return e.groupBy(F.col("event_type").alias("table_name"), F.col("ts").cast("date").alias("extract_date")) \
            .agg(F.count(F.lit(1)).alias("row_count"))


@register("dq_count_drop")
def q_dq_count_drop(spark, sf_dir):
    return D.count_drops(_audit_history(tables(spark, sf_dir)), 20.0)


@register("dq_link_band")
def q_dq_link_band(spark, sf_dir):
    return D.link_band(tables(spark, sf_dir).title_instrument_title, "ttl_title_no", 1, 5)


@register("dq_gold_matches_base")
def q_dq_gold_matches_base(spark, sf_dir):
    t = tables(spark, sf_dir)
    return D.row_parity(G.title_search_core(t), t.title)


# ---------------------------------------------------------------------------
# P: conforming
# ---------------------------------------------------------------------------
def _bronze_title(t):
    ti = t.title
    return LD.land(ti.select("title_no", F.col("ldt_loc_id").cast("string").alias("ldt_loc_id"),
                             F.col("register_type").alias("register_t"),
                             F.date_format("issue_date", "yyyyMMdd").alias("issue_date"),
                             F.col("guarantee_status").alias("guarantee_"), "status", "type"))


@register("conform_table")
def q_conform_table(spark, sf_dir):
    return P.conform(_bronze_title(tables(spark, sf_dir)), "title")


def _dirty_lineitem(t):
    li = t.raw("lineitem")
    n = F.col("l_linenumber")
    ship = (F.when(n == 1, F.lit("00000000")).when(n == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
             .otherwise(F.date_format("l_shipdate", "yyyyMMdd")))
    qty = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".0"))
    return li.select("l_orderkey", "l_linenumber", qty.alias("qty"), F.col("l_returnflag").alias("flag"),
                     ship.alias("ship"))


@register("cast_lenient")
def q_cast_lenient(spark, sf_dir):
    d = _dirty_lineitem(tables(spark, sf_dir))
    return d.select("l_orderkey", "l_linenumber", P.to_long(F.col("qty")).alias("qty"),
                    P.to_long(F.col("flag")).alias("flag_long"), P.to_date_lenient(F.col("ship")).alias("ship_date"),
                    P.to_decimal(F.col("qty")).alias("qty_dec"))


@register("blank_to_null")
def q_blank_to_null(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    s = te.select("id", F.coalesce("share", F.lit("")).alias("share"))
    return s.select("id", P.blank_to_null(F.col("share")).alias("share"))


@register("flag_current")
def q_flag_current(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    return te.select("id", "status", FL.current_flag("status").alias("is_current"),
                     FL.current_flag("status", ("REGD",)).alias("is_current_strict"))


FLAGGED = ["title", "title_estate", "title_instrument", "title_hierarchy", "encumbrance", "title_encumbrance",
           "encumbrance_share"]


@register("flag_current_split")
def q_flag_current_split(spark, sf_dir):
    return D.flag_split(_adapter_dict(tables(spark, sf_dir), FLAGGED))


@register("dedupe_business")
def q_dedupe_business(spark, sf_dir):
    tit = tables(spark, sf_dir).title_instrument_title
    a = LD.stamp(tit, "title_instrument_title", "2024-01-31", "run-1", "chunk-1", F.lit("tit.dbf"))
    b = LD.stamp(tit, "title_instrument_title", "2024-01-31", "run-1", "chunk-2", F.lit("tit.2.dbf"))
    return P.dedupe(a.unionByName(b)).select("tin_id", "ttl_title_no")


ESTATE_TARGET = [("id", "bigint"), ("ttl_title_no", "string"), ("type", "string"), ("status", "string"),
                 ("share", "string")]


@register("evolve_schema")
def q_evolve_schema(spark, sf_dir):
    te = tables(spark, sf_dir).title_estate
    old = te.where(F.col("id") % 2 == 0).select("id", F.col("ttl_title_no").alias("ttl_title_"), "type", "status",
                                                F.lit(1).cast("bigint").alias("audit_id"))
    new = te.where(F.col("id") % 2 != 0).select("id", "ttl_title_no", "type", "status", "share")
    return P.union_aligned([P.align(old, ESTATE_TARGET, {"ttl_title_": "ttl_title_no"}),
                            P.align(new, ESTATE_TARGET)])


@register("reflag_update")
def q_reflag_update(spark, sf_dir):
    return P.reflag(tables(spark, sf_dir).title, ("LIVE",)).select("title_no", "status", "is_current")


def _code_target(t):
    ti = t.title
    a = ti.select(F.lit("TTLT").alias("code_group"), F.col("type").alias("code"))
    b = ti.select(F.lit("TTLS").alias("code_group"), F.col("status").alias("code"))
    return a.unionByName(b).distinct().withColumn("description", F.lit(None).cast("string"))


@register("upsert_codes")
def q_upsert_codes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return P.upsert_codes(_code_target(t), t.system_code)


@register("code_group_counts")
def q_code_group_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return P.code_group_counts(P.upsert_codes(_code_target(t), t.system_code))


# ---------------------------------------------------------------------------
# S: landing, provenance, manifests, audit
# ---------------------------------------------------------------------------
@register("decode_fields")
def q_decode_fields(spark, sf_dir):
    li = tables(spark, sf_dir).raw("lineitem")
    n = F.col("l_linenumber")
    raw = li.select(
        "l_orderkey", "l_linenumber",
        F.when(n == 7, F.lit("*****")).otherwise(F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 5, " "))
         .alias("qty"),
        F.when(n == 1, F.lit("00000000")).otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("shipped"),
        F.when(F.col("l_linestatus") == "O", F.lit("T")).otherwise(F.lit("n")).alias("open"),
        F.rpad("l_returnflag", 4, " ").alias("flag"))
    return LD.decode(raw, {"l_orderkey": "N", "l_linenumber": "N", "qty": "N", "shipped": "D", "open": "L",
                           "flag": "C"})


@register("land_strings")
def q_land_strings(spark, sf_dir):
    c = tables(spark, sf_dir).raw("conversations")
    return LD.land(c.select(F.col("conv_id").alias("CONV_ID"), F.col("turn").alias("Turn"), "role", "text"))


@register("stamp_provenance")
def q_stamp_provenance(spark, sf_dir):
    tit = tables(spark, sf_dir).title_instrument_title
    return LD.stamp(tit, "title_instrument_title", "2024-01-31", "run-1", source_file=F.lit("tit.dbf")) \
             .drop("ingested_at")


def _inventory(t):
    e = t.raw("events")
    return e.select(
        F.concat(F.lit("stage/registry-"), (F.col("user_id") % 40).cast("string"), F.lit("-"),
                 F.col("event_type"), F.lit(".dbf")).alias("relative_path"),
        F.when(F.col("user_id") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("user_id").cast("string")).alias("md5"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        F.col("ts").alias("last_modified"), F.col("ts").alias("snapshot_at"), "event_id")


@register("file_inventory_latest")
def q_file_inventory_latest(spark, sf_dir):
    return M.latest_files(_inventory(tables(spark, sf_dir)), tie="event_id").drop("event_id")


@register("register_new_files")
def q_register_new_files(spark, sf_dir):
    inv = _inventory(tables(spark, sf_dir))
    early = M.latest_files(inv.where(F.col("snapshot_at") < F.lit("2024-01-15").cast("timestamp")), tie="event_id")
    empty = early.limit(0).select(F.lit(None).cast("string").alias("source_entity"),
                                  F.lit(None).cast("string").alias("file_name"),
                                  F.lit(None).cast("bigint").alias("file_size"),
                                  F.lit(None).cast("string").alias("file_md5"),
                                  F.col("last_modified").alias("file_last_modified"))
    control = M.register_files(empty, early)
    return M.register_files(control, M.latest_files(inv, tie="event_id"))


def _file_names(t):
    e = t.raw("events")
    return e.select(F.concat(F.lit("registry-"), F.col("event_type"), F.lit("."),
                             F.col("user_id").cast("string"), F.lit(".dbf")).alias("file_name"), "ts")


@register("pick_shards_to_load")
def q_pick_shards_to_load(spark, sf_dir):
    f = _file_names(tables(spark, sf_dir))
    loaded = f.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp"))
    return M.pending(f.select("file_name").distinct(), loaded)


@register("audit_progress")
def q_audit_progress(spark, sf_dir):
    t = tables(spark, sf_dir)
    landed = LD.stamp(t.title_instrument_title, "title_instrument_title", "2024-01-31", "run-1",
                      source_file=F.lit("a")).unionByName(
        LD.stamp(t.title_parcel_association, "title_parcel_association", "2024-01-31", "run-1",
                 source_file=F.lit("b")), allowMissingColumns=True)
    expected = spark.createDataFrame([("run-1", n) for n in ("title_instrument_title", "title_parcel_association",
                                                             "statute")], "run_id string, source_table string")
    return M.load_summary(landed, expected).drop("started_at", "finished_at")


@register("audit_table_counts")
def q_audit_table_counts(spark, sf_dir):
    return D.table_counts(_adapter_dict(tables(spark, sf_dir)), "2024-01-31")


# ---------------------------------------------------------------------------
# File round trips (written under the shared checkpoint folder)
# ---------------------------------------------------------------------------
import uuid as _uuid  # noqa: E402

from tenura.session import checkpoint_dir, ship_package  # noqa: E402
from tenura.sources import csv_extract as CX  # noqa: E402
from tenura.sources import fixed_width as FW  # noqa: E402


def _scratch(spark, name: str) -> str:
    base = checkpoint_dir(spark).replace("file:", "")
    return f"{base.rstrip('/')}/tenura-{name}-{_uuid.uuid4().hex}"


# 10-character field names of the instrument extract -> silver names.
INSTRUMENT_RENAMES = {"lodged_dat": "lodged_date", "priority_n": "priority_no", "tin_id_par": "tin_id_parent"}


@register("scan_fixed_width")
def q_scan_fixed_width(spark, sf_dir):
    ti = tables(spark, sf_dir).title_instrument
    path = _scratch(spark, "dbf")
    FW.write_fixed_width(ti.repartition(4), path)
    raw = FW.read_fixed_width(spark, f"{path}/*.dbf", recordsPerPartition=256)
    typed = LD.decode(raw, FW.field_types(f"{path}/*.dbf"))
    return typed.withColumnsRenamed(INSTRUMENT_RENAMES)


@register("scan_shards")
def q_scan_shards(spark, sf_dir):
    tit = tables(spark, sf_dir).title_instrument_title
    path = _scratch(spark, "shards")
    FW.write_fixed_width(tit.repartition(3), path, mode="append", shardPrefix="title-instrument-title")
    raw = FW.read_fixed_width(spark, f"{path}/title-instrument-title-*.dbf", recordsPerPartition=8192,
                              includeSourceFile=True)
    typed = LD.decode(raw.drop("source_file"), {"tin_id": "N", "ttl_title_": "C"})
    return typed.withColumnsRenamed({"ttl_title_": "ttl_title_no"})


def _shared(spark, name: str) -> str:
    """A new folder for Spark's own writers: any URI."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tenura-{name}-{_uuid.uuid4().hex}"


def _csv_text(columns) -> F.Column:
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
              for c in columns]
    return F.concat_ws(",", *quoted)


def _estate_extract(spark, t) -> str:
    """The estates as CSV files in two column orders, with a quoted line break in ``purpose`` and one
    row in fifty without its last field."""
    te = t.title_estate.withColumn("purpose", F.concat(F.lit('line 1\nline "2", '), F.col("type")))
    path = _shared(spark, "csv")
    ship_package(spark)
    for half, cols in enumerate((("share", "status", "purpose", "ttl_title_no", "id", "type"),
                                 ("id", "purpose", "type", "ttl_title_no", "share", "status"))):
        header = ",".join("TTL_TITLE_" if c == "ttl_title_no" else c.upper() for c in cols)
        line = F.when(F.col("id") % 50 == 0, _csv_text(cols[:-1])).otherwise(_csv_text(cols))
        # by the value, so that the number of files follows the data
        lines = te.where(F.col("id") % 2 == half).select(line.alias("value")).repartition("value")
        lines.mapInArrow(lambda b, h=header: _with_first(b, h), "value string").write.text(f"{path}/{half}")
    return path


def _with_first(batches, header):
    """A file's header line before its rows."""
    import pyarrow as pa
    yield pa.RecordBatch.from_pydict({"value": [header]})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])


@register("read_csv_by_name")
def q_read_csv_by_name(spark, sf_dir):
    path = _estate_extract(spark, tables(spark, sf_dir))
    df = LD.read_extract_csv(spark, f"{path}/*", {"ttl_title_": "ttl_title_no"})
    return df.select(P.to_long(F.col("id")).alias("id"), "ttl_title_no", "type", "status", "share", "purpose")


@register("read_csv_rejects")
def q_read_csv_rejects(spark, sf_dir):
    path = _estate_extract(spark, tables(spark, sf_dir))
    bad = CX.read_csv_extract(spark, f"{path}/*").rejects
    return bad.select("header", "record")


class _Earlier:
    """The registry as it was before some changes: titles that are new since, changed since and gone
    since, another share of an estate, an encumbrance less and an older address."""

    def __init__(self, t):
        self._t = t

    def __getattr__(self, name):
        df = getattr(self._t, name)
        number = F.substring("title_no", 2, 20).cast("bigint") if name == "title" else None
        if name == "title":
            old = df.where(number % 11 != 0).withColumn("status", F.when(number % 7 == 0, "HIST").otherwise(F.col("status")))
            gone = df.where(number % 13 == 0).withColumn("title_no", F.concat(F.lit("G"), "title_no"))
            return old.withColumn("is_current", current_flag("status")).unionByName(gone)
        if name == "title_encumbrance":
            return df.where(F.col("id") % 17 != 0)
        if name == "title_estate":
            return df.withColumn("type", F.when(F.col("id") % 19 == 0, "LEAS").otherwise(F.col("type")))
        if name == "address_component":
            return df.withColumn("component_value", F.when((F.col("address_id") % 23 == 0) & (
                F.col("component_type") == "Address Number"), "1").otherwise(F.col("component_value")))
        return df


@register("refresh_search_table")
def q_refresh_search_table(spark, sf_dir):
    """K3: the search table of an earlier state, then brought up to date for the changed titles only."""
    now = tables(spark, sf_dir)
    then = _Earlier(now)
    path = _shared(spark, "search-table")
    IN.materialise(G.title_360(then), path, "title_no", 8, G.title_search_table)
    IN.refresh_changed(spark, path, "title_no", 8, IN.changed_titles(then, now),
                       lambda keys: G.title_360(IN.OfTitles(now, keys)), G.title_search_table)
    return IN.read_materialised(spark, path)


@register("layout_clustered")
def q_layout_clustered(spark, sf_dir):
    """K1: instruments clustered by lodged date and priority, and read by either."""
    path = _shared(spark, "clustered")
    K.z_ordered_write(tables(spark, sf_dir).title_instrument, ["lodged_date", "priority_no"], path, n_files=8)
    back = spark.read.parquet(path)
    early = back.where(F.col("lodged_date") < F.lit("1993-01-01").cast("date")).select(F.lit("early").alias("pick"), "id", "inst_no")
    first = back.where(F.col("priority_no") <= 5).select(F.lit("first").alias("pick"), "id", "inst_no")
    return early.unionByName(first)


@register("reflag_files")
def q_reflag_files(spark, sf_dir):
    """P8 on a stored table: only the files whose flags change are rewritten."""
    path = _shared(spark, "titles")
    t = tables(spark, sf_dir).title.select("title_no", "status", "is_current")
    t.repartitionByRange(8, "status", "title_no").write.parquet(path)
    IN.reflag_files(spark, path, ("LIVE",))
    return spark.read.parquet(path)


@register("upsert_code_files")
def q_upsert_code_files(spark, sf_dir):
    """P9 on a stored table: files with a missing description are rewritten, new codes are added."""
    t = tables(spark, sf_dir)
    path = _shared(spark, "codes")
    _code_target(t).repartition(4, "code_group").write.parquet(path)
    IN.upsert_code_files(spark, path, t.system_code)
    return spark.read.parquet(path)


@register("search_batch")
def q_search_batch(spark, sf_dir):
    t = tables(spark, sf_dir)
    req = t.raw("nation").select(F.col("n_nationkey").alias("req_id"), F.col("n_name").alias("q"))
    # the search table is a materialised table (K3); build it once, then search it.
    # Only the columns the search reads and returns are materialised, so the
    # branches that feed other columns are pruned from the build.
    checkpoint_dir(spark)
    cols = ["title_no", "is_current", "issue_date", "primary_address", *S.TITLE_NORM_COLUMNS]
    tbl = _search_tbl(spark, sf_dir).select(*cols).checkpoint(eager=True)
    out = S.search_batch(req, tbl, k=10)
    return out.select("req_id", "title_no", "is_current", "issue_date", "primary_address")
