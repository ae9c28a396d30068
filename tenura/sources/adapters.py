"""Registry-shaped views over the driver's TPC-H style tables.

The registry operators never hard-code table names; they take DataFrames.  These
adapters give the driver's parquet tables the shapes of the registry's silver
tables (title, estate, instrument, link, hierarchy, ...) so every operator can
be run and checked at any scale factor.  The mapping is a test fixture: each
view is a plain projection / aggregate / join, so Catalyst prunes columns and
pushes filters into the parquet scans.  Every view keeps all rows of its table;
where an operator needs rows that find no partner, their key is one that matches
nothing (a negative number, a title number that begins with X).

Every table with a ``status`` column also carries the silver ``is_current``
flag (``status IN ('LIVE', 'REGD')``, NULL status -> false).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.codes import system_code_df
from tenura.operators.filters import current_flag
from tenura.operators.joins import settled
from tenura.plans.conform import SILVER_SPECS, conform
from tenura.sources.landing import land

_T = "T"


def _title_key(col) -> F.Column:
    return F.concat(F.lit(_T), col.cast("string"))


def _no_title(col) -> F.Column:
    """A title number that no title has."""
    return F.concat(F.lit("X"), col.cast("string"))


def _known(key: F.Column, known: F.Column) -> F.Column:
    """``key`` where ``known``, else a key that matches nothing."""
    return F.when(known, key).otherwise(-key - 1)


class RegistryTables:
    """Lazily built registry views for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- title side ---------------------------------------------------------
    @cached_property
    def title(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        prio = F.substring("o_orderpriority", 1, 1)
        df = o.join(c, o.o_custkey == c.c_custkey).select(
            _title_key(F.col("o_orderkey")).alias("title_no"),
            F.col("c_nationkey").cast("bigint").alias("ldt_loc_id"),
            F.when(F.col("o_orderstatus") == "O", "LIVE")
             .when(F.col("o_orderstatus") == "P", "REGD").otherwise("HIST").alias("status"),
            F.when(prio == "1", "FHOL").when(prio == "2", "LEHI").when(prio == "3", "UNIT")
             .when(prio == "4", "ZZZZ").otherwise("MORI").alias("type"),
            F.when(F.col("o_orderkey") % 3 == 0, "FREE").otherwise("LEAS").alias("register_type"),
            F.col("o_orderdate").cast("date").alias("issue_date"),
            F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string"))
             .otherwise("GURT").alias("guarantee_status"),
            F.when(F.col("o_orderkey") % 8 == 0, "Y").otherwise("N").alias("provisional"),
            F.when(F.col("o_orderkey") % 7 == 0, F.lit("Y")).alias("maori_land"),
            (F.col("o_custkey") % 50).alias("ste_id"),
            F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey")).alias("sur_wrk_id"),
            F.when(F.col("o_orderkey") % 10 == 3, _title_key(F.col("o_orderkey") + 1)).alias("ttl_title_no_srs"),
            F.when(F.col("o_orderkey") % 10 == 3, _title_key(F.col("o_orderkey") - 3)).alias("ttl_title_no_head_srs"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def _lines(self) -> DataFrame:
        """The keys of lineitem's rows and what a title estate takes from them, dealt by title in one
        exchange that all views of lineitem read: no view's columns or filters get below it, as the
        columns come out of a generator and no filter passes one that is not deterministic."""
        key = _title_key(F.col("l_orderkey"))
        # a bit for each value seen, so that min() and max() of several codes are one bit_or
        seen = (F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
                + F.when(F.col("l_linestatus") == "O", 0).otherwise(4)
                + F.when(F.col("l_linenumber") % 2 == 0, 8).otherwise(0)).cast("tinyint")
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", seen.alias("seen")).repartition(key)
        return settled(li.withColumn("title_no", key).where(F.spark_partition_id() >= 0),
                       ["l_orderkey", "l_partkey", "l_suppkey", "seen"])

    @cached_property
    def title_estate(self) -> DataFrame:
        # min() over the code strings, of the codes seen (FSIM < LEAS < QQQQ, HIST < REGD)
        df = self._lines.groupBy("title_no", "l_orderkey", "l_partkey", "l_suppkey").agg(
            F.bit_or("seen").alias("seen"),
        ).select(
            (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000
             + F.col("l_suppkey") % 1000).alias("id"),
            F.col("title_no").alias("ttl_title_no"),
            F.when(F.col("seen").bitwiseAND(1) != 0, "FSIM")
             .when(F.col("seen").bitwiseAND(2) != 0, "LEAS").otherwise("QQQQ").alias("type"),
            F.when(F.col("seen").bitwiseAND(4) != 0, "HIST").otherwise("REGD").alias("status"),
            F.when(F.col("seen").bitwiseAND(8) != 0, F.lit("1/2")).alias("share"),
            F.col("l_orderkey").alias("lgd_id"),
            F.when(F.col("l_partkey") % 10 == 0, (F.col("l_partkey") % 52 + 1).cast("string")).alias("timeshare_week_no"),
            F.when(F.col("l_partkey") % 6 == 0, F.lit("Road reserve"))
             .when(F.col("l_partkey") % 6 == 1, F.lit("Recreation")).alias("purpose"),
            F.when(F.col("l_suppkey") % 5 == 0, F.lit("21 years")).alias("term"),
            F.when(F.col("l_partkey") % 2 == 0, "Y").otherwise("N").alias("original_flag"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def title_instrument(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_type", "p_size")
        li = self.raw("lineitem").select("l_partkey", "l_shipdate")
        first_ship = li.groupBy("l_partkey").agg(F.min("l_shipdate").alias("first_ship"))
        df = p.join(first_ship, p.p_partkey == first_ship.l_partkey, "left").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("I"), F.col("p_partkey").cast("string")).alias("inst_no"),
            F.lit("TINT").alias("trt_grp"),
            F.substring("p_type", 1, 4).alias("trt_type"),
            F.when(F.col("p_size") % 4 == 0, "HIST").otherwise("REGD").alias("status"),
            F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("date"))
             .otherwise(F.col("first_ship").cast("date")).alias("lodged_date"),
            F.col("p_size").alias("priority_no"),
            F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 1).alias("tin_id_parent"),
            (F.col("p_partkey") * 2).alias("dlg_id"),
            (F.col("p_partkey") % 25).alias("ldt_loc_id"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def title_instrument_title(self) -> DataFrame:
        return self._lines.select(F.col("l_partkey").alias("tin_id"), F.col("title_no").alias("ttl_title_no")).distinct()

    @cached_property
    def transaction_type(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.lit("TINT").alias("grp"),
            F.when(F.col("p_type") == "SMALL", "none").otherwise(F.substring("p_type", 1, 4)).alias("type"),
            F.col("p_type").alias("description"),
        ).distinct()

    @cached_property
    def title_document_reference(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            (F.col("p_partkey") * 10).alias("id"),
            _known(F.col("p_partkey"), F.col("p_partkey") % 7 == 0).alias("tin_id"),
            F.col("p_brand").alias("type"),
            F.col("p_name").alias("reference"),
        )

    # -- encumbrances -------------------------------------------------------
    @cached_property
    def title_encumbrance(self) -> DataFrame:
        # all columns follow from the order and the supplier
        li = self._lines.select("title_no", "l_orderkey", "l_suppkey").distinct()
        df = li.select(
            (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("id"),
            F.when(F.col("l_orderkey") % 2 == 0, F.col("title_no"))
             .otherwise(_no_title(F.col("l_orderkey"))).alias("ttl_title_no"),
            F.col("l_suppkey").alias("enc_id"),
            F.when((F.col("l_orderkey") + F.col("l_suppkey")) % 3 == 0, "HIST")
             .otherwise("REGD").alias("status"),
            (F.col("l_suppkey") * 7).alias("act_tin_id_crt"),
            F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey")).alias("act_id_crt"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def encumbrance(self) -> DataFrame:
        s = self.raw("supplier")
        df = s.select(
            F.col("s_suppkey").alias("id"),
            F.when(F.col("s_acctbal") < 0, "HIST").otherwise("REGD").alias("status"),
            F.when(F.col("s_suppkey") % 2 == 0, F.lit("99 years")).alias("term"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def encumbrance_share(self) -> DataFrame:
        # three shares per encumbrance, numbered 0 to 2
        s = self.raw("supplier").select("s_suppkey")
        df = s.select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")).select(
            (F.col("s_suppkey") * 10 + F.col("n")).alias("id"),
            F.col("s_suppkey").alias("enc_id"),
            F.when(F.col("n") % 2 == 0, "REGD").otherwise("HIST").alias("status"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def encumbrancee(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("id"),
            _known(F.col("s_suppkey"), F.col("s_suppkey") % 3 != 0).alias("ens_id"),
            F.lit("REGD").alias("status"),
            F.col("s_name").alias("name"),
        )

    # -- lineage ------------------------------------------------------------
    @cached_property
    def title_hierarchy(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey")
        k = F.col("o_orderkey")
        # key 0 would be its own prior title; its edge has none
        first = o.select(
            (k * 2).alias("id"),
            F.when(k % 13 == 0, "HIST").otherwise("CURR").alias("status"),
            F.when(k > 0, _title_key(F.floor(k / 2).cast("bigint"))).alias("ttl_title_no_prior"),
            _title_key(k).alias("ttl_title_no_flw"),
            (k * 3).alias("tdr_id"),
        )
        second = o.where((k > 0) & (k % 11 == 0)).select(         # a second edge of some titles
            (k * 2 + 1).alias("id"),
            F.lit("CURR").alias("status"),
            _title_key(F.floor(k / 3).cast("bigint")).alias("ttl_title_no_prior"),
            _title_key(k).alias("ttl_title_no_flw"),
            F.lit(None).cast("bigint").alias("tdr_id"),
        )
        return first.unionByName(second).withColumn("is_current", current_flag("status"))

    # -- parcels, appellations, legal descriptions --------------------------
    @cached_property
    def title_parcel_association(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderkey") % 4 != 0, _title_key(F.col("o_orderkey")))
             .otherwise(_no_title(F.col("o_orderkey"))).alias("ttl_title_no"),
            F.col("o_custkey").alias("par_id"),
            F.lit("LINK").alias("source"),
        )

    @cached_property
    def appellation(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        df = c.select(
            k.alias("id"),
            k.alias("par_id"),
            F.when(k % 5 == 0, "N").otherwise("Y").alias("title_flag"),
            F.when(k % 6 == 0, "HIST").otherwise("CURR").alias("status"),
            F.lit("LOT").alias("parcel_type"),
            k.cast("string").alias("parcel_value"),
            F.concat(F.lit("DP "), (k % 97).cast("string")).alias("appellation_value"),
            F.when(k % 9 == 0, F.lit("II")).alias("block_number"),
            F.when(k % 2 == 0, "GNRL").otherwise("OTHR").alias("type"),
            F.when(k % 3 == 0, "N").otherwise("Y").alias("survey_flag"),
            F.when(k % 4 == 0, "PART").otherwise("WHOL").alias("part_indicator"),
            F.when(k % 10 == 0, F.lit("UNIT")).alias("second_parcel_type"),
            F.when(k % 10 == 0, (k % 30).cast("string")).alias("second_prcl_value"),
            F.when(k % 2 == 0, F.lit("DP")).alias("sub_type"),
            F.when(k % 2 == 0, F.lit("PREFIX")).alias("sub_type_position"),
            F.when(k % 25 == 0, F.lit("Te Ākau")).alias("maori_name"),
            F.when(k % 50 == 0, "Y").otherwise("N").alias("height_limited"),
            F.when(k % 2 == 1, F.concat(F.lit("Block "), k.cast("string"))).alias("other_appellation"),
        )
        return df

    @cached_property
    def legal_description(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("id"),
            F.when(k % 2 == 0, _no_title(k)).when(k % 3 == 0, F.lit(None).cast("string"))
             .otherwise(_title_key(k)).alias("ttl_title_no"),
            F.lit("FSIM").alias("type"),
            F.lit("REGD").alias("status"),
            F.concat(F.lit("Lot "), F.col("o_custkey").cast("string")).alias("legal_desc_text"),
            F.col("o_totalprice").cast("decimal(20,4)").alias("total_area"),
        )

    @cached_property
    def legal_description_parcel(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("lgd_id"),
            F.col("o_custkey").alias("par_id"),
            F.lit(1).alias("sequence"),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("PART")).alias("part_affected"),
            F.when(F.col("o_orderkey") % 4 == 0, F.lit("1/2")).alias("share"),
            F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") + 1).alias("sur_wrk_id"),
        )

    # -- ownership ----------------------------------------------------------
    @cached_property
    def estate_share(self) -> DataFrame:
        te = self.title_estate
        df = te.select(
            (F.col("id") * 10).alias("id"),
            _known(F.col("id"), F.col("id") % 3 != 0).alias("ett_id"),
            "status",
            F.lit("1/1").alias("share"),
            F.when(F.col("id") % 7 == 0, F.lit("EXEC")).alias("executorship"),
            F.when(F.col("id") % 11 == 0, F.lit("Memorial")).alias("share_memorial"),
        )
        return df.withColumn("is_current", current_flag("status"))

    @cached_property
    def proprietor(self) -> DataFrame:
        es = self.estate_share.select("id", "ett_id", "status").alias("es")
        te = self.title_estate.select("id", "ttl_title_no").alias("te")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
        # orders meet their customers first, so that the many shares are not shuffled by customer
        oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        j = (es.join(te, F.col("es.ett_id") == F.col("te.id"))
               .join(oc, F.col("te.ttl_title_no") == _title_key(F.col("o_orderkey"))))
        ck = F.col("c_custkey")
        return j.select(
            (F.col("es.id") + ck % 2).alias("id"),
            F.col("es.id").alias("ets_id"),
            F.when(F.col("es.id") % 70 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("es.status")).alias("status"),
            F.when(ck % 3 == 0, "CORP").when(ck % 3 == 1, "INDV").otherwise("OTHR").alias("type"),
            F.col("c_name").alias("prime_surname"),
            F.col("c_mktsegment").alias("prime_other_names"),
            F.when(ck % 2 == 0, F.lit("JR")).alias("name_suffix"),
        )

    @cached_property
    def land_district(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(
            _known(F.col("n_nationkey").cast("bigint"), F.col("n_nationkey") < 20).alias("ldt_loc_id"),
            F.col("n_name").alias("name"),
            F.substring("n_name", 1, 3).alias("abbrev"),
        )

    # -- addresses ----------------------------------------------------------
    @cached_property
    def address_point(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("address_id"),
            k.alias("parcel_id"),
            F.when(k % 8 == 0, "Retired").otherwise("Current").alias("status"),
            F.lit("Road").alias("address_class"),
            F.when(k % 2 == 0, "Y").otherwise("N").alias("primary_address"),
            F.when(k % 8 == 0, "Retired").otherwise("Current").alias("address_lifecycle_stage"),
            F.when(k % 3 == 0, F.lit("CENT")).alias("address_position_type"),
            F.when(k % 12 == 0, F.lit("ALT")).alias("alternative_address_type"),
            (k * 4).alias("addressable_object_id"),
        )

    @cached_property
    def address_reference(self) -> DataFrame:
        # an order of a customer refers to the customer's address
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("address_reference_id"),
            F.col("o_custkey").alias("address_id"),
            F.lit("Parcel").alias("reference_object_type"),
            F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("Ref "), F.col("o_orderkey").cast("string"))).alias("reference_value"),
        )

    @cached_property
    def address_component(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        k = F.col("c_custkey")

        def part(df, ctype, value, end):
            return df.select(k.alias("address_id"), F.lit(ctype).alias("component_type"),
                             value.alias("component_value"), end.alias("end_lifecycle"))

        n = self.raw("nation").select("n_nationkey", "n_name")
        parts = [
            part(c, "Address Number", (k % 200).cast("string"),
                 F.when(k % 17 == 0, "20200101").otherwise("00000000")),
            part(c.where(k % 4 == 0), "Address Number Suffix", F.lit("A"), F.lit("")),
            part(c.where(k % 9 == 0), "Address Number High", (k % 200 + 4).cast("string"), F.lit("")),
            part(c, "Road Name", F.when(k % 5 == 0, "ĀHURI").otherwise(F.col("c_mktsegment")),
                 F.lit(None).cast("string")),
            part(c, "Road Type Name", F.lit("ROAD"), F.lit("0000-00-00")),
            part(c.where(k % 11 == 0), "Unit Type", F.lit("FLAT"), F.lit("")),
            part(c.where(k % 22 == 0), "Unit Value", F.lit("2"), F.lit("")),
            part(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")),
                 "Suburb/Locality Name", F.col("n_name"), F.lit("")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # -- code list ----------------------------------------------------------
    @cached_property
    def system_code(self) -> DataFrame:
        return system_code_df(self.spark)


def to_extract(df: DataFrame, spec) -> DataFrame:
    """``df`` as an extract delivers it: text under the source names of ``spec``, dates as yyyyMMdd
    (none: zeros), no value of a blank-to-null column: blank.  Columns that ``df`` lacks are left out."""
    out = {}
    for target, source, kind in spec:
        if kind == "flag" or target not in df.columns or source in out:
            continue
        c = F.col(target).cast("string")
        if kind == "date":
            c = F.coalesce(F.date_format(target, "yyyyMMdd"), F.lit("00000000"))
        elif kind == "nstr":
            c = F.coalesce(c, F.lit(""))
        out[source] = c.alias(source)
    return df.select(*out.values())


class ConformedTables:
    """The tables of ``t`` taken the whole way: as text extracts, landed, and conformed to silver by
    their specs, so that gold is built from what an ingest writes."""

    def __init__(self, t):
        self._t = t

    def __getattr__(self, name: str) -> DataFrame:
        df = getattr(self._t, name)
        if name in SILVER_SPECS:
            numbers = [c for c, _, kind in SILVER_SPECS[name] if kind == "long" and c in df.columns]
            df = settled(conform(land(to_extract(df, SILVER_SPECS[name])), name), numbers)
        setattr(self, name, df)
        return df
