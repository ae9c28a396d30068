"""What the title products shuffle: lineitem once, rows rather than lists of one, wide rows once."""
import re

import pytest
from pyspark.sql import functions as F

from tenura.plans import gold as G
from tenura.plans import incremental as IN
from tenura.sources.adapters import ConformedTables, RegistryTables

SF = "/root/testdata/sf0.001"


def bag(df):
    return sorted(map(str, df.collect()))


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def exchanged(df):
    """(exchange, node below it) of the plan as it was made."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(a, b) for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning" in a]


# -- one exchange of lineitem -------------------------------------------------
@pytest.mark.parametrize("product", [G.title_360, G.title_search_core])
def test_views_of_lineitem_read_one_exchange(spark, product):
    plan = final_plan(product(RegistryTables(spark, SF)))
    assert len([x for x in plan.split("\n") if "FileScan parquet" in x and "l_suppkey" in x]) == 1


LINES = [(1, 5, 7, 1, "N", "O"), (1, 5, 7, 2, "A", "F"), (1, 5, 7, None, None, "O"), (1, 6, 7, 3, "R", "O"), (1, 6, 7, 5, None, "O"),
         (2, 5, 7, None, "N", None), (2, 5, 8, 4, "X", "O"), (None, 5, 7, 2, "A", "O"), (None, 5, 7, 1, "N", "O"), (3, None, 7, 1, "A", "O"),
         (3, None, None, 1, "A", "O"), (3, None, None, 2, "N", "F")]


class Lines(RegistryTables):
    def raw(self, name):
        assert name == "lineitem"
        return self.spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                                 "l_returnflag string, l_linestatus string").repartition(4)


def test_views_of_lineitem_against_their_definition(spark):
    t = Lines(spark, "")
    groups = {}
    for o, p, s, n, flag, status in LINES:
        groups.setdefault((o, p, s), []).append(({"A": "FSIM", "N": "LEAS"}.get(flag, "QQQQ"), "REGD" if status == "O" else "HIST",
                                                 n is not None and n % 2 == 0))

    def title(o):
        return None if o is None else f"T{o}"
    want = [(title(o), o, min(x[0] for x in g), min(x[1] for x in g), "1/2" if any(x[2] for x in g) else None)
            for (o, p, s), g in groups.items()]
    te = t.title_estate
    assert bag(te.select("ttl_title_no", "lgd_id", "type", "status", "share")) == bag(spark.createDataFrame(
        want, "ttl_title_no string, lgd_id long, type string, status string, share string"))
    assert te.where("id = 100005007").count() == 1
    assert te.where("is_current").count() == sum(x[3] == "REGD" for x in want)
    tit = {(r.tin_id, r.ttl_title_no) for r in t.title_instrument_title.collect()}
    assert tit == {(p, title(o)) for o, p, *_ in LINES} and t.title_instrument_title.count() == len(tit)
    # the distinct rows of the full definition
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    want = t.raw("lineitem").select(
        (o * 100000 + s).alias("id"),
        F.when(o % 2 == 0, F.concat(F.lit("T"), o.cast("string"))).otherwise(F.concat(F.lit("X"), o.cast("string"))).alias("ttl_title_no"),
        s.alias("enc_id"), F.when((o + s) % 3 == 0, "HIST").otherwise("REGD").alias("status"),
        (s * 7).alias("act_tin_id_crt"), F.when(o % 4 == 0, o).alias("act_id_crt")).distinct()
    assert bag(t.title_encumbrance.drop("is_current")) == bag(want)


def test_estates_already_dealt_by_title_are_not_dealt_again(spark):
    te = RegistryTables(spark, SF).title_estate
    plan = te.repartition("ttl_title_no").groupBy("ttl_title_no").agg(F.max("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# -- rows, not lists of one ---------------------------------------------------
def test_owners_are_shuffled_as_rows(spark):
    assert not [b for _, b in exchanged(G.title_360(RegistryTables(spark, SF))) if "partial_collect_list" in b]


def test_labels_of_360_are_not_shuffled(spark):
    found = exchanged(G.title_360(RegistryTables(spark, SF)))
    assert not [b for _, b in found if re.search("title_status_desc|guarantee_status_desc", b)]


@pytest.mark.parametrize("tables", [RegistryTables, lambda s, d: ConformedTables(RegistryTables(s, d))])
def test_wide_tables_shuffle_rows(spark, tables):
    found = exchanged(G.title_search_wide(tables(spark, SF)))
    assert found and not [b for _, b in found if "partial_collect_list(struct" in b]


def test_enriched_reads_its_children_once(spark):
    t = RegistryTables(spark, SF)
    e = G.title_search_enriched(spark.createDataFrame([("T1", "x")], "title_no string, search_text string"), t)
    assert not [b for _, b in exchanged(e) if "collect_set" in b and "par_id" not in b]
    plan = final_plan(e)
    # legal descriptions and appellations feed a text and a preview each
    assert len([x for x in plan.split("\n") if "FileScan parquet [c_custkey" in x]) == 1


# -- wide rows once -----------------------------------------------------------
def test_estates_meet_their_shares_and_proprietors_in_one_shuffle(spark):
    te = spark.createDataFrame([(1, "T1"), (2, "T1"), (3, "T2"), (None, "T3")], "id long, ttl_title_no string") \
        .withColumns({c: F.lit("x") for c in ("type", "status", "share")}).withColumn("is_current", F.lit(True))
    es = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (None, 2), (30, None)], "id long, ett_id long") \
        .withColumns({"share": F.lit("1/1"), "is_current": F.lit(True)})
    p = spark.createDataFrame([(100, 10), (101, 10), (102, None), (103, 30), (104, 99)], "id long, ets_id long") \
        .withColumns({c: F.lit("y") for c in ("type", "prime_surname", "prime_other_names", "name_suffix", "status")})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = G.fact_title_estate(te, es, p)
        keys = [re.search(r"hashpartitioning\((\w+)#", a).group(1) for a, _ in exchanged(out)]
        got = sorted((tuple(r) for r in out.select("title_no", "title_estate_id", "estate_share_id", "proprietor_id").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted([("T1", 1, 10, 100), ("T1", 1, 10, 101), ("T1", 1, 11, None), ("T1", 2, 20, None), ("T1", 2, None, None),
                          ("T2", 3, None, None), ("T3", None, None, None)], key=str)
    assert sorted(keys) == sorted(["id", "__ett", "estate_share_id", "__ets"])
    below = [b for a, b in exchanged(out) if "hashpartitioning(estate_share_id" in a]
    assert below and not [b for b in below if "SortMergeJoin" in b or "ttl_title_no" in b]


def test_refresh_shuffles_stored_rows_once_and_no_derived_columns(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    before = spark.range(300).selectExpr("concat('T', id) as k", "id as v").unionByName(
        spark.createDataFrame([(None, 1), (None, 2)], "k string, v long"))
    after = (before.where("v not in (5, 6)").withColumn("v", F.when(F.col("k").isNull(), F.col("v") + 1).otherwise(F.col("v")))
             .unionByName(spark.createDataFrame([("T900", 900)], "k string, v long")))

    def derive(df):
        return df.withColumn("d", F.concat_ws("-", "k", F.col("v").cast("string")))
    written, real = [], IN._write
    monkeypatch.setattr(IN, "_write", lambda df, *a: written.append(df) or real(df, *a))
    IN.materialise(before, path, "k", 8, derive)
    assert bag(IN.read_materialised(spark, path)) == bag(derive(before))
    IN.refresh_changed(spark, path, "k", 8, IN.changed_keys(before, after, "k"),
                       lambda ks: after.join(ks.withColumnRenamed("k", "c"), F.col("k").eqNullSafe(F.col("c")), "left_semi"), derive)
    assert bag(IN.read_materialised(spark, path)) == bag(derive(after))
    assert len(written) == 2 and not [df for df in written if "d" in df.columns]
    assert "LeftAnti" not in written[1]._jdf.queryExecution().optimizedPlan().toString()
