"""Conformed keys: computed once, below no NULL test of a join; filler values with and without a trim."""

from pyspark.sql import functions as F

from tenura.operators.joins import settled
from tenura.plans.queries import QUERIES
from tenura.sources.landing import clean_value

SF = "/root/testdata/sf0.001"


def test_a_join_does_not_write_out_a_conformed_key_again(spark):
    plan = QUERIES["conformed_fact_title_estate"](spark, SF)._jdf.queryExecution().executedPlan()
    nodes, filters = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.inputPlan())
        if node.nodeName() == "Filter":
            filters.append(node.condition().sql())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert any("ISNOTNULL" in x.upper().replace(" ", "") or "IS NOT NULL" in x.upper() for x in filters)
    assert not [x for x in filters if "RLIKE" in x.upper()]


def test_settled_keeps_rows_values_types_and_order_of_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, None), (1, None, "a"), (2, 5, "b")], "x long, y int, z string")
    out = settled(df, ["y", "x"])
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert out.where(F.col("x").isNotNull()).count() == 3
    assert settled(df, []) is df


def test_filler_is_judged_as_a_whole(spark):
    rows = [("***", None), ("*a*", "*a*"), ("a*", "a*"), ("* *", "* *"), (" ** ", None), ("\x00\x00", None),
            ("\x00a", "\x00a"), ("*\x00", "*\x00"), ("", None), ("\t\n", None), (None, None), (" x ", "x")]
    df = spark.createDataFrame(rows, "v string, want string")
    assert [r for r in df.select("v", "want", clean_value(F.col("v")).alias("got")).collect() if r.got != r.want] == []
