import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tenura.operators import aggregates as A
from tenura.plans import gold as G

D = dt.date


@pytest.mark.parametrize("default", ["1900-01-01", None])
def test_latest_key_orders_by_date_then_id(spark, default):
    rows = [(1, None, 5), (1, D(1, 1, 1), -(2**63)), (1, D(2020, 5, 1), 3), (1, D(2020, 5, 1), 2**63 - 1), (2, D(9999, 12, 31), -7),
            (2, D(2020, 1, 1), 9), (3, None, 4), (3, None, -4), (4, D(1899, 1, 1), 1), (4, None, 0)]
    df = spark.createDataFrame(rows, "k int, d date, i long")
    got = {r.k: r.i for r in df.groupBy("k").agg(F.max(A.latest_key("d", "i", default)).alias("x")).select(
        "k", A.key_tie("x").alias("i")).collect()}
    day = lambda d: D(1900, 1, 1) if d is None else d
    want = {}
    for k in (1, 2, 3, 4):
        mine = [(day(d), i) for kk, d, i in rows if kk == k and (default or d)]
        want[k] = max(mine)[1] if mine else None
    assert got == want


@pytest.mark.parametrize("latest", ["struct", "raw"])
def test_latest_instruments_against_a_plain_loop(spark, latest):
    rnd = random.Random(3)
    inst = [(i, f"I{i}", "G", rnd.choice("ab"), rnd.choice(["REGD", "LIVE", "HIST", None]), rnd.choice([None, D(2020, 1, rnd.randint(1, 3))]))
            for i in range(1, 41)]
    links = [(rnd.randint(0, 45), f"T{rnd.randint(0, 12)}") for _ in range(150)] + [(39, "T99"), (39, "T99")]
    ti = spark.createDataFrame(inst, "id long, inst_no string, trt_grp string, trt_type string, status string, lodged_date date")
    tit = spark.createDataFrame(links, "tin_id long, ttl_title_no string")
    tt = spark.createDataFrame([("G", "a", "kind a")], "grp string, type string, description string")
    got = {r.k: r for r in G.latest_instruments(tit, ti, tt, latest).collect()}
    by = {r[0]: r for r in inst}
    for title in {t for _, t in links}:
        mine = [by[i] for i, t in links if t == title and i in by]
        if not mine:
            assert title not in got
            continue
        r = got[title]
        assert r.instrument_count == len({m[0] for m in mine})
        assert r.registered_instrument_count == sum(m[4] in ("REGD", "LIVE") for m in mine)
        dated = [m for m in mine if m[5]]
        assert r.latest_lodged_date == max((m[5] for m in dated), default=None)
        pool = dated if latest == "raw" else mine
        best = max(pool, key=lambda m: (m[5] or D(1900, 1, 1), m[0]), default=None)
        assert r.tin_id == (best and best[0]) and r.inst_no == (best and best[1])
        assert r.transaction_type_desc == ("kind a" if best and best[3] == "a" else None)


def test_latest_instruments_aggregate_by_hash(spark):
    ti = spark.range(100).selectExpr("id", "concat('I', id) as inst_no", "'G' as trt_grp", "'a' as trt_type", "'REGD' as status",
                                     "date_add(date'2020-01-01', cast(id as int)) as lodged_date")
    tit = spark.range(1000).selectExpr("id % 100 as tin_id", "concat('T', id % 37) as ttl_title_no")
    tt = spark.createDataFrame([("G", "a", "kind a")], "grp string, type string, description string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = G.latest_instruments(tit, ti, tt)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        full = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortAggregate" not in plan and "Expand" not in plan and "HashAggregate" in plan
    # links and dates meet on the instrument, then titles: the pair needs no exchange of its own
    assert "hashpartitioning(__tin" in full and "hashpartitioning(__tin#" in full
    assert not any("hashpartitioning(__tin" in x and ", k#" in x for x in full.split("\n"))
