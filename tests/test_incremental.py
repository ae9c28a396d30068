import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenura.plans import conform as P
from tenura.plans import gold as G
from tenura.plans import incremental as IN
from tenura.plans import layout as K
from tenura.sources.adapters import RegistryTables

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# -- K1 ---------------------------------------------------------------------
def ranges(path, column):
    out = []
    for f in glob.glob(f"{path}/part-*"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return out


def hit(path, column, lo, hi):
    return sum(a <= hi and b >= lo for a, b in ranges(path, column))


def test_a_range_of_either_column_touches_few_files(spark, tmp_path):
    df = spark.range(20_000).selectExpr("(id * 7919) % 20000 as a", "(id * 104729) % 20000 as b", "id")
    z, plain = str(tmp_path / "z"), str(tmp_path / "plain")
    K.z_ordered_write(df, ["a", "b"], z, n_files=64)
    K.cluster_write(df, ["a", "b"], plain, n_files=64)
    assert bag(spark.read.parquet(z)) == bag(df)
    for column in ("a", "b"):
        assert hit(z, column, 500, 900) <= 20                     # about one row or column of an 8 x 8 grid
    assert hit(plain, "a", 500, 900) <= 4 and hit(plain, "b", 500, 900) > 50


def test_z_order_of_nulls_text_dates_and_one_hot_value(spark, tmp_path):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as a", "if(id % 5 = 0, null, concat('k', id % 40)) as b",
                                      "date_add(date'2020-01-01', cast(id % 400 as int)) as c")
    path = str(tmp_path / "z")
    K.z_ordered_write(df, ["a", "b", "c"], path, n_files=8, bits=5)
    assert bag(spark.read.parquet(path)) == bag(df)
    assert 4 <= len(glob.glob(f"{path}/part-*")) <= 8
    K.z_ordered_write(df.limit(0), ["a"], str(tmp_path / "none"), n_files=2)
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        K.z_key({c: [1] for c in "abcdefgh"}, 8)


def test_z_key_interleaves_ranks(spark):
    bounds = {"a": [1, 2, 3], "b": [1, 2, 3]}
    df = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "a int, b int")
    got = {(r.a, r.b): r.z for r in df.select("a", "b", K.z_key(bounds, 2).alias("z")).collect()}
    assert got == {(x, y): sum(((x >> i & 1) << (2 * i + 1)) | ((y >> i & 1) << (2 * i)) for i in range(2))
                   for x in range(4) for y in range(4)}


# -- K3 ---------------------------------------------------------------------
def test_refresh_rewrites_only_the_buckets_of_changed_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    before = spark.range(400).selectExpr("concat('T', id) as k", "id as v")
    IN.materialise(before, path, "k", 16)
    old = files(path)
    after = (before.where("v not in (5, 6)").withColumn("v", F.when(F.col("v") == 9, -9).otherwise(F.col("v")))
             .unionByName(spark.createDataFrame([("T900", 900), (None, 1)], "k string, v long")))
    changed = IN.changed_keys(before, after, "k")
    assert sorted(str(r.k) for r in changed.collect()) == ["None", "T5", "T6", "T9", "T900"]
    keys = changed.withColumnRenamed("k", "key")
    done = IN.refresh_changed(spark, path, "k", 16, changed,
                              lambda ks: after.join(ks.withColumnRenamed("k", "c"), F.col("k").eqNullSafe(F.col("c")), "left_semi"))
    assert keys.count() == 5 and 1 <= len(done) <= 5
    assert bag(IN.read_materialised(spark, path)) == bag(after)
    same = [f for f, t in files(path).items() if old.get(f) == t]
    assert len(same) == 16 - len(done)
    assert IN.refresh_changed(spark, path, "k", 16, changed.limit(0), lambda ks: after.limit(0)) == []


def test_a_bucket_that_loses_every_row(spark, tmp_path):
    path = str(tmp_path / "t")
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v long")
    IN.materialise(before, path, "k", 64)
    after = before.where("k <> 'b'")
    IN.refresh_changed(spark, path, "k", 64, IN.changed_keys(before, after, "k"), lambda ks: after.join(ks, "k", "left_semi"))
    assert bag(IN.read_materialised(spark, path)) == bag(after)


class Changed:
    """The registry with one table replaced."""

    def __init__(self, t, **tables):
        self.t, self.tables = t, tables

    def __getattr__(self, name):
        return self.tables[name] if name in self.tables else getattr(self.t, name)


@pytest.mark.parametrize("table", ["title", "title_instrument", "proprietor", "address_component", "title_parcel_association"])
def test_changed_titles_cover_every_row_that_differs(spark, table):
    """A value and a lost row in each source table: titles outside the found ones have equal rows."""
    t = RegistryTables(spark, SF)
    df = getattr(t, table)
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in (
        "ttl_title_no", "title_no", "ttl_title_no_flw")][0]
    key = df.columns[0]
    mark = F.pmod(F.xxhash64(key), F.lit(10))
    now = Changed(t, **{table: df.where(mark != 3).withColumn(text, F.when(mark == 4, "other").otherwise(F.col(text)))})
    full = {s: {r.title_no: str(r) for r in G.title_360(x).collect()} for s, x in (("before", t), ("after", now))}
    found = {r.title_no for r in IN.changed_titles(t, now).collect()}
    differ = {k for s in full.values() for k in s if full["before"].get(k) != full["after"].get(k)}
    assert differ <= found and differ
    keys = spark.createDataFrame([(k,) for k in sorted(found)], "title_no string")
    part = {r.title_no: str(r) for r in G.title_360(IN.OfTitles(now, keys)).collect()}
    assert part == {k: v for k, v in full["after"].items() if k in found}


def test_columns_outside_the_search_table_change_no_title(spark):
    """What is not compared cannot matter: the table is the same with those columns blanked."""
    t = RegistryTables(spark, SF)
    blank = {n: getattr(t, n).select(*[F.col(f.name) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name)
                                       for f in getattr(t, n).schema.fields]) for n, cols in IN.SEARCH_COLUMNS.items()}
    assert bag(G.title_search_table(G.title_360(Changed(t, **blank)))) == bag(G.title_search_table(G.title_360(t)))
    other = t.title_estate.withColumn("purpose", F.lit("other"))
    assert IN.changed_titles(t, Changed(t, title_estate=other)).isEmpty()


def test_refresh_leaves_no_second_copy(spark, tmp_path):
    from tenura.session import checkpoint_dir
    path, shared = str(tmp_path / "t"), checkpoint_dir(spark).replace("file:", "")
    before = spark.range(400).selectExpr("concat('T', id) as k", "id as v")
    IN.materialise(before, path, "k", 4)
    after = before.withColumn("v", F.when(F.col("v") == 9, -9).otherwise(F.col("v")))
    old = set(glob.glob(f"{shared}/refresh-*"))
    IN.refresh_changed(spark, path, "k", 4, IN.changed_keys(before, after, "k"), lambda ks: after.join(ks, "k", "left_semi"))
    assert bag(IN.read_materialised(spark, path)) == bag(after)
    assert set(glob.glob(f"{shared}/refresh-*")) == old and not glob.glob(f"{path}/_rewrite*")


# -- P8 / P9 ----------------------------------------------------------------
def test_reflag_rewrites_only_files_with_a_changed_flag(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(300).selectExpr("id", "case when id < 100 then 'LIVE' when id < 200 then 'REGD' else null end as status",
                                     "id < 200 as is_current")
    df.repartitionByRange(6, "id").write.parquet(path)
    old = files(path)
    done = IN.reflag_files(spark, path, ("LIVE",))
    new = files(path)
    assert bag(spark.read.parquet(path)) == bag(P.reflag(df, ("LIVE",)))
    assert {f: t for f, t in old.items() if f in new} == {f: t for f, t in new.items() if f in old}
    assert len([f for f in old if f in new]) == 6 - len(done) and 2 <= len(done) <= 3
    assert IN.reflag_files(spark, path, ("LIVE",)) == [] and files(path) == new
    assert not glob.glob(f"{path}/_rewrite*")


def test_upsert_rewrites_only_files_with_a_missing_description(spark, tmp_path):
    path = str(tmp_path / "t")
    target = spark.createDataFrame([("A", "1", "kept"), ("A", "2", None), ("B", "1", "x"), ("B", "9", None), ("C", "1", "y")],
                                   "code_group string, code string, description string")
    seed = spark.createDataFrame([("A", "1", "new"), ("A", "2", "filled"), ("D", "1", "added"), ("B", "9", None)],
                                 "code_group string, code string, description string")
    target.repartitionByRange(3, "code_group").write.parquet(path)
    old = files(path)
    done = IN.upsert_code_files(spark, path, seed)
    assert bag(spark.read.parquet(path)) == bag(P.upsert_codes(target, seed))
    new = files(path)
    assert len(done) == 1 and len([f for f in old if f in new]) == len(old) - 1
    assert IN.upsert_code_files(spark, path, seed) == [] and files(path) == new
