"""Hand-made rows for the conflict and edge cases (C-rows, FIXTURES §1.3)."""
import datetime as dt

from pyspark.sql import functions as F

from tenura.functions import text as X
from tenura.functions.codes import system_code_df
from tenura.operators import aggregates as A
from tenura.operators import filters as FL
from tenura.operators.joins import label_codes


def one(df):
    return [tuple(r) for r in df.collect()]


def test_street_number_suffix_and_range(spark):
    df = spark.createDataFrame([("43", None, "A"), ("43", "47", None), ("43", None, None), (None, "47", None)],
                               "n string, h string, s string")
    assert [r[0] for r in df.select(X.street_no("n", "h", "s")).collect()] == ["43A", "43/47", "43", None]


def test_party_name(spark):
    df = spark.createDataFrame([("INDV", "Jane", "Smith", None), ("CORP", "x", "Acme Ltd", "y"),
                                ("OTHR", "a", "b", "c"), ("INDV", None, "Smith", "Jr")],
                               "t string, o string, s string, x string")
    got = [r[0] for r in df.select(X.party_name("t", "o", "s", "x")).collect()]
    assert got == ["Jane Smith", "Acme Ltd", None, "Smith Jr"]          # C16: NULL parts skipped


def test_address_query_parse(spark):
    df = spark.createDataFrame([("43a orangi kaupapa road",), ("43 A Main",), ("main street",), ("12b  high st",)],
                               "q string")
    rows = df.select(X.parse_address_query("q").alias("p")).select("p.*").collect()
    assert (rows[0].num, rows[0].unit, rows[0].road, rows[0].road_name) == ("43", "a", "orangi kaupapa road",
                                                                           "orangi kaupapa")
    assert rows[0].spaced == "43 a orangi kaupapa road"
    assert (rows[1].num, rows[1].unit, rows[1].road_name) == ("43", "a", "main")      # single word kept
    assert rows[2].num is None and rows[2].road_name is None
    assert rows[3].road_name == "high"


def test_fold_text_macrons_precomposed_and_decomposed(spark):
    df = spark.createDataFrame([("ĀHURI Rōad",), ("Āhuri",)], "s string")
    assert [r[0] for r in df.select(X.fold_text("s")).collect()] == ["ahuri road", "ahuri"]


def test_valid_key(spark):
    df = spark.createDataFrame([("CT 123/45",), ("bad'quote",), ("",), ("x" * 101,), ("ok\n",)], "k string")
    assert [r[0] for r in df.select(X.valid_key("k")).collect()] == [True, False, False, False, True]


def test_split_list_and_join_parts(spark):
    df = spark.createDataFrame([("a,,b,",)], "s string")
    assert df.select(X.split_list("s")).first()[0] == ["a", "b"]
    df2 = spark.createDataFrame([(None, " ", None)], "a string, b string, c string")
    assert df2.select(X.join_parts(" ", "a", "b", "c")).first()[0] is None


def test_current_flag_null_status_is_false(spark):
    df = spark.createDataFrame([("LIVE",), ("REGD",), ("HIST",), (None,)], "s string")
    assert [r[0] for r in df.select(FL.current_flag("s")).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(FL.current_flag("s", ("LIVE",))).collect()] == [True, False, False, False]


def test_not_hist_drops_null(spark):
    df = spark.createDataFrame([("HIST",), ("REGD",), (None,)], "s string")
    assert df.where(FL.not_code("s", "HIST")).count() == 1                      # F3: 3-valued logic


def test_latest_instrument_tie_goes_to_larger_id(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("T1", 5, d), ("T1", 9, d), ("T1", 7, None), ("T2", 3, None)],
                               "t string, id int, d date")
    g = df.groupBy("t").agg(A.latest_by("id", "d", "id").alias("struct_form"),
                            A.latest_by_raw("id", "d", "id").alias("raw_form"))
    got = {r.t: (r.struct_form, r.raw_form) for r in g.collect()}
    assert got["T1"] == (9, 9)        # C3: same date -> larger tin_id
    assert got["T2"] == (3, None)     # NULL date: struct form -> 1900, raw form never wins


def test_primary_estate_type_without_current_estate(spark):
    df = spark.createDataFrame([("T1", "LEAS", False), ("T1", "FSIM", True), ("T2", "FSIM", False)],
                               "t string, type string, cur boolean")
    g = df.groupBy("t").agg(F.min(F.when(F.col("cur"), F.col("type"))).alias("p"))
    assert {r.t: r.p for r in g.collect()} == {"T1": "FSIM", "T2": None}


def test_missing_code_shows_raw_code(spark):
    df = spark.createDataFrame([("LIVE",), ("ZZZZ",)], "status string")
    out = label_codes(df, system_code_df(spark), {"status": "TTLS"})
    assert [r.status_desc for r in out.orderBy("status").collect()] == ["Live", "ZZZZ"]


def test_listagg_empty_is_null_and_sorted(spark):
    df = spark.createDataFrame([("T1", "b"), ("T1", "a"), ("T1", "a"), ("T2", None)], "t string, v string")
    g = df.groupBy("t").agg(A.list_distinct("v", ", ").alias("l"))
    assert {r.t: r.l for r in g.collect()} == {"T1": "a, b", "T2": None}   # C22


def test_preview_top_n(spark):
    rows = [("T1", f"v{i:02d}") for i in range(20)] + [("T2", "x")]
    df = spark.createDataFrame(rows, "t string, v string")
    got = {r.t: r.preview for r in A.preview(df, "t", "v", 3, " | ").collect()}
    assert got == {"T1": "v00 | v01 | v02", "T2": "x"}


def test_open_interval_spellings(spark):
    df = spark.createDataFrame([(None,), ("",), ("00000000",), ("0000-00-00",), ("20200101",)], "e string")
    assert df.where(FL.still_open("e")).count() == 4


def test_gated_casts_equal_the_plain_try_casts(spark):
    from tenura.plans import conform as P
    vals = ["12", "12.0", " 12 ", "+5", "-3.7", "1e3", "1E+2", ".5", "5.", "A", "", "12abc", "1.2.3",
            "99999999999999999999", "9223372036854775807", "9223372036854775808", "-0", "0x10", "NaN",
            "2020-01-05", "20200105", "00000000", "2020-02-30", "20200230", "2020-1-5", "12020-01-01",
            "2020-01-05 10:00", "junk", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    s = F.trim(F.col("v"))
    plain = df.select(
        "v",
        F.coalesce(s.try_cast("bigint"), s.try_cast("decimal(38,10)").try_cast("bigint")).alias("l"),
        s.try_cast("decimal(20,4)").alias("d"),
        F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "yyyyMMdd")).alias("t"))
    gated = df.select("v", P.to_long(F.col("v")).alias("l"), P.to_decimal(F.col("v")).alias("d"),
                      P.to_date_lenient(F.col("v")).alias("t"))
    assert sorted(map(tuple, gated.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_every_silver_spec_conforms_a_bronze_row(spark):
    import datetime as dt
    from decimal import Decimal

    from tenura.plans.conform import SILVER_SPECS, conform
    sample = {"str": "ABC", "nstr": "", "long": "42", "date": "20200105", "ts": "2020-01-05 10:30:00",
              "dec": "12.5", "flag": "LIVE"}
    expect = {"str": "ABC", "nstr": None, "long": 42, "date": dt.date(2020, 1, 5),
              "ts": dt.datetime(2020, 1, 5, 10, 30), "dec": Decimal("12.5000"), "flag": True}
    types = {"str": "string", "nstr": "string", "long": "bigint", "date": "date", "ts": "timestamp",
             "dec": "decimal(20,4)", "flag": "boolean"}
    for name, spec in SILVER_SPECS.items():
        src = {}
        for _, col, kind in spec:
            src.setdefault(col, sample["flag"] if any(k == "flag" and c == col for _, c, k in spec) else sample[kind])
        cols = sorted(src)
        bronze = spark.createDataFrame([tuple(src[c] for c in cols)], ", ".join(f"`{c}` string" for c in cols))
        out = conform(bronze, name)
        assert [f.name for f in out.schema] == [t for t, _, _ in spec], name
        assert [f.dataType.simpleString() for f in out.schema] == [types[k] for _, _, k in spec], name
        row = out.first()
        for tgt, col, kind in spec:
            if src[col] == sample[kind]:
                assert row[tgt] == expect[kind], (name, tgt)


def test_clean_value_equals_the_regex_form(spark):
    from tenura.sources.landing import clean_value
    vals = [" x ", "\t\nx\r ", "", "   ", "****", "\x00\x00", "a*", "* *", " ** ", "\x00 \x00", None, "x\x0b",
            "\x0c\x0c", "*\x00", " a b ", " x ", "**x**"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    ws = "[\\t\\n\\x0B\\f\\r ]"
    s = F.regexp_replace(F.col("v"), f"^{ws}+|{ws}+$", "")
    old = F.when((s == "") | s.rlike("^\\*+$") | s.rlike("^\\x00+$"), F.lit(None).cast("string")).otherwise(s)
    rows = df.select("v", old.alias("old"), clean_value(F.col("v")).alias("new")).collect()
    assert [(r.v, r.new) for r in rows] == [(r.v, r.old) for r in rows]
