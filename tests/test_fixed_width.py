"""Fixed-width record files: hand-written bytes for every edge case of FIXTURES §1.2."""
import struct

import pytest

from tenura.sources import fixed_width as FW
from tenura.sources.landing import decode

FIELDS = [("ID", "N", 6), ("NAME", "C", 8), ("LODGED_DAT", "D", 8), ("OK", "L", 1)]


def dbf_bytes(records, fields=FIELDS, count=None, truncate_last=0, eof=True):
    header_size = 32 + 32 * len(fields) + 1
    rsize = 1 + sum(f[2] for f in fields)
    n = len(records) if count is None else count
    out = bytearray(struct.pack("<B3xIHH20x", 3, n, header_size, rsize))
    for name, code, ln in fields:
        out += name.encode().ljust(11, b"\x00") + code.encode() + b"\x00" * 4 + bytes([ln]) + b"\x00" * 15
    out += b"\x0d"
    for deleted, vals in records:
        rec = (b"*" if deleted else b" ") + b"".join(v.ljust(ln, b" ")[:ln] for v, (_, _, ln) in zip(vals, fields))
        out += rec
    if truncate_last:
        out = out[:-truncate_last]
    elif eof:
        out += b"\x1a"
    return bytes(out)


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def read(spark, path, **opts):
    df = FW.read_fixed_width(spark, path, **opts)
    return df, decode(df, FW.field_types(path))


def test_layout_and_decoding(spark, tmp_path):
    recs = [(False, [b"1", b"alpha", b"20200131", b"T"]),
            (True, [b"2", b"deleted", b"20200101", b"T"]),        # deleted record
            (False, [b"******", b"", b"00000000", b"N"]),          # '*' number, blank string, open date
            (False, [b"3.0", b"caf\xc3\xa9", b"19991231", b"?"])]
    p = write(tmp_path, "t.dbf", dbf_bytes(recs))
    lay = FW.read_layout(p)
    assert (lay.n_records, lay.record_size, [f.name for f in lay.fields]) == (4, 24, ["id", "name", "lodged_dat", "ok"])
    raw, typed = read(spark, p)
    rows = sorted(typed.collect(), key=lambda r: (r.id is None, r.id))
    assert [r.id for r in rows] == [1, 3, None]
    assert rows[0].name == "alpha" and str(rows[0].lodged_dat) == "2020-01-31" and rows[0].ok is True
    assert rows[2].name is None and rows[2].lodged_dat is None and rows[2].ok is False
    assert rows[1].name == "café" and rows[1].ok is False


def test_short_last_record_and_zero_records(spark, tmp_path):
    recs = [(False, [b"1", b"a", b"20200101", b"T"]), (False, [b"2", b"b", b"20200102", b"F"])]
    p = write(tmp_path, "short.dbf", dbf_bytes(recs, truncate_last=5))     # last record cut off
    assert FW.read_layout(p).n_records == 1
    assert read(spark, p)[0].count() == 1
    z = write(tmp_path, "zero.dbf", dbf_bytes([]))
    assert read(spark, z)[0].count() == 0


def test_undecodable_bytes_policies(spark, tmp_path):
    p = write(tmp_path, "bad.dbf", dbf_bytes([(False, [b"1", b"ab\xffcd", b"20200101", b"T"])]))
    assert read(spark, p, errors="replace")[0].first().name == "ab�cd"
    assert read(spark, p, errors="ignore")[0].first().name == "abcd"


def test_two_shards_and_record_ranges(spark, tmp_path):
    a = [(False, [str(i).encode(), b"x", b"20200101", b"T"]) for i in range(10)]
    b = [(False, [str(i).encode(), b"y", b"20200101", b"F"]) for i in range(10, 25)]
    write(tmp_path, "title.dbf", dbf_bytes(a))
    write(tmp_path, "title.2.dbf", dbf_bytes(b))
    df = FW.read_fixed_width(spark, str(tmp_path / "title*.dbf"), recordsPerPartition=4, includeSourceFile=True)
    assert df.rdd.getNumPartitions() == 3 + 4
    assert df.count() == 25
    assert df.select("source_file").distinct().count() == 2


def test_end_marker_ends_the_file_whatever_the_ranges(spark, tmp_path):
    recs = [(False, [str(i).encode(), b"x", b"20200101", b"T"]) for i in range(6)]
    data = bytearray(dbf_bytes(recs))
    data[32 + 32 * len(FIELDS) + 1 + 2 * 24] = 0x1A                 # flag of the third record
    p = write(tmp_path, "cut.dbf", bytes(data))
    write(tmp_path, "whole.dbf", dbf_bytes(recs))
    for per in (1, 2, 100):
        df = FW.read_fixed_width(spark, p, recordsPerPartition=per)
        assert sorted(r["id"] for r in df.collect()) == ["0", "1"]
        assert FW.read_fixed_width(spark, str(tmp_path), recordsPerPartition=per).count() == 2 + 6
    FW.register(spark)
    assert spark.read.format("dbf").option("recordsPerPartition", 2).load(p).count() == 2


def test_long_names_that_clash_when_cut(spark, tmp_path):
    df = spark.createDataFrame([("A", "B", "C", "D")], "ttl_title_no_prior string, ttl_title_no_flw string, "
                                                       "ttl_titl_1 string, x string")
    out = str(tmp_path / "w")
    FW.write_fixed_width(df, out)
    back = FW.read_fixed_width(spark, out)
    assert back.columns == ["ttl_title_", "ttl_titl_2", "ttl_titl_1", "x"]
    assert tuple(back.first()) == ("A", "B", "C", "D")
    assert back.select("ttl_titl_2").first()[0] == "B"
    with pytest.raises(Exception, match="differ in case only"):
        FW.header_names(["a", "A"])
    bad = write(tmp_path, "twice.dbf", dbf_bytes([], fields=[("A", "C", 3), ("A", "C", 3)]))
    with pytest.raises(ValueError, match="more than once"):
        FW.read_layout(bad)


def test_writer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", i % 2 == 0) for i in range(100)], "id long, name string, ok boolean")
    out = str(tmp_path / "w")
    FW.register(spark)
    df.repartition(4).write.format("dbf").mode("overwrite").save(out)
    back = decode(FW.read_fixed_width(spark, out + "/*.dbf"), FW.field_types(out + "/*.dbf"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FW.expand_paths(str(tmp_path / "nothing*.dbf"))


def test_read_through_uri_glob_and_directory(spark, tmp_path):
    df = spark.range(0, 300, numPartitions=3).selectExpr("id", "concat('n', cast(id as string)) as name")
    out = str(tmp_path / "shards")
    df.write.format("dbf").mode("overwrite").save(out)
    paths = FW.expand_paths("file://" + out + "/part-*.dbf")
    assert len(paths) == 3 and all(p.startswith("file://") for p in paths) and paths == sorted(paths)
    for spec in ("file://" + out + "/part-*.dbf", out):
        back = FW.read_fixed_width(spark, spec)
        assert back.count() == 300
        assert sorted(int(r["id"]) for r in back.select("id").collect()) == list(range(300))


def test_vectorised_field_decode_equals_python_decode():
    import random

    import numpy as np

    from tenura.sources.fixed_width import _decode_field
    rnd = random.Random(3)
    alphabet = [b"a", b"Z", b"1", b" ", b"\t", b"\x00", b"\x1c", b"\xc4\x81", b"*", b"\r"]
    for trial in range(30):
        length = rnd.randint(1, 9)
        vals = []
        for _ in range(50):
            v = b"".join(rnd.choice(alphabet) for _ in range(length))[:length]
            vals.append(v.ljust(length, b" "))
        if trial % 5 == 0:
            vals[7] = (b"\xff" + vals[7])[:length]          # not UTF-8: the per-value path
        cells = np.frombuffer(b"".join(vals), dtype=np.uint8).reshape(len(vals), length)
        want = [v.decode("utf-8", "replace").strip() for v in cells.view(f"S{length}").ravel().tolist()]
        assert _decode_field(cells, "utf-8", "replace").to_pylist() == want
        want_l1 = [v.decode("latin-1").strip() for v in cells.view(f"S{length}").ravel().tolist()]
        assert _decode_field(cells, "latin-1", "replace").to_pylist() == want_l1


def test_streaming_writer_with_measured_widths(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal
    rows = [(1, "Ānaru", dt.date(2020, 1, 5), True, Decimal("12.5000"), 1e-05, dt.datetime(2020, 1, 5, 10, 30, 0, 100000)),
            (22, "lee", None, False, Decimal("-3.2500"), 123456.75, None),
            (333, None, dt.date(1999, 12, 31), None, None, None, dt.datetime(2021, 2, 3))]
    df = spark.createDataFrame(rows, "id long, name string, d date, ok boolean, amt decimal(20,4), f double, ts timestamp")
    a, b = str(tmp_path / "measured"), str(tmp_path / "in_memory")
    FW.write_fixed_width(df.repartition(2), a)
    df.repartition(2).write.format("dbf").mode("overwrite").save(b)
    got_a = sorted(tuple(r) for r in FW.read_fixed_width(spark, a).collect())
    got_b = sorted(tuple(r) for r in FW.read_fixed_width(spark, b).collect())
    assert got_a == got_b and len(got_a) == 3
    assert ("1", "Ānaru", "20200105", "T", "12.5000", "1e-05", "2020-01-05 10:30:00.100000") in got_a


def test_extract_to_silver_in_one_job(spark, tmp_path):
    import datetime as dt

    from tenura.plans.ingest import ingest_extract
    cols = ["title_no", "ldt_loc_id", "register_t", "ste_id", "issue_date", "guarantee_", "status", "type",
            "provisiona", "sur_wrk_id", "ttl_title_", "ttl_titl_1", "maori_land", "audit_id"]
    a = ("CB1/1", "3", "FREE", "12", "20200105", "GURT", "LIVE", "FHOL", "N", "7", "", "", "N", "99")
    b = ("CB1/2", "3", "LEAS", "*****", "00000000", "", "HIST", "LEHI", "N", "8", "CB1/1", "", "", "100")
    schema = ", ".join(f"{c} string" for c in cols)
    shards = str(tmp_path / "title")
    FW.write_fixed_width(spark.createDataFrame([a, b], schema).coalesce(1), shards, shardPrefix="title-1")
    FW.write_fixed_width(spark.createDataFrame([a], schema).coalesce(1), shards, mode="append",
                         shardPrefix="title-2")                 # the same row again, in another shard
    out = ingest_extract(spark, shards + "/title-*.dbf", "title", str(tmp_path / "silver"), "2024-01-31", "run-1")
    rows = {r["title_no"]: r for r in out.collect()}
    assert sorted(rows) == ["CB1/1", "CB1/2"]                   # copies across shards collapse
    r1, r2 = rows["CB1/1"], rows["CB1/2"]
    assert (r1["ldt_loc_id"], r1["issue_date"], r1["is_current"], r1["ttl_title_no_srs"]) == \
           (3, dt.date(2020, 1, 5), True, None)
    assert (r2["ste_id"], r2["issue_date"], r2["is_current"], r2["guarantee_status"], r2["ttl_title_no_srs"]) == \
           (None, None, False, None, "CB1/1")
    assert r1["source_extract_date"] == dt.date(2024, 1, 31) and r1["run_id"] == "run-1"
    assert r2["source_file"].endswith("title-1-00000.dbf")


def test_writer_refuses_values_longer_than_a_field(spark, tmp_path):
    df = spark.createDataFrame([("x" * 300,)], "v string")
    with pytest.raises(Exception, match="longer than their fixed-width field"):
        FW.write_fixed_width(df, str(tmp_path / "a"))
    with pytest.raises(Exception, match="longer than their fixed-width field"):
        df.write.format("dbf").mode("overwrite").save(str(tmp_path / "b"))
