import pytest

from tenura.sources.csv_extract import read_csv_extract, reject_counts


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def rows(extract, *cols):
    return sorted((tuple(r) for r in extract.rows.select(*cols).collect()), key=str)


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    path = write(tmp_path / "x", a="ID,Name,Status\n1,ann,LIVE\n2,bob,HIST\n", b="status,id,name\nLIVE,3,cy\n",
                 c="id,name,extra\n4,di,more\n")
    e = read_csv_extract(spark, path)
    assert rows(e, "id", "name", "status", "extra") == [("1", "ann", "LIVE", None), ("2", "bob", "HIST", None),
                                                        ("3", "cy", "LIVE", None), ("4", "di", None, "more")]
    assert e.rejects.count() == 0
    one = read_csv_extract(spark, f"{path}/b.csv", {"NAME": "surname"})
    assert rows(one, "surname", "status") == [("cy", "LIVE")]
    assert one.rows.select("source_file").first()[0].endswith("/b.csv")


def test_quoted_line_breaks_quotes_and_null_spellings(spark, tmp_path):
    path = write(tmp_path / "x", a='id,note\n1,"two\nlines, ""quoted"""\n2,NULL\n3,null\n4,\n5,""\n')
    assert rows(read_csv_extract(spark, path), "id", "note") == [
        ("1", 'two\nlines, "quoted"'), ("2", None), ("3", None), ("4", None), ("5", None)]


def test_rows_that_do_not_fit_their_header_are_kept_as_rejects(spark, tmp_path):
    path = write(tmp_path / "x", a="id,name,status\n1,ann,LIVE\n2,bob\n3,cy,HIST,more\n", b="name,id\nLee,4\n5\n")
    e = read_csv_extract(spark, path)
    assert rows(e, "id", "name", "status") == [("1", "ann", "LIVE"), ("4", "Lee", None)]
    bad = sorted((r.source_file.rsplit("/", 1)[1], r.header, r.record) for r in e.rejects.collect())
    assert bad == [("a.csv", "id,name,status", "2,bob"), ("a.csv", "id,name,status", "3,cy,HIST,more"), ("b.csv", "name,id", "5")]
    # the count does not depend on the columns that are asked for
    assert e.rows.select("id").count() == e.rows.count() == 2
    counts = {r.source_file.rsplit("/", 1)[1]: (r.rows_read, r.rows_rejected) for r in reject_counts(e).collect()}
    assert counts == {"a.csv": (3, 2), "b.csv": (2, 1)}


@pytest.mark.parametrize("multi_line", [True, False])
def test_timestamps_empty_files_and_headers_only(spark, tmp_path, multi_line):
    path = write(tmp_path / "x", a="id,at\n1,2024-01-02 03:04:05\n2,nonsense\n", b="", c="id,at\n")
    e = read_csv_extract(spark, path, timestamp_cols=("at",), multi_line=multi_line)
    got = {r.id: r["at"] and r["at"].isoformat() for r in e.rows.collect()}
    assert got == {"1": "2024-01-02T03:04:05", "2": None} and e.rejects.count() == 0


def test_a_folder_without_data_and_a_name_that_stands_twice(spark, tmp_path):
    e = read_csv_extract(spark, write(tmp_path / "x", a=""))
    assert e.rows.count() == e.rejects.count() == 0
    with pytest.raises(ValueError, match="twice"):
        read_csv_extract(spark, write(tmp_path / "y", a="id,x ,X\n1,2,3\n"))


def test_files_of_the_extract_query_follow_the_data(spark):
    """A file with quoted line breaks is one task, so a fixed number of files grows without bound."""
    from tenura.plans.queries import _estate_extract
    from tenura.sources.adapters import RegistryTables
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "1k")
    try:
        path = _estate_extract(spark, RegistryTables(spark, "/root/testdata/sf0.001"))
        files = spark.read.format("binaryFile").load(f"{path}/*").select("path").collect()
        assert len(files) > 8
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
