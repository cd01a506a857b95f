import pytest

from seqloom.sources import signal_lines as sl

SCHEMA = "line_id long, fmt string, n_declared int, raw_line string, reason string, signal int, other string"


def lines(spark, rows):
    return spark.createDataFrame([(i, f, n, t, "clash", 1, "x") for i, (f, n, t) in enumerate(rows)], SCHEMA)


CASES = [
    ("tsv", 2, "r1\t1\t2.5", None),
    ("tsv", 2, "﻿r1\t+1.\t.5e1 \r", None),
    ("tsv", 2, "r1\t1", "columns"),
    ("tsv", 2, "r 1\t1\tx", "id"),
    ("tsv", 2, "r1\t1\t400.5", "value"),
    ("tsv", 2, "r1\t1\t", "value"),
    ("tsv", 2, '"r1"\t1\t2', "id"),
    ("tsv", 2, "x" * 65 + "\t1\t2", "id"),
    ("tsv", 2, "r1\t1\t1e", "value"),
    ("tsv", 2, "r1\t1\t٣", "value"),
    ("tsv", None, "r1\t1\t2", "columns"),
    ("csv", 2, 'r1,1,"2"', None),
    ("csv", 2, '"r""1",1,2', "id"),
    ("csv", 2, 'r1,1,"2', "quoting"),
    ("csv", 2, 'r1,1,"2"x', "quoting"),
    ("csv", 2, 'r1,1,2"', "quoting"),
    ("csv", 2, '"a,b",1,2', "id"),
    ("csv", 2, ",1,2", "id"),
    ("csv", 2, "r1,,2", "value"),
    ("slow5", 9, "r1\t0\t8192\t-3\t1e3\t4000\t2\t5,-4096", None),
    ("slow5", 9, "r1\t0\t8192\t-3\t1e3\t4000\t+02\t5,6", None),
    ("slow5", 9, "r1\t0\t8192\t-3\t1e3\t4000\t3\t5,6", "columns"),
    ("slow5", 9, "r1\t0\t8192\t-3\t1e3\t4000\t2.0\t5,6", "value"),
    ("slow5", 9, "r1\t0\t8192\tx\t1e3\t4000\t2\t5,6", "value"),
    ("slow5", 9, "r1\t0\t8192\t-3\t1e3\t4000\t2\t5,4096", "value"),
    ("slow5", 9, "r1\t0\t8192\t-3\t1e3\t4000\t2", "columns"),
    ("bam", 2, "r1", "columns"),
    (None, 2, "r1", "columns"),
    ("tsv", 2, None, "skip"),
    ("tsv", 2, "", "skip"),
    ("tsv", 2, " \t \r", "skip"),
    ("csv", 2, "# note", "skip"),
    ("csv", 2, "@note", "skip"),
    ("slow5", 2, "read_id\tread_group", "skip"),
    ("tsv", 1, "read_id\t5", None),
]


def test_reasons(spark):
    df = lines(spark, [c[:3] for c in CASES])
    failed = {r["line_id"]: r["reason"] for r in sl.failed_lines(df).collect()}
    loaded = {r["line_id"] for r in sl.loaded_reads(df).collect()}
    for i, (_, _, text, want) in enumerate(CASES):
        assert failed.get(i) == (want if want != "skip" else None), (i, text, failed.get(i), want)
        assert (i in loaded) == (want is None), (i, text)


def test_values_and_other_columns(spark):
    row = sl.loaded_reads(lines(spark, [("csv", 2, '"r1", 1 ,2e1')])).first()
    assert row["read_id"] == "r1" and row["signal"] == [1.0, 20.0] and row["other"] == "x"


def test_long_lines_and_duplicates(spark):
    n = 60_000
    good = '"r1",' + ",".join(["1"] * n)
    rows = [("csv", n, good), ("csv", n, good[:-1] + "x"), ("csv", 2, '"' + "a" * 300_000)]
    df = lines(spark, rows)
    df = df.unionByName(df)
    assert sorted(r["reason"] for r in sl.failed_lines(df.dropDuplicates(["line_id"])).collect()) == ["quoting", "value"]
    assert sl.loaded_reads(df).count() == 2


def test_empty(spark):
    assert sl.failed_lines(lines(spark, []).limit(0)).count() == 0 == sl.loaded_reads(lines(spark, []).limit(0)).count()


def test_null_ids_are_judged_by_content(spark):
    df = spark.createDataFrame([(None, "tsv", 1, "r\t1"), (None, "tsv", 1, "r\tx")], "line_id long, fmt string, n_declared int, raw_line string")
    assert [r["reason"] for r in sl.failed_lines(df).collect()] == ["value"]
    assert sl.loaded_reads(df).count() == 1


@pytest.mark.parametrize("fmt", ["tsv", "csv"])
def test_cells_keep_their_place(spark, fmt):
    sep = {"tsv": "\t", "csv": ","}[fmt]
    bad = sl.cell_errors(sl.parse_lines(lines(spark, [(fmt, 3, sep.join(["r", "1", "x", "500"]))]))).collect()
    assert sorted((r["_sl_col"], r["_sl_value"]) for r in bad) == [(2, "x"), (3, "500")]
