"""Readers and sinks of bar tables."""

import pytest

from tidebar.sources.bars import has_columns, read_bars, write_table

HEAD = "UTC,Open,HIGH,low,Close,Volume\n"


def write(folder, text):
    (folder / "bars.csv").write_text(text)
    return str(folder / "bars.csv")


def test_odd_headers_bad_times_and_order(spark, tmp_path):
    rows = "2024-01-01 00:06:00,3,4,2,3.5,9\nnot a time,7,8,6,7,1\n2024-01-01 00:03:00,1,2,0.5,x,5\n,9,9,9,9,9\n"
    got = read_bars(spark, write(tmp_path, HEAD + rows), "s").orderBy("seq").collect()
    assert [(r["series_id"], r["seq"], r["open"], r["close"]) for r in got] == [("s", 0, 1.0, None), ("s", 1, 3.0, 3.5), ("s", 2, 7.0, 7.0), ("s", 3, 9.0, 9.0)]
    assert [r["ts"] is None for r in got] == [False, False, True, True] and got[0]["ts"].minute == 3


def test_without_times_the_order_of_the_file_stays(spark, tmp_path):
    got = read_bars(spark, write(tmp_path, "open,high,low,close,volume\n" + "".join(f"{i},1,1,1,1\n" for i in (5, 3, 9)))).orderBy("seq").collect()
    assert [r["open"] for r in got] == [5.0, 3.0, 9.0] and {r["ts"].year for r in got} == {1970} and [r["seq"] for r in got] == [0, 1, 2]
    assert read_bars(spark, write(tmp_path, HEAD)).count() == 0


def test_missing_columns_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="close"):
        read_bars(spark, write(tmp_path, "utc,open,high,low,volume\n1,1,1,1,1\n"))
    assert has_columns(spark, write(tmp_path, HEAD + "1,1,1,1,1,1\n"), "UTC", "Close") and not has_columns(spark, str(tmp_path / "bars.csv"), "missing")


def test_a_sink_keeps_what_is_there_if_told_so(spark, tmp_path):
    path = str(tmp_path / "out")
    write_table(spark.range(3), path)
    write_table(spark.range(5), path, if_exists="ignore")
    assert spark.read.parquet(path).count() == 3
    write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    write_table(spark.createDataFrame([(1, "a")], "x int, y string"), f"{path}.csv", "csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{path}.csv").collect()] == [("1", "a")]
