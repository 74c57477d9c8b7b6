"""Outputs read back byte for byte."""

import pytest
from pyspark.sql import functions as F

from orrerylake.jobs import sinks
from orrerylake.sources.image_files import ImageFiles


def test_grey_maps_of_every_band(spark, tmp_path):
    rows = [(i, b, k, s, None if (k, s) == (1, 1) else (i * 50 + b * 20 + k * 4 + s)) for i in (1, 2) for b in (0, 1) for k in range(3) for s in range(4)]
    cells = spark.createDataFrame(rows, "image int, band int, line int, sample int, byte int").repartition(5)
    sinks.write_grey_maps(cells, str(tmp_path / "out"), ["image"], "band", scaled=True)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["1_scaled_0.pgm", "1_scaled_1.pgm", "2_scaled_0.pgm", "2_scaled_1.pgm"]
    for i in (1, 2):
        for b in (0, 1):
            want = b"P5\n4 3\n255\n" + bytes(0 if (k, s) == (1, 1) else i * 50 + b * 20 + k * 4 + s for k in range(3) for s in range(4))
            assert (tmp_path / "out" / f"{i}_scaled_{b}.pgm").read_bytes() == want
    sinks.write_grey_maps(cells.where("band = 0").withColumn("product", F.lit("p")), f"file:{tmp_path}/more", ["product", "image"])
    assert sorted(p.name for p in (tmp_path / "more").iterdir()) == ["p_1.pgm", "p_2.pgm"]
    sinks.write_grey_maps(cells.limit(0), str(tmp_path / "none"), ["image"])
    assert not [p for p in (tmp_path / "none").glob("*")]


def test_failed_writes_leave_nothing(spark, tmp_path):
    spark.dataSource.register(ImageFiles)

    def write(rows):
        spark.createDataFrame(rows, "file string, content binary").coalesce(1).write.format("image_files").option("path", str(tmp_path / "o")).mode("append").save()

    for bad in ([("a", b"1"), ("b", b"2"), ("a", b"3")], [("x", b"1"), ("../y", b"2")], [("x", b"1"), (None, b"2")]):
        with pytest.raises(Exception, match="follow|no name"):
            write(bad)
        assert not list((tmp_path / "o").iterdir())
    write([("a", b"12"), ("a", None), ("a", b"3"), ("b", b"")])
    assert {p.name: p.read_bytes() for p in (tmp_path / "o").iterdir()} == {"a": b"123", "b": b""}
    parts = spark.createDataFrame([("c", b"1"), ("c", b"2")], "file string, content binary").repartition(2)
    with pytest.raises(Exception, match="several tasks"):
        parts.repartitionByRange(2, "content").write.format("image_files").option("path", str(tmp_path / "o")).mode("append").save()
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a", "b"]


def test_tables_of_one_row_are_turned(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y"), ("q", 3, None)], "product string, a int, b string")
    sinks.write_tables(df, str(tmp_path / "csv"), ["product"])
    turned = spark.read.option("header", "true").csv(str(tmp_path / "csv/turned")).collect()
    assert sorted((r.product, r.name, r.value) for r in turned) == [("p", "a", "1"), ("p", "b", "x")]
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv/rows")).where("product = 'q'").count() == 2
    sinks.write_labels(spark.createDataFrame([("p", "<?xml version='1.0'?><a/>"), ("q", "A = 1\nEND"), ("r", None)], "product string, label string"), str(tmp_path / "l"), "label", ["product"])
    assert [r.value for r in spark.read.text(str(tmp_path / "l/xml")).collect()] == ["<?xml version='1.0'?><a/>"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l/txt")).collect()) == ["A = 1", "END"]
