"""Pads and planes of cubes, names of nested groups, spellings of missing values: special inputs."""

import pytest
from pyspark.sql import functions as F

from orrerylake.functions import text
from orrerylake.operators import formats, raster

CUBE = "k int, axes array<string>, pre array<int>, suf array<int>, widths map<string, array<int>>, lp int, ls int, bands int, storage string"
XYZ = ["SAMPLE", "LINE", "BAND"]


def test_planes(spark):
    bil, bsq = "LINE_INTERLEAVED", "BAND_SEQUENTIAL"
    rows = [
        (0, XYZ, None, [0, 0, 5], {"BAND_SUFFIX": [4]}, None, None, 3, bsq),
        (1, XYZ[::-1], [3, 0, 2], None, {"SAMPLE_PREFIX": [2]}, None, None, 3, bsq),
        (2, XYZ, [9, 9, 9], [0, 2, 0], {"LINE_SUFFIX": [8, 8]}, None, None, 3, bsq),
        (3, XYZ, [0, 2, 0], None, {"LINE_PREFIX": [8, 4]}, None, None, 3, bsq),
        (4, XYZ, None, None, {"BAND_SUFFIX": [4]}, None, None, 3, bsq),
        (5, XYZ, [1, 0, 0], [0, 0, 1], {"SAMPLE_PREFIX": [4], "BAND_SUFFIX": [4]}, None, None, 3, bsq),
        (6, None, None, None, None, 8, 4, 3, bil),
        (7, None, None, None, None, 8, None, 1, bsq),
        (8, None, None, None, {}, 8, None, 2, bsq),
        (9, XYZ, [1, 0, 0], None, {"SAMPLE_PREFIX": [4]}, None, 8, 1, None),
        (10, XYZ, None, [1, 1, 1], {"BAND_SUFFIX": None}, 3, None, 1, None),
        (11, None, None, None, None, None, None, None, None),
    ]
    cubes = spark.createDataFrame(rows, CUBE)
    p = raster.plane_pads(F.col("axes"), {"PREFIX": F.col("pre"), "SUFFIX": F.col("suf")}, F.col("widths"), F.lit(4))
    held = cubes.select("*", p.alias("p"), raster.line_pads(F.col("lp"), F.col("ls"), F.lit(4)).alias("l"))
    got = {r.k: r for r in held.select("k", "p", raster.pads_error(F.col("l"), F.col("p"), F.col("bands"), F.col("storage")).alias("error")).collect()}
    assert {k: r.error for k, r in got.items() if r.error} == {
        3: "planes of different widths", 4: "planes without a number of items", 5: "planes along several axes",
        8: "pads of lines in bands that are not interleaved by line", 9: "pads of lines and planes together", 10: "line padding is no whole number of pixels",
    }
    assert got[0].p.after.bands == 5 and tuple(got[0].p.before) == (0, 0, 0)
    # The axes' order is BAND, LINE, SAMPLE: two items of two bytes are one pixel.
    assert got[1].p.before.samples == 1
    assert got[2].p.after.lines == 4 and got[4].p.after.bands is None


def test_planes_of_parts_of_pixels(spark):
    one = spark.createDataFrame([(0, XYZ[::-1], [2, 0, 3], None, {"SAMPLE_PREFIX": [2]}, None, None, 3, None)], CUBE)
    r = one.select(raster.plane_pads(F.col("axes"), {"PREFIX": F.col("pre"), "SUFFIX": F.col("suf")}, F.col("widths"), F.lit(4)).alias("p")).first().p
    assert r.error == "planes are no whole number of pixels" and r.before.samples is None


def test_nested_names(spark):
    rows = [
        ("a", [0], False, "ID", 1), ("a", [1], True, None, 2), ("a", [1, 0], False, "X", 3), ("a", [1, 1], True, "IN", 4), ("a", [1, 1, 0], False, "X", 5), ("a", [1, 2], True, None, 6),
        ("a", [1, 2, 0], True, None, 7), ("a", [1, 2, 0, 0], False, None, 8), ("a", [2], True, "G", 9), ("a", [2, 0], False, "X", 10), ("a", [2, 1], False, "X", 11), ("a", [3], True, "G", 12), ("a", [3, 0], False, "X", 13),
        ("a", [4], False, "G", 14), (None, [0], True, None, 15), ("a", None, False, "lost", 16), ("b", [0], None, "alone", 17), ("b", [11], False, "Y", 18), ("b", [2], False, "Y", 19),
    ]
    items = spark.createDataFrame(rows, "product string, place array<int>, is_group boolean, name string, full_name int")
    got = {r.n: r.full_name for r in formats.nested_names(items.withColumnRenamed("full_name", "n"), ["product"]).collect()}
    assert got == {
        1: "ID", 2: "GROUP_0", 3: "GROUP_0, X", 4: "GROUP_0, IN", 5: "GROUP_0, IN, X", 6: "GROUP_0, GROUP_1", 7: "GROUP_0, GROUP_1, GROUP_0", 8: "GROUP_0, GROUP_1, GROUP_0, ",
        9: "G_0", 10: "G_0, X_0", 11: "G_0, X_1", 12: "G_1", 13: "G_1, X", 14: "G", 15: "GROUP_0", 16: None, 17: "alone", 18: "Y_1", 19: "Y_0",
    }
    twice = spark.createDataFrame([("a", [0], True, "G", 1), ("a", [0], True, "G", 2), ("a", [0, 0], False, "X", 3), ("a", [0, 0], False, "X", 4)], "product string, place array<int>, is_group boolean, name string, n int")
    assert sorted(r.full_name for r in formats.nested_names(twice, ["product"]).collect()) == ["G_0", "G_0, X_0", "G_0, X_1", "G_1"]
    assert formats.nested_names(items.limit(0), ["product"]).columns == items.columns
    assert formats.nested_names(items.limit(0), ["product"]).count() == 0


def test_nested_names_of_a_stated_depth(spark):
    rows = [
        ("a", [0], True, "G", 1), ("a", [0], True, "F", 2), ("a", [0, 0], True, None, 3), ("a", [0, 0, 1], False, "X", 4), ("a", [1, 0, 1], False, "X", 5), ("a", [1], False, "no group", 6), ("b", [0, 5], True, "H", 7), ("b", [0, 5, 0], False, "Y", 8),
        (None, [0], True, "N", 9), (None, [0, 0], False, "Z", 10), ("c", [None], True, "U", 11), ("c", [None, 2], False, "V", 12),
    ]
    items = spark.createDataFrame(rows, "product string, place array<int>, is_group boolean, name string, n int")
    want = {1: "G", 2: "F", 3: "F, GROUP_0", 4: "F, GROUP_0, X", 5: "X", 6: "no group", 7: "H", 8: "H, Y", 9: "N", 10: "Z", 11: "U", 12: "U, V"}
    for settings in ({}, {"depth": 2}, {"depth": 5}, {"depth": 2, "tasks": 3}):
        assert {r.n: r.full_name for r in formats.nested_names(items, ["product"], **settings).collect()} == want
    with pytest.raises(Exception, match="more than 1 groups"):
        formats.nested_names(items, ["product"], depth=1).collect()


@pytest.mark.parametrize(("instrument", "cell", "want"), [("REMS", "   UNK", None), ("REMS", " N/A ", " N/A "), ("REMS", "", ""), ("CRISM", "N/A   ", None), ("CRISM", "NULL", "NULL"), ("OTHER", "NULL", None), (None, " - ", None), ("REMS", None, None)])
def test_spellings_by_instrument(spark, instrument, cell, want):
    row = spark.createDataFrame([(instrument, cell)], "i string, c string")
    assert row.select(text.null_spellings_of(F.col("c"), F.col("i"))).first()[0] == want
