"""Small products built from the schemas of representative ones."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerylake.functions import binary, text, values, vectorized
from orrerylake.jobs import ingest, sinks
from orrerylake.operators import calibrate, metadata, raster, statements
from orrerylake.sources import files, records
from orrerylake.streaming import decode

LABEL = """PDS_VERSION_ID = PDS3
^TABLE = ("T.DAT", 1)
DATA_SET_ID = "X-1"
OBJECT = TABLE
  ROWS = 10
  ROW_BYTES = 13
  OBJECT = COLUMN
    NAME = X
    DATA_TYPE = UNSIGNED_INTEGER
    START_BYTE = 1
    BYTES = 1
  END_OBJECT = COLUMN
  OBJECT = COLUMN
    NAME = Y
    DATA_TYPE = PC_REAL
    START_BYTE = 2
    BYTES = 4
  END_OBJECT = COLUMN
  OBJECT = COLUMN
    NAME = X
    DATA_TYPE = PC_REAL
    START_BYTE = 6
    BYTES = 8
  END_OBJECT = COLUMN
END_OBJECT = TABLE
END\r
"""


def test_binary_table_from_files_to_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.lbl").write_text(LABEL)
    (tmp_path / "in" / "T.DAT").write_bytes(struct.pack("<Bfd", 1, 4.4, 8.8) * 10)
    meta = ingest.catalogue(spark, str(tmp_path / "in")).cache()
    product = meta.first().product
    found = ingest.objects(meta).collect()
    assert [(r.name, r.kind, r.file, r.value) for r in found] == [("TABLE", "table", "T.DAT", 1)]
    fmt = ingest.format_of(ingest.field_table(meta), product)
    assert [f["name"] for f in fmt] == ["X_0", "Y", "X_1"]
    ingest.ingest_binary(spark, str(tmp_path / "in" / "T.DAT"), fmt, 13, str(tmp_path / "out"), "X-1", "TABLE")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert [(t) for _, t in back.dtypes][:3] == ["smallint", "float", "double"]
    assert {(r.X_0, round(r.Y, 5), r.X_1) for r in back.collect()} == {(1, 4.4, 8.8)} and back.count() == 10


def test_odd_label(spark):
    label = 'A = 1 /* x\n^CAT = "MEOW.CAT"\nGROUP = G\n  OBJECT = O\n POINTINESS = 12\n END_OBJECT = WRONG\nSEQ = (1,2,3,\n 4,"5")\nANGLE = (-4.5e-05 <RAD>, 1 <RAD>)\nEND_GROUP = G\nlower case = no\nOPEN = "a\nb = c"\nOBJECT = NEVER\nB = 2\n'
    meta = statements.metadata(spark.createDataFrame([("p", label)], "product string, label string"), "product", "label")
    rows = {r.key: r for r in meta.collect()}
    assert (rows["POINTINESS"].value_long, rows["POINTINESS"].depth, rows["POINTINESS"].path) == (12, 2, ["G", "O"])
    assert rows["SEQ"].items == ["1", "2", "3", "4", "5"]
    assert rows["^CAT"].value_string == "MEOW.CAT"
    assert not rows["B"].attached and rows["A"].attached
    terms = spark.createDataFrame([("KAT",)], "term string")
    assert metadata.fuzzy_keys(meta, terms).first().key == "^CAT"
    angle = spark.range(1).select(values.parts_of_quantities(F.lit("(-4.5e-05 <RAD>, 1 <RAD>)")).alias("q")).first().q
    assert [(x.value, x.units) for x in angle] == [("-4.5e-05", "RAD"), ("1", "RAD")]


@pytest.mark.parametrize(
    ("value", "items", "nested"),
    [
        ('("a, b", 2)', ["a, b", "2"], '["a, b",2]'),
        ("((1,2),(3,4))", ["(1,2)", "(3,4)"], "[[1,2],[3,4]]"),
        ("(16#FF#, 2)", ["255", "2"], "[255,2]"),
        ('("A,B.DAT", 5 <BYTES>)', ["A,B.DAT", "5 <BYTES>"], '["A,B.DAT",{"units":"BYTES","value":5}]'),
        ("{a, 'b)c', (x, {1.5, -.5, +3, 2.})}", ["a", "b)c", "(x, {1.5, -.5, +3, 2.})"], '["a","b)c",["x",[1.5,-0.5,3,2]]]'),
        ("()", [], "[]"),
        ('("")', [""], '[""]'),
        ("(1,,2)", ["1", "", "2"], None),
        ("(2 <KM, S>, 007, 2001-02-03)", ["2 <KM, S>", "007", "2001-02-03"], '[{"units":"KM, S","value":2},"007","2001-02-03"]'),
        ('("say ""x""")', None, None),
        (None, None, None),
    ],
)
def test_collections(spark, value, items, nested):
    df = spark.createDataFrame([(value,), ("(1,2)",)], "v string").repartition(1)
    got = df.select("v", values.items(F.col("v")).alias("items"), F.to_json(values.nested_value(F.col("v"))).alias("nested")).where(F.col("v").eqNullSafe(F.lit(value))).first()
    assert items is None or got.items == items
    assert nested is None or got.nested == nested


def test_quoted_names_in_pointers(spark):
    label = '^TABLE = ("A,B.DAT", 5 <BYTES>)\n^IMAGE = ("C (1).IMG", 3)\n^TEXT = "D.TXT"\n^X_TABLE = 7\nEND\n'
    meta = statements.metadata(spark.createDataFrame([("p", label)], "product string, label string"), "product", "label")
    got = {r.name: (r.file, r.value, r.units) for r in ingest.objects(meta).collect()}
    assert got == {"TABLE": ("A,B.DAT", 5, "BYTES"), "IMAGE": ("C (1).IMG", 3, None), "TEXT": ("D.TXT", None, None), "X_TABLE": (None, 7, None)}


def test_empty_and_null_labels(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "\n\n"), ("d", "END_OBJECT\nEND\nX = 1")], "product string, label string")
    assert [(r.product, r.key) for r in statements.metadata(rows, "product", "label").collect()] == [("d", "X")]
    assert statements.metadata(rows.limit(0), "product", "label").count() == 0


def test_reals(spark):
    doubles = [0.0, -0.5, 1.5e-310, 3.25, -1e300, float("inf"), float("-inf")]
    rows = [(struct.pack("<d", x), struct.pack(">f", np.float32(x if abs(x) < 1e30 or np.isinf(x) else 1.0)), x) for x in doubles]
    for r in spark.createDataFrame(rows, "d binary, f binary, x double").select(binary.ieee(F.col("d"), 1, 8, "little").alias("d"), binary.ieee(F.col("f"), 1, 4, "big").alias("f"), "x").collect():
        assert r.d == r.x and (r.f == np.float32(r.x) or abs(r.x) >= 1e30 or r.f == float(np.float32(r.x)))
    nan = spark.createDataFrame([(struct.pack(">d", float("nan")), bytes.fromhex("C1100000"), bytes.fromhex("C110000000000000"), bytes.fromhex("80C00000"))], "n binary, i binary, j binary, v binary")
    r = nan.select(binary.ieee(F.col("n"), 1, 8, "big").alias("n"), binary.ibm(F.col("i"), 1, 4).alias("i"), binary.ibm(F.col("j"), 1, 8).alias("j"), binary.vax(F.col("v"), 1).alias("v")).first()
    assert np.isnan(r.n) and r.i == -1.0 and r.j == -1.0 and r.v == -1.0
    u = spark.createDataFrame([(b"\xff" * 8,)], "u binary").select(binary.unsigned(F.col("u"), 1, 8, "big").alias("u"), binary.signed(F.col("u"), 1, 8, "little").alias("s"), binary.signed(F.col("u"), 7, 4, "big").alias("short")).first()
    assert (int(r2 := u.u), u.s, u.short) == (2**64 - 1, -1, None) and r2 == 2**64 - 1


def test_constants_of_data_and_label(spark):
    pixels = spark.createDataFrame([("i", 33), ("i", -32766), ("i", 100)], "object string, v int")
    implicit = calibrate.implicit_constants(pixels, "object", "v", "int16")
    explicit = spark.createDataFrame([("i", "INVALID_CONSTANT", 33.0)], "object string, name string, constant double")
    found = calibrate.constants_by_object(explicit, implicit, object_="object")
    assert sorted(found.first().specials) == [-32766.0, 33.0]
    out = calibrate.scaled_table(pixels, found, "object", "v", F.lit(2.0), F.lit(1.0)).collect()
    assert [r.scaled for r in out] == [None, None, 201.0]
    assert len(calibrate.CONSTANT_NAMES) == 141


def test_bounds_and_stretch(spark):
    cells = spark.createDataFrame([("x", float(r)) for r in range(100) for _ in range(10)] + [("x", None)], "image string, value double")
    assert tuple(raster.bounds(cells, ["image"], (10, 10)).first())[1:] == pytest.approx((9.9, 89.1))
    assert tuple(raster.bounds(cells, ["image"], (0, 0)).first())[1:] == (0.0, 99.0)
    whole = cells.select("image", F.col("value").cast("smallint").alias("value"))
    assert tuple(raster.bounds(whole, ["image"], (10, 10)).first())[1:] == (9.0, 89.0)
    assert tuple(raster.bounds(whole.withColumn("value", -F.col("value")), ["image"], (10, 10)).first())[1:] == (-89.0, -9.0)
    bytes_ = [r.byte for r in raster.eight_bit(cells, ["image"], (10, 10)).collect()]
    assert min(b for b in bytes_ if b is not None) == 0 and max(b for b in bytes_ if b is not None) == 255 and None in bytes_
    flat = spark.createDataFrame([("y", 5.0)], "image string, value double")
    assert raster.eight_bit(flat, ["image"]).first().byte == 5
    assert raster.middle_band(5) == 2 and raster.middle_band(3) == 2


def test_files_and_decompression(spark, tmp_path):
    (tmp_path / "a.img.gz").write_bytes(gzip.compress(bytes(range(100))))
    raw = files.decompressed(files.scan(spark, str(tmp_path), with_content=True)).select("content").first().content
    assert raw == bytes(range(100))
    frame = spark.createDataFrame([(raw, None)], "raw binary, none binary")
    r = frame.select(files.byte_range(F.col("raw"), 10, 10).alias("a"), vectorized.array_of(F.col("raw"), "unsigned", 2, "big").alias("b"), vectorized.array_of(F.col("none"), "ieee", 4, "big").alias("c")).first()
    assert r.a == bytes(range(10, 20)) and r.b[1] == 0x0203 and r.c is None
    assert records.delimiter("VERTICAL_BAR") == "|" and records.delimiter(None) == ","


def test_delimited_spreadsheet(spark):
    lines = spark.createDataFrame([("5.5| cat| -12\r\n",)] * 10 + [("1|2",)], "line string")
    rows = records.delimited(lines, "line", "|", ["X_0", "Y", "X_1"]).where("fits").select(F.col("X_0").cast("double"), "Y", F.col("X_1").cast("int")).distinct().collect()
    assert [tuple(r) for r in rows] == [(5.5, "cat", -12)]


def test_dates(spark):
    cases = {"2001-040": "2001-02-09 00:00:00", "2001-02-09T10:11:12.5Z": "2001-02-09 10:11:12.500000", " 1999 ": "1999-01-01 00:00:00", "2001-13-01": None, "UNK": None, None: None, "2001-02-09T10": "2001-02-09 10:00:00"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.archive_date(F.col("t")).alias("d")).collect()
    assert {r.t: None if r.d is None else str(r.d) for r in rows} == cases


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "cat", "p"), (2, "dog", "p")], "a int, b string, object string")
    sinks.write_csv(table, str(tmp_path / "csv"), ["object"])
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(str(tmp_path / "csv"))
    assert sorted((r.a, r.b, r.object) for r in back.collect()) == [(1, "cat", "p"), (2, "dog", "p")]
    sinks.write_text(table, str(tmp_path / "txt"), "b", ["object"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["cat", "dog"]
    assert table.select(sinks.output_name(F.lit("p"), F.lit("IMAGE"), True, F.lit(2)).alias("n")).first().n == "p_IMAGE_scaled_2"
    one = sinks.turned(table.limit(1), ["a", "b"]).collect()
    assert [(r.name, r.value) for r in one] == [("a", "1"), ("b", "cat")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tab").write_text("  1 x\n  2 y\nbad z\n")
    fields = [("n", 1, 3, "int"), ("s", 5, 1, "string")]

    def run():
        decode.to_store(decode.fixed_width_stream(spark, str(tmp_path / "in"), fields), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(((r.n, r.s) for r in spark.read.schema("n int, s string").parquet(str(tmp_path / "out")).collect()), key=str)

    assert run() == sorted([(1, "x"), (2, "y"), (None, "z")], key=str)
    (tmp_path / "in" / "b.tab").write_text("  3 w\n")
    assert run() == sorted([(1, "x"), (2, "y"), (3, "w"), (None, "z")], key=str)


def test_blocks_by_name(spark):
    labels = {"a": "T = 1\nOBJECT = TABLE\nX = 2\nOBJECT = C\nY = 3\nEND_OBJECT\nEND_OBJECT\nOBJECT = TABLE\nX = 9\nEND_OBJECT\nEND\n", "b": "TABLE = 5\nZ = 1\nEND\n", "c": "Z = 1\nEND\n"}
    meta = statements.metadata(spark.createDataFrame(list(labels.items()), "product string, label string"), "product", "label")
    assert sorted((r.product, r.key, r.value_raw) for r in metadata.metablock(meta, "product", "TABLE").collect()) == [("a", "X", "2"), ("a", "Y", "3"), ("b", "TABLE", "5"), ("b", "Z", "1")]
    assert metadata.metablock(meta.limit(0), "product", "TABLE").count() == 0


def test_planes_sections_and_browse_bands(spark):
    cells = spark.createDataFrame([(b, k, s, 100 * b + 10 * k + s) for b in range(5) for k in range(4) for s in range(3)], "band int, line int, sample int, value int")
    parts = {(r.band, r.line, r.sample): r.part for r in cells.select("*", raster.plane_of(2, 3, 3, (0, 1, 1)).alias("part")).collect()}
    assert parts[1, 1, 0] == parts[3, 3, 1] == "core" and parts[0, 0, 2] == "side" and parts[0, 0, 0] == "bottom" and parts[4, 2, 1] == parts[0, 1, 1] == "back"
    assert sum(p == "core" for p in parts.values()) == 2 * 3 * 3
    some = raster.cube_section(cells, bands=(1, 3), samples=(2, 9)).collect()
    assert {(r.band, r.line, r.sample, r.value) for r in some} == {(b - 1, k, 0, 100 * b + 10 * k + 2) for b in (1, 2) for k in range(4)}
    channels = lambda **k: sorted({(r.channel, r.band) for r in raster.browse_bands(cells, **k).collect()})
    assert channels(n_bands=5) == [("2", 2)] and channels(n_bands=4) == [("b", 2), ("g", 1), ("r", 0)] and channels(n_bands=1) == [("0", 0)]
    assert channels(n_bands=5, chosen=(4, 4, 0)) == [("b", 0), ("g", 4), ("r", 4)] and channels(n_bands=5, chosen=(3,)) == [("3", 3)] and len(channels(n_bands=5, burst=True)) == 5
    with pytest.raises(ValueError):
        raster.browse_bands(cells, 5, (1, 2))
