"""Objects by byte range, readers by rule, formats as data: against plain Python, at any split."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerylake.jobs import archive, ingest
from orrerylake.operators import formats, metadata, readers, rules, statements
from orrerylake.sources import files, ranges


def file_rows(spark, paths):
    return spark.createDataFrame([(str(p), n, 0, n) for p, n in paths], "file string, length long, object_start long, object_end long")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_lines_at_any_split(spark, tmp_path, size):
    rng = random.Random(size)
    wanted = {}
    for k, body in enumerate(["", "\n", "\n\n\n", "one line", "a\nb\r\nc", "a\r\n" * 5] + ["".join(rng.choice(["x", "yy\n", "\n", "z\r\n", "é"]) for _ in range(60)) for _ in range(6)]):
        path = tmp_path / f"f{k}"
        path.write_bytes(body.encode())
        lines = body.encode().split(b"\n")
        if lines[-1] == b"":
            lines.pop()
        wanted[str(path)] = [x.removesuffix(b"\r") for x in lines]
    held = file_rows(spark, [(p, len(open(p, "rb").read())) for p in wanted] + [(tmp_path / "none", 10)])
    cut = ranges.line_numbers(ranges.lines(ranges.planned(held, F.lit(0), F.col("length"), range_bytes=size)), ["file"])
    got = {}
    for r in sorted(cut.collect(), key=lambda r: (r.file, r.row)):
        got.setdefault(r.file, []).append(r.line)
        assert r.row == len(got[r.file]) - 1
    assert got == {p: x for p, x in wanted.items() if x}


def test_lines_of_a_part_and_too_long_ones(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"head\nno end, a\nb\nc tail")
    held = spark.createDataFrame([(str(path), 13, 17)], "file string, object_start long, object_end long")
    cut = ranges.lines(ranges.planned(held, F.col("object_start"), F.col("object_end") - F.col("object_start"), range_bytes=2))
    assert sorted(r.line for r in cut.collect()) == [b"a", b"b"]
    with pytest.raises(Exception, match="longer than 3 bytes"):
        ranges.lines(ranges.planned(file_rows(spark, [(path, 23)]), F.lit(0), F.col("length"), range_bytes=2), longest=3).collect()


def test_ranges_read_only_their_bytes(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(bytes(range(100)))
    held = spark.createDataFrame([(str(path), 10, 25, 4), (str(path), 95, 20, None), (str(tmp_path / "no"), 0, 5, None), (None, 0, 5, None), (str(path), 0, 0, 1), (str(path), None, 5, 1), (str(path), 200, 5, None)], "file string, start long, n long, record int")
    got = ranges.contents(ranges.dealt(ranges.planned(held, F.col("start"), F.col("n"), F.col("record"), range_bytes=10))).collect()
    of = {(r.start, r.range): (r.at, r.size, r.first_row, r.content) for r in got if r.file == str(path)}
    assert of == {
        (10, 0): (10, 8, 0, bytes(range(10, 18))), (10, 1): (18, 8, 2, bytes(range(18, 26))), (10, 2): (26, 8, 4, bytes(range(26, 34))), (10, 3): (34, 1, 6, bytes([34])),
        (95, 0): (95, 10, None, bytes(range(95, 100))), (95, 1): (105, 10, None, b""), (200, 0): (200, 5, None, b""),
    }
    assert [r.content for r in got if r.file != str(path)] == [None, None]
    whole = ranges.scanned(ranges.planned(held, F.col("start"), F.col("n"), F.col("record"), range_bytes=10).withColumn("file", F.concat(F.lit("file:"), "file")), files.scan(spark, str(tmp_path), with_content=True))
    assert {(r.start, r.range): r.content for r in whole.collect() if r.content} == {k: v[3] for k, v in of.items() if v[3]}


COLUMN = "OBJECT = COLUMN\nNAME = {}\nDATA_TYPE = {}\nSTART_BYTE = {}\nBYTES = {}\n{}END_OBJECT = COLUMN\n"


def product(tmp_path, name, label, *parts):
    (tmp_path / name).write_bytes(label.encode().ljust(1024) + b"".join(parts))


def test_products_of_several_formats(spark, tmp_path):
    one = "^TABLE = 1025 <BYTES>\nOBJECT = TABLE\nROWS = 3\nROW_BYTES = 5\nROW_PREFIX_BYTES = 2\n" + COLUMN.format("A", "MSB_INTEGER", 1, 1, "") + COLUMN.format("B", "PC_REAL", 2, 4, "") + "END_OBJECT = TABLE\nEND\n"
    two = "^TABLE = 1025 <BYTES>\nOBJECT = TABLE\nROWS = 9\nROW_BYTES = 11\n" + COLUMN.format("A", "CHARACTER", 1, 3, "") + COLUMN.format("C", "MSB_UNSIGNED_INTEGER", 4, 8, "") + "END_OBJECT = TABLE\nEND\n"
    product(tmp_path, "a.lbl", one, *[struct.pack("<Hbf", 65535, -k, k / 2) for k in range(3)])
    product(tmp_path, "b.lbl", one, *[struct.pack("<Hbf", 0, k, k) for k in range(3)])
    product(tmp_path, "c.lbl", two, struct.pack(">3sQ", b"x y", 2**64 - 1), struct.pack(">3sQ", b"z  ", 1), b"cu")  # cut off
    product(tmp_path, "d.lbl", "A = 1\nEND\n")
    product(tmp_path, "e.lbl", '^TABLE = ("gone.dat", 1)\nOBJECT = TABLE\nROWS = 1\nROW_BYTES = 5\n' + COLUMN.format("A", "MSB_INTEGER", 1, 1, "") + "END_OBJECT = TABLE\nEND\n")
    of = archive.opened(spark, str(tmp_path), "*.lbl")
    objects, fmts = of.objects, of.formats
    assert {(r.product[-5:], r.file and r.file[-5:], r.length) for r in objects.collect()} == {("a.lbl", "a.lbl", 21), ("b.lbl", "b.lbl", 21), ("c.lbl", "c.lbl", 24), ("e.lbl", None, None)}
    assert fmts.select("fingerprint").distinct().count() == 3
    assert formats.merged_schema(fmts) == {"A": "string", "B": "float", "C": "decimal(20,0)"}
    got = sorted((r.product[-5:], r.row, r.A, r.B, None if r.C is None else int(r.C)) for r in archive.table_rows(objects, fmts, range_bytes=7).collect())
    assert got == [("a.lbl", k, str(-k), k / 2, None) for k in range(3)] + [("b.lbl", k, str(k), float(k), None) for k in range(3)] + [("c.lbl", 0, "x y", None, 2**64 - 1), ("c.lbl", 1, "z", None, 1), ("c.lbl", 2, None, None, None)]
    archive.ingest_archive(of, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/tables")).count() == 9
    with pytest.raises(ValueError):
        formats.merged_schema(fmts, most_columns=1)
    none = objects.limit(0)
    assert archive.table_rows(none, fmts).count() == archive.image_lines(none).count() == archive.texts(none).count() == archive.text_rows(none, fmts).count() == 0


def test_formats_that_scale_and_repeat(spark):
    label = "OBJECT = TABLE\nROWS = 1\nROW_BYTES = 9\n" + COLUMN.format("N", "MSB_INTEGER", 1, 4, "ITEMS = 2\nITEM_BYTES = 2\nSCALING_FACTOR = 0.5\nOFFSET = 1\n") + COLUMN.format("R", "VOID", 5, 1, "") + COLUMN.format("PLACEHOLDER_1", "VOID", 6, 1, "") + COLUMN.format("OK", "BOOLEAN", 7, 1, "") + COLUMN.format("T", "ASCII_REAL", 8, 2, "") + "END_OBJECT = TABLE\nEND\n"
    meta = statements.metadata(spark.createDataFrame([("p", label), ("q", label)], "product string, label string"), "product", "label")
    fields = formats.fields_of_blocks(meta, "product").withColumn("is_ascii", F.lit(False))
    held = formats.fingerprinted(fields, ["product", "object_at"]).collect()
    assert held[0].fingerprint == held[1].fingerprint
    assert [(f.name, f.kind, f.start, f.width, f.scale) for f in held[0].fields] == [("N_0", "integer", 1, 2, 0.5), ("N_1", "integer", 3, 2, 0.5), ("R", "void", 5, 1, None), ("OK", "boolean", 7, 1, None), ("T", "ascii_real", 8, 2, None)]


@pytest.mark.parametrize("kinds", [({"int"}, "int"), ({"tinyint", "bigint"}, "bigint"), ({"int", "decimal(20,0)"}, "decimal(20,0)"), ({"int", "float"}, "double"), ({"string", "int"}, "string"), ({"boolean", "int"}, "string")])
def test_common_types(kinds):
    assert formats.common_type(kinds[0]) == kinds[1]


def lines_of(spark, held, **facts):
    """{object: [line, ...]} with facts for all."""
    rows = [(o, k, x) for o, own in held.items() for k, x in enumerate(own)]
    df = spark.createDataFrame(rows, "o string, row long, line binary").repartition(3)
    fields = F.lit(None).cast(formats.FORMAT) if "fields" not in facts else F.array(*[F.struct(F.lit(n).alias("name"), F.lit("text").alias("kind"), F.lit("big").alias("order"), F.lit(s).alias("start"), F.lit(w).alias("width"), F.lit(False).alias("is_signed"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast("double").alias("offset")) for n, s, w in facts["fields"]])
    return df.select("*", F.lit(facts.get("reader")).alias("reader"), fields.alias("fields"), F.lit(facts.get("delimiter")).alias("delimiter"), F.lit(facts.get("record_bytes")).cast("long").alias("record_bytes"), F.lit(facts.get("skip_lines")).cast("long").alias("skip_lines"))


def cells(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.o, r.row)):
        out.setdefault(r.o, []).append((r.row, r.cells))
    return out


def test_records_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK_LINES", 3)
    rng = random.Random(4)
    body = {o: bytes(rng.choice(b"abcdef") for _ in range(n)) for o, n in (("x", 100), ("y", 30), ("z", 1))}
    held = {}
    for o, b in body.items():
        cuts = sorted(rng.sample(range(len(b) + 1), min(len(b), 9)))
        held[o] = [b[i:j] for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True)] + [b"\x00", None]
    got = readers.records_by_bytes(lines_of(spark, held), ["o"], F.when(F.col("o") == "x", 7).otherwise(10)).collect()
    for o, b in body.items():
        n = 7 if o == "x" else 10
        assert [r.line for r in sorted(got, key=lambda r: r.row) if r.o == o] == [b[i : i + n] for i in range(0, len(b), n)]
    placed = readers.running_bytes(lines_of(spark, held), ["o"], F.coalesce(F.octet_length("line"), F.lit(0)))
    for r in placed.collect():
        assert r.before == sum(len(x or b"") for x in held[r.o][: r.row])


def test_delimited_lines(spark):
    held = {"p": [b'a;" b;c ";3', b";;", b'x;"y', b"", b"# note", b"1;\xc3\xa9\t;2\r"]}
    got = cells(readers.by_line(lines_of(spark, held, reader="delimited", delimiter=";"), ["o"]))
    assert got == {"p": [(0, ["a", "b;c", "3"]), (1, ["", "", ""]), (2, ["x", "y"]), (5, ["1", "é", "2"])]}
    wide = {"p": [b"a,b", b"xx  yy", b"a"]}
    assert cells(readers.by_line(lines_of(spark, wide, reader="delimited", delimiter=",", fields=[("m", 1, 2), ("n", 5, 2)]), ["o"])) == {"p": [(0, ["a", "b"]), (1, ["xx", "yy"]), (2, ["a"])]}
    bar = cells(readers.by_line(lines_of(spark, {"p": [b'1|"2|3"', b"N/A| -"]}, reader="null spellings", delimiter="|"), ["o"]))
    assert bar == {"p": [(0, ["1", "2|3"]), (1, [None, None])]}


def test_tables_that_need_other_lines(spark, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK_LINES", 2)
    marked = {"p": [b"0,1", b"//x", b"1,2", b"// again", b"3,4"], "q": [b"no marker"], "r": [b"// only"]}
    assert cells(readers.behind_marker(lines_of(spark, marked), ["o"])) == {"p": [(0, ["1", "2"]), (1, ["// again"]), (2, ["3", "4"])]}
    heads = {"p": [b"5,6", b"A", b"1,2", b"", b"3,4", b"B", b"C", b"7,8", b"9,9", b"1,1", b"1,2"]}
    got = cells(readers.headers_filled(lines_of(spark, heads, fields=[("h", 1, 1), ("a", 2, 1), ("b", 3, 1)]), ["o"]))
    assert [c for _, c in got["p"]] == [["A", "1", "2"], ["A", "3", "4"], ["C", "7", "8"], ["C", "9", "9"], ["C", "1", "1"], ["C", "1", "2"]]
    assert cells(readers.sections(lines_of(spark, {"p": [b"h", b"i", b"1,2"], "q": [b"h"]}, skip_lines=2), ["o"])) == {"p": [(0, ["1", "2"])]}
    for f in (readers.by_line, readers.by_bytes, readers.behind_marker, readers.sections, readers.headers_filled):
        assert f(lines_of(spark, heads).limit(0), ["o"]).count() == 0


def test_records_of_quoted_lines(spark, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK_LINES", 3)
    held = {"p": [b'1,"a', b"b,", b'c"', b"2,x", b'"3"",', b'4",5', b"", b"6,7", b'open "', b"8,9"], "q": [b"1", None, b'"', b'"']}
    got = {}
    for r in sorted(readers.quoted_records(lines_of(spark, held), ["o"]).collect(), key=lambda r: (r.o, r.row)):
        got.setdefault(r.o, []).append(r.line)
    assert got == {"p": [b'1,"a\nb,\nc"', b"2,x", b'"3"",\n4",5', b"", b"6,7", b'open "\n8,9'], "q": [b"1", b"", b'"\n"']}
    assert cells(readers.by_quotes(lines_of(spark, {"p": [b'1;"a', b';b";2', b"3;;"]}, delimiter=";"), ["o"])) == {"p": [(0, ["1", "a\n;b", "2"]), (1, ["3", "", ""])]}


def test_unknown_readers_raise(spark):
    df = spark.createDataFrame([("delimited", None), (None, ";"), (None, None), ("nobody", None)], "r string, d string")
    assert [r.c for r in df.where("r IS NULL OR r != 'nobody'").coalesce(1).select(readers.chosen(F.col("r"), F.col("d")).alias("c")).collect()] == ["delimited", "delimited", "fixed width"]
    with pytest.raises(Exception, match="no reader named nobody"):
        df.select(readers.chosen(F.col("r"), F.col("d")).alias("c")).collect()


def test_texts_and_rules(spark, tmp_path):
    product(tmp_path, "a.lbl", "^TEXT = 1025 <BYTES>\n^X_HEADER = (\"x.txt\", 2)\n^DOC_TEXT = \"d.pdf\"\nRECORD_TYPE = STREAM\nOBJECT = X_HEADER\nROWS = 2\nEND_OBJECT\nEND\n", b"caf\xe9\r\nend\rx")
    (tmp_path / "x.txt").write_bytes("zero\none é\r\ntwo\nthree\n".encode() + b"\xff")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    objects = archive.opened(spark, str(tmp_path), "*.lbl").objects
    assert {r.name: r.text for r in archive.texts(objects).collect()} == {"TEXT": "café\nend\nx", "X_HEADER": "one é\ntwo"}
    assert {r.name: r.text for r in archive.texts(objects, limit=4).collect()}["TEXT"] == "café"
    special = spark.createDataFrame([(1, "kind", "name", "equals", "TEXT", None, None, "KIND", "image"), (2, "start byte", "name", "equals", "X_HEADER", None, None, "START_BYTE", "64"), (3, "reader", "file", "contains", ".pdf", None, None, "READER", "sections")], rules.RULES)
    patched = {r.name: (r.kind, r.reader) for r in archive.opened(spark, str(tmp_path), "*.lbl", special).objects.collect()}
    assert patched == {"TEXT": ("image", None), "X_HEADER": ("header", None), "DOC_TEXT": ("text", "sections")}


def test_repeated_blocks_meet_their_pointers(spark):
    label = "^TABLE = 1\n^TABLE = 2\n" + "".join(f"OBJECT = TABLE\nROWS = {n}\nOBJECT = COLUMN\nNAME = X\nEND_OBJECT\nEND_OBJECT\n" for n in (5, 6)) + "END\n"
    meta = statements.metadata(spark.createDataFrame([("p", label)], "product string, label string"), "product", "label")
    blocks = metadata.numbered_blocks(formats.block_table(meta, "product"), "product")
    assert {r.indexed: r.ROWS for r in blocks.where("kind = 'TABLE'").collect()} == {"TABLE_0": 5, "TABLE_1": 6}
    assert {r.name for r in ingest.objects(meta).collect()} == {"TABLE_0", "TABLE_1"}


def test_images_of_every_order_and_split(spark, tmp_path):
    cube = np.arange(24).reshape(2, 3, 4)
    pre = b"\xff\xff"
    bodies = {
        "BAND_SEQUENTIAL": b"".join(pre + cube[b, k].astype(">i2").tobytes() for b in range(2) for k in range(3)), "LINE_INTERLEAVED": b"".join(pre + cube[b, k].astype(">i2").tobytes() for k in range(3) for b in range(2)),
        "SAMPLE_INTERLEAVED": b"".join(pre + cube[:, k].T.astype(">i2").tobytes() for k in range(3)),
    }
    for order, body in bodies.items():
        block = f"^IMAGE = 1025 <BYTES>\nOBJECT = IMAGE\nLINES = 3\nLINE_SAMPLES = 4\nSAMPLE_TYPE = MSB_INTEGER\nSAMPLE_BITS = 16\nBANDS = 2\nBAND_STORAGE_TYPE = {order}\nLINE_PREFIX_BYTES = 2\nEND_OBJECT = IMAGE\nEND\n"
        product(tmp_path, f"{order}.lbl", block, body if order != "LINE_INTERLEAVED" else body[:-1])
    objects = archive.opened(spark, str(tmp_path), "*.lbl").objects
    for size in (1, 25, 1 << 20):
        got = {}
        for r in archive.image_lines(objects, size).collect():
            got.setdefault(r.product.rsplit("/")[-1][:-4], {})[r.band, r.line] = r.samples
        whole = {(b, k): cube[b, k].astype(float).tolist() for b in range(2) for k in range(3)}
        assert got["BAND_SEQUENTIAL"] == got["SAMPLE_INTERLEAVED"] == whole
        assert got["LINE_INTERLEAVED"] == {k: v for k, v in whole.items() if k != (1, 2)}
