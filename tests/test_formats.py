"""Formats, rules, constants and sinks: nulls, ragged and repeated rows, empty tables, and what must raise an error."""

import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orrerylake.functions import values
from orrerylake.jobs import sinks
from orrerylake.operators import calibrate, formats, metadata, readers, rules, special_cases, statements
from orrerylake.sources import files, records

FIELDS = [
    {"name": n, "kind": k, "order": o, "start": s, "width": w, "is_signed": g}
    for n, k, o, s, w, g in (
        ("i4", "integer", "big", 1, 4, True), ("u8", "integer", "little", 5, 8, False), ("u1", "integer", "big", 13, 1, False), ("f4", "ieee", "big", 14, 4, False), ("f8", "ieee", "little", 18, 8, False),
        ("vax", "vax", "little", 26, 4, False), ("ibm", "ibm", "big", 30, 8, False), ("bits", "bits", "little", 38, 2, False), ("ebc", "ebcdic", "big", 40, 3, False), ("txt", "text", "big", 43, 4, False), ("raw", "other", "big", 47, 2, False),
    )
]


def test_batches_equal_the_native_decoders(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        r = bytearray(rng.integers(0, 256, 48, dtype=np.uint8).tobytes())
        r[13:17] = struct.pack(">f", float(rng.normal()) * 10.0 ** int(rng.integers(-20, 20)))
        r[17:25] = struct.pack("<d", float(rng.normal()) * 10.0 ** int(rng.integers(-200, 200)))
        r[39:42] = "Ab1".encode("cp500")
        r[42:46] = b"xy  " if k % 2 else b" z\xe9 "
        rows.append((bytes(r),))
    df = spark.createDataFrame(rows, "record binary")
    native, batches = formats.decode_records(df, FIELDS), formats.decode_batches(df, FIELDS)
    assert native.dtypes == batches.dtypes
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (native, batches))
    for x, y in zip(a, b, strict=True):
        for f, p, q in zip(FIELDS, x, y, strict=True):
            assert p == q or f["kind"] in ("ieee", "vax", "ibm") and p == pytest.approx(q, rel=1e-6), f["name"]


def test_batches_bear_ragged_and_null_records(spark):
    good = bytes(range(48))
    df = spark.createDataFrame([(good,), (None,), (b"short",), (good,), (b"",)], "record binary").coalesce(1)
    got = formats.decode_batches(df, FIELDS).collect()
    assert len(got) == 5 and sum(r.raw is None for r in got) == 3
    assert sorted(str(r.i4) for r in got) == sorted(["None", "None", str(0x00010203), str(0x00010203), str(int.from_bytes(b"shor"))])
    assert formats.decode_batches(df.limit(0), FIELDS).count() == 0
    assert formats.decode_batches(spark.createDataFrame([(None,)], "record binary"), FIELDS).collect()[0].f8 is None


def test_batches_do_not_depend_on_other_records(spark):
    """A record decodes by itself, whatever the lengths of those in its batch."""
    field = [{"name": "v", "kind": "integer", "order": "big", "start": 1, "width": 2, "is_signed": False}]
    rows = [(b"\x00\x01",), (b"\x00\x02",), (b"\x00\x03\xff",), (b"\x04",), (None,), (b"\x00\x01",)]
    df = spark.createDataFrame(rows, "record binary")
    want = [1, 2, 3, None, None, 1]
    assert [r.v for r in formats.decode_batches(df.coalesce(1), field).collect()] == want
    assert sorted(map(str, (r.v for r in formats.decode_batches(df.repartition(6), field).collect()))) == sorted(map(str, want))
    assert [r.v for r in formats.decode_records(df.coalesce(1), field).collect()] == want


def test_repeated_names_and_targets_stay(spark):
    names = spark.createDataFrame([("d/A.dat", 1), ("d/A.dat", 1), ("d/none", 2), (None, 3)], "name string, n int")
    found = spark.createDataFrame([("d/a.DAT",), ("d/a.DAT",), ("d/a.dat.gz",)], "file string")
    got = sorted(map(str, files.resolved(names, found).collect()))
    assert got == sorted(map(str, [Row(name="d/A.dat", n=1, resolved="d/a.DAT", hits=2)] * 2 + [Row(name="d/none", n=2, resolved=None, hits=0), Row(name=None, n=3, resolved=None, hits=0)]))
    objects = spark.createDataFrame([(1, 3), (1, 3), (2, 5761), (3, None), (4, 7)], "o int, target int")
    units = spark.createDataFrame([(0, 0), (1, 5760)], "unit int, start int")
    assert sorted((r.o, r.unit) for r in records.unit_at(objects, units, "target").where("unit is not null").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert records.unit_at(objects, units, "target").count() == 5


def test_label_endings(spark):
    heads = ["A = 1\nEND\r\nrest", "A = 1\nEND\nrest", "A = 1\nEND   \rrest", "A = 1\nEND         rest", "A = 1\x00\x00\x00rest", "A = 1\nENDING = 2\nEND x"]
    df = spark.createDataFrame([(i, h.encode()) for i, h in enumerate(heads)], "i int, content binary")
    got = [r.label for r in df.orderBy("i").select(files.attached_label(F.col("content")).alias("label")).collect()]
    assert got == ["A = 1\nEND\r", "A = 1\nEND\n", "A = 1\nEND   \r", "A = 1\nEND         ", "A = 1\x00\x00\x00", heads[5]]


def test_bit_masks(spark):
    df = spark.createDataFrame([(7, 5), (6, 5), (None, 5), (6, None)], "v int, m int")
    assert [r.x for r in df.select(calibrate.bit_masked(F.col("v"), F.col("m"), [7]).alias("x")).collect()] == [7, 4, None, 6]
    assert [r.x for r in df.select(calibrate.bit_masked(F.col("v"), F.col("m"), []).alias("x")).collect()] == [5, 4, None, 6]


def test_fixed_records_of_files(spark, tmp_path):
    for name, n in (("a", 9_000), ("b", 0), ("c", 1)):
        (tmp_path / name).write_bytes(b"".join(struct.pack(">iH", k, k % 7) for k in range(n)))
    got = records.read_fixed_records(spark, str(tmp_path), 6, at_once=1_000).collect()
    assert sorted(struct.unpack(">iH", r.record) for r in got) == sorted([(k, k % 7) for k in range(9_000)] + [(0, 0)])


def test_deep_blocks_raise(spark):
    deep = "\n".join(f"OBJECT = B{k}" for k in range(9)) + "\nX = 1\n" + "END_OBJECT\n" * 9 + "END\n"
    rows = statements.statement_rows(spark.createDataFrame([(1, deep), (2, None), (3, "")], "p int, label string"), "p", "label")
    with pytest.raises(Exception, match="most_depth"):
        statements.nested(rows, "p").collect()
    x = statements.nested(rows, "p", most_depth=9).where("key = 'X'").first()
    assert x.depth == 9 and x.path == [f"B{k}" for k in range(9)]


def test_injected_to_any_level_and_never_round(spark):
    rows = spark.createDataFrame([(1, [0], "^STRUCTURE", "F0"), (1, [1], None, "x"), (2, [0], "^TABLE_STRUCTURE", "none")], "o int, order array<int>, key string, value string")
    chain = [(f"f{k}", 0, "^COLUMN_STRUCTURE", f"F{k + 1}") for k in range(6)] + [("f6", 0, "NAME", "deepest")]
    held = spark.createDataFrame(chain, "file string, seq int, key string, value string")
    out, missing = formats.injected(rows, held, "o", F.lower)
    assert sorted((r.o, r.key, r.value) for r in out.where("key is not null").collect()) == [(1, "NAME", "deepest"), (2, "^TABLE_STRUCTURE", "none")]
    assert [tuple(r) for r in missing.collect()] == [(2, "none")]
    loop = spark.createDataFrame([("f0", 0, "^STRUCTURE", "F1"), ("f1", 0, "^STRUCTURE", "F0")], held.schema)
    with pytest.raises(ValueError, match="themselves"):
        formats.injected(rows, loop, "o", F.lower)


def test_fields_of_blocks_edge_cases(spark):
    label = "OBJECT = TABLE\nOBJECT = COLUMN\nNAME = A\nBYTES = 2\nEND_OBJECT = COLUMN\nOBJECT = COLUMN\nNAME = A\nSTART_BYTE = 3\nBYTES = 4\nITEMS = 0\nEND_OBJECT = COLUMN\nEND_OBJECT = TABLE\nEND\n"
    labels = spark.createDataFrame([(1, label), (2, label), (3, None), (4, "A = 1\nEND\n")], "p int, label string")
    got = formats.fields_of_blocks(statements.metadata(labels, "p", "label"), "p").collect()
    assert sorted((r.p, r.NAME, r.SB_OFFSET, r.WIDTH, r.object) for r in got) == [(p, "A", s, w, "TABLE") for p in (1, 2) for s, w in ((0, 2), (2, 4))]


def test_blocks_around_fields(spark):
    """Nine deep, beside a block of the same names, in one without statements; labels whose blocks open at the same lines, and one without a product."""

    def block(kind, inside, start=None, more=""):
        return f"OBJECT = {kind}\n" + (f"START_BYTE = {start}\n" if start else "") + more + inside + f"END_OBJECT = {kind}\n"

    def label(stride):
        deep = block("COLUMN", "NAME = DEEP\nBYTES = 1\n", 2)
        for k in range(7):
            deep = block("CONTAINER", deep, 2, f"BYTES = {stride}\nREPETITIONS = 2\n" if k == 6 else "")
        beside = block("CONTAINER", block("COLUMN", "NAME = BESIDE\nBYTES = 1\n", 3), 100)
        bare = block("COLLECTION", block("COLUMN", "NAME = BARE\nBYTES = 1\n", 5))
        return block("TABLE", deep + beside + bare, more="ROWS = 1\n") + "END\n"

    labels = spark.createDataFrame([(1, label(50)), (2, label(60)), (None, label(50))], "p int, label string")
    meta = statements.nested(statements.statement_rows(labels, "p", "label"), "p", most_depth=9).where("not opens and not closes").withColumns({"value_raw": F.col("value"), "value_string": F.col("value")})
    got = formats.fields_of_blocks(meta, "p").collect()
    # A label without a product knows no blocks around its fields.
    want = {(p, n, k, s) for p, stride in ((1, 50), (2, 60)) for n, k, s in (("DEEP", 0, 8), ("DEEP", 1, 8 + stride), ("BESIDE", 0, 101), ("BARE", 0, 4))} | {(None, "DEEP", 0, 1), (None, "BESIDE", 0, 2), (None, "BARE", 0, 4)}
    assert len(got) == len(want) and {(r.p, r.NAME, r.repetition, r.SB_OFFSET) for r in got} == want and {r.object for r in got} == {"TABLE"}


@pytest.mark.parametrize(("text", "want"), [("5 <KM>", ("5", "KM")), (" -4.5E-05 <rad> ", ("-4.5E-05", "rad")), ("N/A <S>", ("N/A", "S")), ("about 5 <KM>", None), ("5", None), (None, None), ("", None), ("<KM>", None), ("1.5 <M/S**2>", ("1.5", "M/S**2"))])
def test_quantities(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(values.quantity(F.trim("t")).alias("q")).first().q
    assert (tuple(got) if got else None) == want


def test_constants_of_each_type(spark):
    for kind, to in (("int16", "smallint"), ("uint16", "int"), ("int32", "int"), ("int64", "bigint"), ("uint32", "bigint"), ("float32", "float"), ("float64", "double")):
        held = calibrate.IMPLICIT[kind]
        rows = [("x", float(c)) for c in held.values()] + [("x", 5.0), ("y", 5.0), ("y", None)]
        df = spark.createDataFrame(rows, "o string, d double").select("o", F.col("d").cast(to).alias("v"))
        got = calibrate.implicit_constants(df, "o", "v", kind).collect()
        assert {r.name for r in got} == set(held) and {r.o for r in got} == {"x"}
        masked = df.join(calibrate.constants_by_object(calibrate.implicit_constants(df, "o", "v", kind), object_="o"), "o", "left").select(calibrate.masked(F.col("v"), F.col("specials"), F.col("invalids")).alias("m"))
        assert sorted(r.m for r in masked.where("m is not null").collect()) == [5, 5]
    # An explicit constant beside those of the data.
    meta = spark.createDataFrame([("x", "INVALID_CONSTANT", "33", None, None), ("x", "MISSING_CONSTANT", "N/A", None, None)], "o string, key string, value_raw string, value_string string, items array<string>")
    assert [tuple(r) for r in calibrate.explicit_constants(meta, "o").collect()] == [("x", "INVALID_CONSTANT", 33.0)]
    assert len(calibrate.CONSTANT_NAMES) == len(set(calibrate.CONSTANT_NAMES)) == 141


def test_sampled_fields(spark):
    i = F.col("id").cast("double")
    got = spark.range(4).select(
        formats.sampled_field(i, F.lit(1.0), F.lit(0.5)).alias("lin"), formats.sampled_field(i, F.lit(3.0), F.lit(2.0), "logarithmic").alias("log"), formats.sampled_field(i, F.lit(1.0), F.lit(10.0), "exponential").alias("exp"),
        formats.sampling_fits(F.lit(10.0), F.when(F.col("id") == 1, 10.009).when(F.col("id") == 2, 10.02)).alias("fits"),
    ).collect()
    assert [r.lin for r in got] == [1, 1.5, 2, 2.5] and [r.log for r in got] == [3, 6, 12, 24]
    assert [r.exp for r in got] == pytest.approx([1, np.log10(20), np.log10(30), np.log10(40)])
    assert [r.fits for r in got] == [None, True, False, None]


def test_rules_need_all_their_conditions(spark):
    cases = special_cases.special_cases(spark)
    assert cases.select("priority").distinct().count() == sum(len(c) for _, _, _, c in special_cases.CASES) >= 50
    two = spark.createDataFrame([(1, "s", "a", "equals", "x", None, None, "F", "first"), (1, "s", "b", "interval", None, 1.0, 2.0, "F", "first"), (2, "s", "a", "starts", "x", None, None, "F", "second")], rules.RULES)
    rows = spark.createDataFrame([("x", "1.5"), ("x", "3"), (None, "1.5"), ("xy", None), ("x", "1.5")], "a string, b string")
    got = [r.override.get("F") for r in rules.overrides(rows, two, "s", ["a", "b"]).collect()]
    assert sorted(map(str, got)) == ["None", "first", "first", "second", "second"]
    assert rules.overrides(rows, two.limit(0), "s", ["a", "b"]).first().override == {}
    with pytest.raises(ValueError):
        rules.overrides(rows, two, "s", ["a", "b"], most_rules=2)


def test_kinds_of_null_names_and_too_many_terms(spark):
    got = spark.createDataFrame([(None, None), ("IMAGE", None), (None, "x.fits")], "n string, f string").select(metadata.object_kind(F.col("n"), F.col("f")).alias("k")).collect()
    assert [r.k for r in got] == ["unknown", "image", "fits"]
    meta = spark.createDataFrame([("A",), ("A",), (None,)], "key string")
    terms = spark.createDataFrame([("A",), ("A",), (None,), ("B",)], "term string")
    assert {r.term: r.key for r in metadata.fuzzy_keys(meta, terms).collect()} == {"A": "A", "B": "A"}
    with pytest.raises(ValueError):
        metadata.fuzzy_keys(meta, terms, most_terms=1)


def test_grey_map_lines_make_a_file(spark):
    rows = spark.createDataFrame([(1, 0, [0, 255]), (1, 1, [16, 32]), (2, 0, [7])], "image int, line int, samples array<int>")
    lines = sinks.grey_map_lines(rows, ["image"]).orderBy("image", "line").collect()
    assert b"".join(r.content for r in lines if r.image == 1) == b"P5\n2 2\n255\n\x00\xff\x10\x20"
    assert sinks.grey_map_lines(rows.limit(0), ["image"]).count() == 0


def test_fuzzy_keys_equal_all_comparisons(spark):
    """The pair filter changes nothing, also where the best key shares no pair with the term."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ABCD"), int(rng.integers(1, 9)))) for _ in range(60)] + ["ACBD", "XY"]
    terms = ["".join(rng.choice(list("ABCDE"), int(rng.integers(1, 9)))) for _ in range(25)] + ["AXBYCZ", "Q", "ZZZZ", words[0]]

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b))

    got = {r.term: (r.key, r.ratio) for r in metadata.fuzzy_keys(spark.createDataFrame([(w,) for w in words], "key string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    for t in set(terms):
        best = min((-ratio(t, k), k) for k in set(words))
        assert got[t] == (best[1], pytest.approx(-best[0])), t


def test_headers_carried_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK_LINES", 3)
    rows = [("f", k, kind, None if kind == "d" else f"h{k}") for k, kind in enumerate("ddhddhdhhdddddddhdd")] + [("g", 0, "d", None)]
    df = spark.createDataFrame(rows, "file string, row long, kind string, x string").repartition(4)
    got = sorted((r.row, r.header_x) for r in rules.filled_headers(df, "file", "row", F.col("kind") == "h", ["x"], 2).collect())
    assert got == [(3, "h2"), (4, "h2"), (17, "h16"), (18, "h16")]
    assert rules.filled_headers(df.limit(0), "file", "row", F.col("kind") == "h", ["x"], 2).count() == 0
    monkeypatch.setattr(records, "BLOCK", 4)
    numbered = records.numbered(df.where("row % 3 = 0"), "file", "row").collect()
    assert sorted((r.file, r.row) for r in numbered) == [("f", k) for k in range(7)] + [("g", 0)]
