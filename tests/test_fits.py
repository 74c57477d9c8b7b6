"""Header-and-data units made byte by byte."""

import struct

import numpy as np
import pytest

from orrerylake.sources import fits


def header(*cards):
    return "".join(c.ljust(80) for c in (*cards, "END")).encode().ljust(2880 * -(-80 * (len(cards) + 1) // 2880))


def block(body, fill=b"\0"):
    return body.ljust(-(-len(body) // 2880) * 2880, fill)


def number(key, value):
    return f"{key:<8}= {value:>20}"


def card_rows(spark, path):
    found = fits.units(spark.createDataFrame([(str(path),)], "file string"))
    return found, fits.headers(found)


def test_one_image_in_the_first_unit(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.poisson(100, (100, 100)).clip(0, 255).astype(np.uint8)
    path = tmp_path / "p.fits"
    path.write_bytes(header("SIMPLE  =                    T", number("BITPIX", 8), number("NAXIS", 2), number("NAXIS1", 100), number("NAXIS2", 100), "EXTNAME = 'POISSON '") + block(image.tobytes()))
    found, cards = card_rows(spark, path)
    got = {(r.name, r.band, r.line): r.samples for r in fits.image_lines(found, cards, range_bytes=333).collect()}
    assert got == {("POISSON", 0, k): image[k].astype(float).tolist() for k in range(100)}


def test_chain_of_many_kinds(spark, tmp_path):
    cube = np.arange(24).reshape(2, 3, 4).astype(">f4")
    cells = b"".join(struct.pack(">B?hiqfd4s3s", k, False, -k, k, -(2**40) * k, k / 2, k / 4, b"ab", bytes([0b10110000, 1, 2])) + struct.pack(">ff", k, -k) + b"T" for k in range(3))
    width = len(cells) // 3
    forms = [("A", "B"), ("GAP", "1L"), ("I", "I"), ("J", "J"), ("K", "K"), ("E", "E"), ("D", "D"), ("S", "4A"), ("X", "12X"), ("R", "1B"), ("C", "C"), ("", "L"), ("NONE", "0J")]
    table = ["XTENSION= 'BINTABLE'", number("BITPIX", 8), number("NAXIS", 2), number("NAXIS1", width), number("NAXIS2", 3), number("PCOUNT", 10), number("GCOUNT", 1), number("TFIELDS", len(forms))]
    for k, (name, form) in enumerate(forms, 1):
        table += [f"TTYPE{k:<3}= '{name}'"] * bool(name) + [f"TFORM{k:<3}= '{form}'"]
    empty = ["XTENSION= 'IMAGE   '", number("BITPIX", 16), number("NAXIS", 0), "EXTNAME = 'SAME'", "COMMENT with = and / in it", "HIERARCH"]
    path = tmp_path / "m.fits"
    path.write_bytes(
        header("SIMPLE  =                    T", number("BITPIX", -32), number("NAXIS", 3), number("NAXIS1", 4), number("NAXIS2", 3), number("NAXIS3", 2), *["COMMENT long"] * 50) + block(cube.tobytes())
        + header(*table) + block(cells + b"heap" * 2 + b"!!") + header(*empty) + header(*empty, "EXTVER  = 2 / two") + b"trailing"
    )
    found, cards = card_rows(spark, path)
    assert [(r.unit, r.data_bytes) for r in found.orderBy("unit").collect()] == [(0, 96), (1, 3 * width + 10), (2, 0), (3, 0)]
    assert sorted({(r.unit, r.name) for r in cards.collect()}) == [(0, "PRIMARY"), (1, "BINTABLE"), (2, "SAME_0"), (3, "SAME_1")]
    assert {(r.value, r.comment) for r in cards.where("key = 'EXTVER'").collect()} == {("2", "two")}
    lines = {(r.band, r.line): r.samples for r in fits.image_lines(found, cards, range_bytes=1).collect()}
    assert lines == {(b, k): cube[b, k].astype(float).tolist() for b in range(2) for k in range(3)}
    rows = fits.table_rows(found, cards, fits.table_fields(cards), range_bytes=width).orderBy("row").collect()
    for k, r in enumerate(rows):
        assert (r.A, r.I, r.J, r.K, r.E, r.D, r.S.rstrip("\0"), r.X, r.R, r.C_0, r.C_1, r.COL12) == (k, -k, k, -(2**40) * k, k / 2, k / 4, "ab", "1011000000000001", 2, k, -k, True)
    assert len(rows) == 3 and "NONE" not in rows[0]


def test_blank_and_scaled_pixels(spark, tmp_path):
    path = tmp_path / "s.fits"
    path.write_bytes(header("SIMPLE  =                    T", number("BITPIX", 16), number("NAXIS", 2), number("NAXIS1", 3), number("NAXIS2", 1), number("BZERO", "32768.0"), number("BLANK", -5)) + block(struct.pack(">3h", -32768, -5, 7)))
    found, cards = card_rows(spark, path)
    assert fits.image_lines(found, cards).first().samples == [0.0, None, 32775.0]


def test_files_that_are_none(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "text").write_bytes(b"hello" * 1000)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("empty", "text", "missing")] + [(None,)], "file string")
    found = fits.units(files)
    cards = fits.headers(found)
    assert found.count() == cards.count() == fits.image_lines(found, cards).count() == fits.table_rows(found, cards, fits.table_fields(cards)).count() == 0
    (tmp_path / "open").write_bytes(b"SIMPLE  =                    T".ljust(2880))
    with pytest.raises(Exception, match="has no end"):
        fits.units(spark.createDataFrame([(str(tmp_path / "open"),)], "file string")).collect()
