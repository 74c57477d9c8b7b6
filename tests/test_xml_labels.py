"""Labels in XML against the standard library's tree."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from orrerylake.operators import metadata
from orrerylake.operators import xml_labels as X

LABEL = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a comment -->
<p:Product_Observational xmlns="http://x/pds" xmlns:p="http://x/p">
  <Identification_Area><logical_identifier>urn:a:b</logical_identifier><title>A &lt;b&gt;  c
   d</title><empty/></Identification_Area>
  <File_Area_Browse><File><file_name>b.img</file_name></File><Array_2D><offset unit="byte">10</offset></Array_2D></File_Area_Browse>
  <File_Area_Observational><File><file_name>a.dat</file_name></File>
    <Header><name>H</name><offset unit="byte">0</offset></Header><Array_3D_Image><local_identifier>IMG</local_identifier><name>n</name><offset>5</offset></Array_3D_Image>
    <Array/><Table_Binary><Record_Binary><Field_Binary><name>f1</name></Field_Binary><Group_Field_Binary><Field_Binary><name><![CDATA[f<2]]></name></Field_Binary></Group_Field_Binary></Record_Binary></Table_Binary><Other/></File_Area_Observational>
  <File_Area_Observational><Table_Delimited/></File_Area_Observational>
</p:Product_Observational>
"""


def rows(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "p int, label string")


def test_elements_and_searches(spark):
    found = X.elements(rows(spark, [LABEL, None, "", " \n", "<a><b></a>", "﻿<a/>"]), "p", "label").cache()
    one = found.where("p = 0").orderBy("seq").collect()
    assert [r.place for r in one] == sorted(r.place for r in one) and one[0].key == "Product_Observational"
    by_key = {r.key: r for r in one}
    assert by_key["title"].value == "A <b> c d" and by_key["empty"].value is None and by_key["title"].path == ["Product_Observational", "Identification_Area"]
    assert by_key["offset"].attributes == {} and [r.attributes for r in one if r.key == "offset"][0] == {"unit": "byte"}
    assert [r.error is None for r in found.where("p = 4").collect()] == [False] and found.where("p IN (1, 2, 3)").count() == 0 and found.where("p = 5").first().key == "a"
    find = lambda path: [r.value for r in X.findall(found, "p", path).where("p = 0").orderBy("place").collect()]
    assert find(".//file_name") == ["b.img", "a.dat"] and find("Identification_Area/title") == ["A <b> c d"] and find("title") == [] and find("*/File/file_name") == ["b.img", "a.dat"]
    assert find(".//Field_Binary/name") == ["f1", "f<2"] and find("./Identification_Area/*") == ["urn:a:b", "A <b> c d", None]
    areas = found.where("p = 0 AND key LIKE 'File_Area%'")
    got = sorted((r.anchor, r.value) for r in X.findtext(found, "p", ".//name", areas).collect())
    assert got == [([1, 3], "H")]
    assert {r.value for r in X.findtext(found, "p", ".//offset").collect()} == {"10"}
    with pytest.raises(ValueError):
        X.findall(found, "p", "a//b")
    meta = X.as_metadata(found, "p")
    assert {r.value_raw for r in metadata.first_values(meta.where("p = 0"), "p", ["name"]).collect()} == {"H"}
    assert {(r.key, r.n) for r in metadata.key_counts(meta, "p").where("p = 0 AND repeated").collect()} >= {("File_Area_Observational", 2), ("name", 4)}
    assert X.elements(rows(spark, ["<a/>"]).limit(0), "p", "label").count() == 0


def test_structures(spark):
    found = X.elements(rows(spark, [LABEL, "<a/>"]), "p", "label")
    got = [(r.file_name, r.kind, r.tag, r.id, r.offset) for r in X.structures(found, "p").orderBy("place").collect()]
    assert got == [
        ("b.img", "array", "Array_2D", "ARRAY_2", 10), ("a.dat", "header", "Header", "H", 0), ("a.dat", "array", "Array_3D_Image", "IMG", 5), ("a.dat", "array", "Array", "ARRAY_1", 0),
        ("a.dat", "table", "Table_Binary", "TABLE_0", 0), (None, "table", "Table_Delimited", "TABLE_1", 0),
    ]


def test_random_trees_equal_the_standard_library(spark):
    rng = random.Random(7)

    def grow(node, depth):
        for _ in range(rng.randrange(0, 4) if depth < 5 else 0):
            child = ET.SubElement(node, rng.choice("abc"), {"k": rng.choice(['"', "<", "é"])} if rng.random() < 0.3 else {})
            child.text = rng.choice([None, " t ", "x & y", "<z>", "1.5"])
            grow(child, depth + 1)

    trees = []
    for _ in range(20):
        root = ET.Element("root")
        grow(root, 0)
        trees.append(root)
    found = X.elements(rows(spark, [ET.tostring(t, encoding="unicode") for t in trees]), "p", "label").cache()
    for path in ("a", "a/b", ".//c", ".//b/a", "*/b", ".//*"):
        want = {(k, e.tag, " ".join((e.text or "").split()) or None, tuple(e.attrib.items())) for k, t in enumerate(trees) for e in t.findall(path)}
        got = X.findall(found, "p", path).collect()
        assert {(r.p, r.key, r.value, tuple(r.attributes.items())) for r in got} == want
        assert len(got) == sum(len(t.findall(path)) for t in trees)


def test_numbers(spark):
    values = {"5": (5, 5.0), " -7 ": (-7, -7.0), "1e3": (None, 1000.0), ".5": (None, 0.5), "5 m": (None, None), "": (None, None), None: (None, None), "99999999999999999999": (None, 1e20), "NaN": (None, None)}
    got = {r.v: tuple(r.n) for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", X.number(F.col("v")).alias("n")).collect()}
    assert got == values
