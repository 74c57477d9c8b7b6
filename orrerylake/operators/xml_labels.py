"""Labels in XML as rows: one for each element, with its place in the tree; searches are joins on places, and no schema is written by hand.

A place lists the ordinal of each element among its siblings, from the root (Dewey order): an element lies inside another if its
place begins with the other's, and places sort in document order. Only the reading of one label's text is a Python helper.
"""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_ELEMENTS = "seq int, depth int, path array<string>, place array<int>, key string, value string, attributes map<string,string>, leaf boolean, error string"
#: Elements that a task holds before it gives them on, about; those of one label stay together.
AT_ONCE = 5_000


def _elements(text: str) -> list[dict]:
    """The elements of one label in document order; one row with an error if it is not well-formed."""
    rows: list[dict] = []
    stack: list[dict] = []
    texts: list[list[str]] = []

    def bare(name: str) -> str:
        return name.rsplit(":", 1)[-1]

    def start(name: str, attributes: dict[str, str]) -> None:
        above = stack[-1] if stack else None
        if above is not None:
            above["children"] += 1
            above["leaf"] = False
        row = {
            "seq": len(rows), "depth": len(stack), "path": [e["key"] for e in stack], "place": [*(above["place"] if above else []), above["children"] if above else 1], "key": bare(name), "value": None,
            "attributes": [(bare(k), v) for k, v in attributes.items() if not k.startswith("xmlns")], "leaf": True, "error": None, "children": 0,
        }
        rows.append(row)
        stack.append(row)
        texts.append([])

    def end(name: str) -> None:
        row, own = stack.pop(), " ".join("".join(texts.pop()).split())
        row["value"] = own or None

    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, lambda data: texts[-1].append(data) if texts else None
    try:
        parser.Parse(text.lstrip("﻿ \t\r\n").encode(), True)
    except xml.parsers.expat.ExpatError as e:
        return [{"seq": 0, "depth": 0, "path": [], "place": [], "key": None, "value": None, "attributes": [], "leaf": True, "error": str(e)}]
    return rows


def elements(labels: DataFrame, product: str, label: str) -> DataFrame:
    """(product, seq, depth, path, place, key, value, attributes, leaf, error): every element of every label.

    path: keys of the elements around; place: see above; value: own text, white space runs as one blank, null if there is none. Name spaces are taken off;
    comments play no part; references and CDATA are text. Repeated elements stay, in order. A label that is not well-formed gives one row with an error and
    a null key; null and empty labels give none. Repeated rows of ``labels`` give their elements again.
    """
    names = [f.name for f in StructType.fromDDL(_ELEMENTS).fields]
    asked = labels.select(F.col(product), F.col(label)).where(F.length(F.trim(F.col(label), F.lit("﻿ \t\r\n"))) > 0)
    types = StructType([StructField(product, asked.schema[product].dataType), *StructType.fromDDL(_ELEMENTS).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("seq", pa.int32()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("place", pa.list_(pa.int32())), ("key", pa.string()), ("value", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("leaf", pa.bool_()), ("error", pa.string())])

        def made(batch: pa.RecordBatch, owners: list[int], rows: list[dict]) -> pa.RecordBatch:
            own = batch.column(0).take(pa.array(owners, pa.int64()))
            return pa.RecordBatch.from_arrays([own, *[pa.array([r[f.name] for r in rows], f.type) for f in arrow]], names=[product, *names])

        for batch in batches:
            owners, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = _elements(text)
                owners.extend([k] * len(found))
                rows.extend(found)
                if len(rows) >= AT_ONCE:  # labels may be large
                    yield made(batch, owners, rows)
                    owners, rows = [], []
            if rows:
                yield made(batch, owners, rows)

    return asked.mapInArrow(read, types)


def as_metadata(found: DataFrame, product: str) -> DataFrame:
    """The long metadata table of the labels: each element as a parameter, blocks with a null value, so that lookups work as for any other label."""
    return found.where("key IS NOT NULL").select(product, "seq", "depth", "path", "key", F.col("value").alias("value_raw"), F.lit(True).alias("attached"))


def number(value: Column) -> Column:
    """struct<value_long, value_double> of a text: whole numbers exactly, others as double; null where it is none."""
    t = F.trim(value)
    return F.struct(F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint")).alias("value_long"), F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double")).alias("value_double"))


def _fits(path: str, names: Column) -> Column:
    """Whether the keys from an anchor (left out) down to an element are those of a search path."""
    anywhere = path.startswith(".//")
    steps = path.removeprefix(".//").removeprefix("./").split("/")
    if not all(steps):
        raise ValueError(f"{path} is no search path")
    n = len(steps)
    own = F.slice(names, F.greatest(F.size(names) - n + 1, F.lit(1)), F.lit(n))
    out = F.size(names) >= n if anywhere else F.size(names) == n
    for k, step in enumerate(steps):
        if step != "*":
            out = out & (F.get(own, F.lit(k)) == step)
    return out


def findall(found: DataFrame, product: str, path: str, under: DataFrame | None = None) -> DataFrame:
    """Elements that a search path leads to: ``a/b`` from an anchor's children down, ``.//a`` at any depth below it, ``*`` for any key.

    Anchors are the root elements, or those of ``under`` (product, place): then the column anchor has the anchor's place, and an element may come for several.
    Each element meets its anchors by equal places of its ancestors: a join on product and place.
    """
    keys = F.concat("path", F.array("key"))
    live = found.where("key IS NOT NULL")
    if under is None:
        return live.where("depth > 0").where(_fits(path, F.slice(keys, F.lit(2), F.size(keys))))
    anchors = under.select(F.col(product).alias("_product"), F.col("place").alias("anchor")).distinct()
    last = path.rsplit("/", 1)[-1]
    some = live if last == "*" else live.where(F.col("key") == last)
    above = some.where("depth > 0").withColumn("_level", F.explode(F.sequence(F.lit(1), F.size("place") - 1))).withColumn("_above", F.slice("place", F.lit(1), F.col("_level")))
    fits = above.where(_fits(path, F.slice(keys, F.col("_level") + 1, F.size(keys))))
    return fits.join(anchors, (F.col(product) == F.col("_product")) & (F.col("_above") == F.col("anchor"))).select(*found.columns, "anchor")


def findtext(found: DataFrame, product: str, path: str, under: DataFrame | None = None) -> DataFrame:
    """(product, anchor, value): the text of the first element in document order that the path leads to, for each anchor that has one; without ``under``, (product, value)."""
    by = [product] if under is None else [product, "anchor"]
    return findall(found, product, path, under).groupBy(*by).agg(F.min_by("value", "place").alias("value"))


#: The elements that hold files, in the order in which they are read, and the kinds of tables.
FILE_AREAS = ["File_Area_Observational", "File_Area_Observational_Supplemental", "File_Area_Ancillary", "File_Area_Browse", "File_Area_Inventory"]
TABLES = ["Table_Character", "Table_Binary", "Table_Delimited", "Inventory"]


def structures(found: DataFrame, product: str) -> DataFrame:
    """(product, place, file_name, kind, tag, id, offset): the headers, arrays and tables in the labels' file areas.

    id: the local identifier, else the name, else KIND_n, n counting all structures of the kind in reading order from 0. file_name is null where an area names none;
    offset is 0 where none is given.
    """
    rank = F.array_position(F.array(*map(F.lit, FILE_AREAS)), F.col("key"))
    areas = found.where((F.col("depth") == 1) & F.col("key").isin(FILE_AREAS)).select(product, F.col("place").alias("area"), rank.alias("_rank"))
    files = findtext(found, product, ".//file_name", areas.withColumnRenamed("area", "place")).select(product, F.col("anchor").alias("area"), F.col("value").alias("file_name"))
    kind = F.when(F.col("key").contains("Header"), "header").when(F.col("key").contains("Array"), "array").when(F.col("key").isin(TABLES), "table")
    held = found.where("depth = 2").withColumns({"kind": kind, "area": F.slice("place", 1, 2)}).where("kind IS NOT NULL").select(product, "area", "place", "kind", F.col("key").alias("tag"))
    inside = held.join(areas, [product, "area"]).join(files, [product, "area"], "left")
    facts = found.where("depth = 3 AND key IN ('local_identifier', 'name', 'offset')").groupBy(product, F.slice("place", 1, 3).alias("place")).agg(*[F.min_by("value", F.when(F.col("key") == k, F.col("place"))).alias(f"_{k}") for k in ("local_identifier", "name", "offset")])
    order = Window.partitionBy(product, "kind").orderBy("_rank", "place")
    default = F.concat_ws("_", F.upper("kind"), (F.row_number().over(order) - 1).cast("string"))
    full = inside.join(facts, [product, "place"], "left").withColumn("_default", default)
    return full.select(product, "place", "file_name", "kind", "tag", F.coalesce("_local_identifier", "_name", "_default").alias("id"), F.coalesce(F.col("_offset").try_cast("bigint"), F.lit(0).cast("long")).alias("offset"))
