"""Files of headers and data units: the chain of headers, tables by their own forms, images.

Only headers are read to find the units: where one begins follows from the header before it, so a task walks along each of
its files, some kilobytes a unit. Cards, forms and offsets are Spark expressions; data go by byte ranges like any other object's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrerylake.functions import vectorized
from orrerylake.operators import formats

from . import ranges, records

BLOCK = 2880
#: Blocks of one header at most; a longer one is an error.
MOST_BLOCKS = 10_000
_NUMBER = re.compile(rb"^([A-Z0-9]+) *= *(-?[0-9]+)")


_UNIT = pa.schema([("file", pa.string()), ("unit", pa.int32()), ("header_at", pa.int64()), ("header", pa.string()), ("data_at", pa.int64()), ("data_bytes", pa.int64())])


def data_bytes(header: bytes) -> int:
    """Bytes of the data behind a header, without what fills the last block."""
    facts = {m[1].decode(): int(m[2]) for k in range(0, len(header), records.CARD) if (m := _NUMBER.match(header[k : k + records.CARD]))}
    axes = [facts.get(f"NAXIS{i}", 0) for i in range(1, facts.get("NAXIS", 0) + 1)]
    if not axes:
        return 0
    return abs(facts.get("BITPIX", 8)) // 8 * facts.get("GCOUNT", 1) * (facts.get("PCOUNT", 0) + math.prod(axes))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            try:
                fs, path = ranges._file_system(name)
                file = fs.open_input_file(path)
            except FileNotFoundError:
                continue
            found, at = [], 0
            with file:
                size = file.size()
                while at + BLOCK <= size:
                    first = file.read_at(BLOCK, at)
                    if not first.startswith(b"SIMPLE  =" if at == 0 else b"XTENSION="):
                        break
                    header = first
                    while not any(header[k : k + 8] == b"END     " for k in range(len(header) - BLOCK, len(header), records.CARD)):
                        if len(header) >= MOST_BLOCKS * BLOCK:
                            raise ValueError(f"a header of {name} has no end")
                        more = file.read_at(min(BLOCK, size - at - len(header)), at + len(header))
                        if len(more) < BLOCK:
                            raise ValueError(f"a header of {name} has no end")
                        header += more
                    length = data_bytes(header)
                    found.append((name, len(found), at, header.decode("latin-1"), at + len(header), length))
                    at += len(header) + -(-length // BLOCK) * BLOCK
            yield pa.RecordBatch.from_pylist([dict(zip(_UNIT.names, u, strict=True)) for u in found], _UNIT)


def units(files: DataFrame, file: str = "file") -> DataFrame:
    """(file, unit, header_at, header, data_at, data_bytes): the header-and-data units of each file, from 0.

    A file that does not begin like one has no units, and neither has a missing one; what follows the last unit is passed over. A header without an end raises an error.
    """
    return files.select(F.col(file)).where(F.col(file).isNotNull()).mapInArrow(_walked, "file string, unit int, header_at bigint, header string, data_at bigint, data_bytes bigint")


def headers(found: DataFrame) -> DataFrame:
    """(file, unit, name, seq, key, value, comment) of all cards; blank keys go, undefined values are null.

    name: EXTNAME, else PRIMARY for the first unit, else the kind of extension; units of one name in a file are NAME_0, NAME_1.
    """
    cards = found.select("file", "unit", records.cards(F.col("header")).alias("cards"))
    first = lambda key: F.get(F.filter("cards", lambda c: c["key"] == key), F.lit(0))["value"]
    named = cards.withColumn("_name", F.coalesce(F.nullif(F.trim(first("EXTNAME")), F.lit("")), F.when(F.col("unit") == 0, "PRIMARY"), F.trim(first("XTENSION")), F.lit("UNIT")))
    unique = formats.unique_names(named, ["file"], ["unit"], "_name", None)
    return unique.select("file", "unit", F.col("unique").alias("name"), F.posexplode("cards").alias("seq", "c")).select("file", "unit", "name", "seq", "c.key", "c.value", "c.comment")


#: Letters of binary table forms: kind, bytes of one element, whether it is signed.
LETTERS = {"L": ("logical", 1, False), "X": ("bits", 0, False), "B": ("integer", 1, False), "I": ("integer", 2, True), "J": ("integer", 4, True), "K": ("integer", 8, True), "A": ("text", 1, False), "E": ("ieee", 4, False), "D": ("ieee", 8, False), "C": ("ieee", 4, False), "M": ("ieee", 8, False), "P": ("void", 8, False), "Q": ("void", 16, False)}
_KEYS = ["TTYPE", "TFORM", "TSCAL", "TZERO", "TBCOL"]


def table_fields(cards: DataFrame) -> DataFrame:
    """(file, unit, fingerprint, fields): the format of each table unit, from the forms of its columns.

    Binary tables: cells of several values become NAME_0, NAME_1, ...; complex ones NAME_0 (real), NAME_1. Tables of text: by column and width.
    Repeated column names are numbered, columns without a name are COLn. TSCAL and TZERO are scale and offset. A form without a reading stays as bytes.
    """
    parts = cards.withColumn("_k", F.regexp_extract("key", f"^({'|'.join(_KEYS)})([0-9]+)$", 1)).withColumn("n", F.regexp_extract("key", "^[A-Z]+([0-9]+)$", 1).try_cast("int"))
    kinds = cards.where("key = 'XTENSION'").select("file", "unit", F.trim("value").alias("_kind"))
    wide = parts.where("_k != ''").groupBy("file", "unit", "n").agg(*[F.max(F.when(F.col("_k") == k, F.trim("value"))).alias(k) for k in _KEYS]).where("TFORM IS NOT NULL").join(kinds, ["file", "unit"])
    is_text = F.col("_kind") == "TABLE"
    letter = F.when(is_text, F.regexp_extract("TFORM", "^([A-Z])", 1)).otherwise(F.regexp_extract("TFORM", "^[0-9]*([A-Z])", 1))
    count = F.coalesce(F.regexp_extract("TFORM", "^([0-9]+)", 1).try_cast("int"), F.lit(1))
    table = F.create_map(*[x for c, (kind, width, signed) in LETTERS.items() for x in (F.lit(c), F.struct(F.lit(kind).alias("kind"), F.lit(width).alias("width"), F.lit(signed).alias("is_signed")))])
    code = F.coalesce(table[F.col("_letter")], F.struct(F.lit("void").alias("kind"), F.lit(1).alias("width"), F.lit(False).alias("is_signed")))
    text_kind = F.when(F.col("_letter") == "I", "ascii_integer").when(F.col("_letter").isin("F", "E", "D"), "ascii_real").otherwise("text")
    held = wide.withColumns({"_letter": letter, "_count": count}).withColumn("_code", code)
    whole = F.when(F.col("_letter") == "X", F.ceil(F.col("_count") / 8).cast("int")).when(F.col("_letter").isin("A", "P", "Q"), F.when(F.col("_letter") == "A", F.col("_count")).otherwise(F.col("_code.width") * F.least("_count", F.lit(1))))
    each = F.when(F.col("_letter").isin("C", "M"), F.col("_count") * 2).otherwise(F.col("_count"))
    bytes_ = F.when(is_text, F.regexp_extract("TFORM", "^[A-Z]([0-9]+)", 1).try_cast("int")).otherwise(F.coalesce(whole, each * F.col("_code.width")))
    sized = held.withColumns({"_bytes": bytes_.cast("int"), "_items": F.when(is_text | whole.isNotNull(), 1).otherwise(each).cast("int")})
    before = F.coalesce(F.sum("_bytes").over(Window.partitionBy("file", "unit").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("SB_OFFSET", F.when(is_text, F.col("TBCOL").try_cast("int") - 1).otherwise(before).cast("int"))
    cells = placed.withColumn("item", F.explode(F.when(F.col("_items") > 0, F.sequence(F.lit(0), F.col("_items") - 1)).otherwise(F.array().cast("array<int>"))))
    width = F.try_divide("_bytes", "_items").cast("int")
    one = F.struct(
        F.when(is_text, text_kind).otherwise(F.col("_code.kind")).alias("kind"),
        (F.col("SB_OFFSET") + F.col("item") * width + 1).cast("int").alias("start"), width.alias("width"), F.col("_code.is_signed").alias("is_signed"),
        F.nullif(F.col("TSCAL").try_cast("double"), F.lit(1.0)).alias("scale"), F.nullif(F.col("TZERO").try_cast("double"), F.lit(0.0)).alias("offset"),
    )
    rows = cells.where(width > 0).select("file", "unit", one.alias("f"), F.coalesce(F.nullif("TTYPE", F.lit("")), F.concat(F.lit("COL"), F.col("n").cast("string"))).alias("_name"), "n", "item")
    named = formats.unique_names(rows, ["file", "unit"], ["n", "item"], "_name", None)
    ordered = named.groupBy("file", "unit").agg(F.array_sort(F.collect_list(F.struct("n", "item", "unique", "f"))).alias("_all"))
    fields = F.transform("_all", lambda x: F.struct(x["unique"].alias("name"), x["f"]["kind"].alias("kind"), F.lit("big").alias("order"), x["f"]["start"].alias("start"), x["f"]["width"].alias("width"), x["f"]["is_signed"].alias("is_signed"), x["f"]["scale"].alias("scale"), x["f"]["offset"].alias("offset")))
    return ordered.select("file", "unit", fields.cast(formats.FORMAT).alias("fields")).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))


def _facts(cards: DataFrame, keys: list[str]) -> DataFrame:
    """(file, unit, name, keys in lower case as numbers)."""
    return cards.groupBy("file", "unit", "name").agg(*[F.min_by("value", F.when(F.col("key") == k, F.col("seq"))).try_cast("double").alias(k.lower()) for k in keys])


def table_rows(found: DataFrame, cards: DataFrame, fmts: DataFrame, columns: dict[str, str] | None = None, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, name, row, columns): the rows of all table units, whatever their forms; see ``formats.decoded_by_format``."""
    columns = formats.merged_schema(fmts) if columns is None else columns
    facts = _facts(cards, ["NAXIS1", "NAXIS2"])
    held = found.select("file", "unit", "data_at").join(facts, ["file", "unit"]).join(fmts, ["file", "unit"]).where("naxis1 > 0 AND naxis2 > 0")
    record = F.col("naxis1").cast("int")
    planned = ranges.planned(held.withColumns({"record_bytes": record, "skip_bytes": F.lit(0)}), F.col("data_at"), F.col("naxis1").cast("long") * F.col("naxis2").cast("long"), record, range_bytes)
    return formats.decoded_by_format(ranges.dealt(planned, task_bytes=ranges.DECODED_TASK_BYTES), ["file", "name"], columns)


def image_lines(found: DataFrame, cards: DataFrame, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, name, band, line, samples array<double>): all image units with two axes or more, the axes behind the second as bands.

    BSCALE and BZERO are applied; whole numbers that equal BLANK are null. Units without data have no rows.
    """
    asked = ["BITPIX", "NAXIS", *[f"NAXIS{i}" for i in range(1, 8)], "BSCALE", "BZERO", "BLANK"]
    kinds = cards.groupBy("file", "unit").agg(F.max(F.when(F.col("key") == "XTENSION", F.trim("value"))).alias("_kind"))
    facts = _facts(cards, asked).join(kinds, ["file", "unit"]).where("coalesce(_kind, 'IMAGE') = 'IMAGE' AND naxis >= 2 AND bitpix IN (8, 16, 32, 64, -32, -64)")
    bands = F.lit(1.0)
    for i in range(3, 8):
        bands = bands * F.when(F.col("naxis") >= i, F.coalesce(F.col(f"naxis{i}"), F.lit(0.0))).otherwise(F.lit(1.0))
    pixel = (F.abs("bitpix") / 8).cast("int")
    held = found.select("file", "unit", "data_at").join(facts, ["file", "unit"]).select(
        "file", "name", "data_at", "bscale", "bzero", F.when(F.col("bitpix") > 0, F.col("blank")).alias("blank"), F.col("naxis2").cast("int").alias("lines"), F.col("naxis1").cast("int").alias("line_samples"), bands.cast("int").alias("bands"),
        F.lit("BAND_SEQUENTIAL").alias("order"), F.lit(0).alias("prefix"), F.when(F.col("bitpix") < 0, "ieee").otherwise("integer").alias("kind"), F.lit("big").alias("byte_order"), pixel.alias("pixel_bytes"), (F.col("bitpix") > 8).alias("is_signed"),
        (F.col("naxis1") * pixel).cast("int").alias("record_bytes"),
    )
    length = F.col("record_bytes").cast("long") * F.col("lines") * F.col("bands")
    planned = ranges.planned(held.where("record_bytes > 0"), F.col("data_at"), length, F.col("record_bytes"), range_bytes)
    keys = ["file", "name", "bscale", "bzero", "blank"]
    schema = StructType([*planned.select(*keys).schema.fields, *StructType.fromDDL("band int, line int, samples array<double>").fields])
    raw = ranges.dealt(planned, task_bytes=ranges.DECODED_TASK_BYTES).mapInArrow(vectorized.image_decoder(keys, "file"), schema)

    def scaled(x: Column) -> Column:
        return F.when(x == F.col("blank"), F.lit(None).cast("double")).otherwise(x * F.coalesce("bscale", F.lit(1.0)) + F.coalesce("bzero", F.lit(0.0)))

    return raw.select("file", "name", "band", "line", F.transform("samples", scaled).alias("samples"))
