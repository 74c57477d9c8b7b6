"""From labels to rows: every object that labels point at, at its place in its file, by the format its label gives.

catalogue -> object table (file, start, length, facts of the block) -> byte ranges -> tables, image lines, texts. No step works on one
product at a time, and no format passes through the driver but as column names and types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrerylake.functions import binary, text, vectorized
from orrerylake.operators import formats, readers, rules
from orrerylake.operators import metadata as M
from orrerylake.sources import files as file_sources
from orrerylake.sources import ranges, records

from . import ingest
from .scratch import kept
from .sinks import write_store

#: Facts of a product that readers and rules ask for.
FACTS = [*M.IDENTIFIERS, "SPACECRAFT_CLOCK_STOP_COUNT"]
#: Facts of an object's own block.
OF_BLOCK = ["BYTES", "ROWS", "ROW_BYTES", "ROW_PREFIX_BYTES", "ROW_SUFFIX_BYTES", "RECORDS", "INTERCHANGE_FORMAT", "FIELD_DELIMITER", "LINES", "LINE_SAMPLES", "SAMPLE_BITS", "SAMPLE_TYPE", "BANDS", "BAND_STORAGE_TYPE", "LINE_PREFIX_BYTES", "LINE_SUFFIX_BYTES"]
#: Columns that rules may ask for, beside the identifiers.
OF_RULES = [*[k.lower() for k in FACTS], "name", "file", "interchange", "clock"]


@dataclass(frozen=True)
class Archive:
    """The catalogue of an archive, as tables in the shared folder: the long metadata table, the objects, and the formats of its tables."""

    meta: DataFrame
    objects: DataFrame
    formats: DataFrame


def opened(spark: SparkSession, path: str, glob: str = "*.{lbl,LBL}", special: DataFrame | None = None) -> Archive:
    """The archive of all labels below ``path``. Each table is written once, so that what reads them plans and computes nothing again."""
    meta = kept(ingest.catalogue(spark, path, glob), "metadata")
    objects = kept(object_table(meta, file_sources.scan(spark, path), special), "objects")
    return Archive(meta, objects, kept(format_table(meta, objects), "formats"))


def _folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def object_table(meta: DataFrame, files: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """One row for each object that a label points at: product, name, kind, reader, file (null if there is none), file_size, as_rows, start, length,
    block_at, is_ascii, and the facts of its block in lower case.

    ``meta``: the long metadata table of labels whose product is their path; ``files``: path, length. A name without a folder is looked for beside
    the label, in any case; a pointer without a file points into the label's own. Objects are matched with blocks of the same name, repeated ones by
    their numbers. ``special``: rules (see ``rules.RULES``) of the stages ``kind``, ``reader``, ``block`` and ``start byte``, which win over the label. Lengths are cut at the
    file's end. Null pointers, labels without objects and empty tables give no rows.
    """
    pointed = ingest.objects(meta).where(~M.is_trivial(F.col("name")))
    facts = M.identifiers(meta, "product", FACTS)
    blocks = M.numbered_blocks(formats.block_table(meta, "product"), "product").select("product", F.col("indexed").alias("name"), F.col("at").alias("block_at"), *[F.col(k).alias(f"block_{k.lower()}") for k in OF_BLOCK])
    found = pointed.join(facts, "product", "left").join(blocks, ["product", "name"], "left")
    asked = found.withColumn("_path", F.when(F.col("file").isNull(), F.col("product")).when(F.col("file").contains("/"), F.col("file")).otherwise(F.concat(_folder_of(F.col("product")), F.col("file"))))
    sizes = files.select(F.col("path").alias("_file"), F.col("length").alias("file_size")).distinct()
    there = file_sources.resolved(asked, files, "_path", "path").withColumnsRenamed({"file": "named_file", "resolved": "file"}).drop("hits", "_path")
    rows = there.join(sizes, F.col("file") == F.col("_file"), "left").drop("_file").withColumns({"interchange": F.col("block_interchange_format"), "clock": F.col("spacecraft_clock_stop_count")})

    def overridden(frame: DataFrame, stage: str) -> DataFrame:
        if special is None:
            return frame.withColumn("override", F.expr("CAST(map() AS MAP<STRING, STRING>)"))
        renamed = frame.withColumnsRenamed({"file": "_resolved", "named_file": "file"})
        return rules.overrides(renamed, special, stage, OF_RULES).withColumnsRenamed({"file": "named_file", "_resolved": "file"})

    rows = overridden(rows, "kind").withColumn("kind", rules.patched(F.col("kind"), "KIND", "string")).drop("override")
    rows = overridden(rows, "reader").withColumns({"reader": rules.patched(F.lit(None).cast("string"), "READER", "string"), "skip_lines": rules.patched(F.lit(None).cast("long"), "SKIP_LINES", "long")}).drop("override")
    rows = overridden(rows, "block")
    number = ["rows", "row_bytes", "bytes", "row_prefix_bytes", "row_suffix_bytes"]
    rows = rows.withColumns({f"block_{k}": F.coalesce(F.when(F.col("override")[k.upper()] == "FILE_RECORDS", F.col("file_records").try_cast("int")), rules.patched(F.col(f"block_{k}"), k.upper(), "int")) for k in number}).drop("override")
    record_bytes = F.col("record_bytes").try_cast("long")
    whole_row = F.coalesce("block_row_prefix_bytes", F.lit(0)) + F.col("block_row_bytes") + F.coalesce("block_row_suffix_bytes", F.lit(0))
    target = F.struct(F.col("named_file").alias("file"), F.col("value"), F.col("units"))
    start = M.start_byte(target, record_bytes, F.col("block_row_bytes"), F.col("block_rows"), F.col("file_size"))
    # Pointers of some labels count records one too far, but for the one to the header.
    computed = F.when((F.col("override")["START_BYTE"] == "computed") & (F.col("name") != "IMAGE_HEADER"), record_bytes * (F.col("value") - 2))
    rows = overridden(rows, "start byte").withColumn("_start", F.coalesce(computed, rules.patched(start, "START_BYTE", "long"))).drop("override", "clock")

    image = image_facts()
    length = (
        F.when(F.col("kind") == "image", image["record_bytes"].cast("long") * image["records"])
        .when(F.col("kind") == "table", F.coalesce(F.col("block_rows").cast("long") * whole_row, M.table_length(F.col("block_bytes"), F.col("block_records"), record_bytes, whole_row, F.lit(0))))
        .otherwise(F.coalesce(F.col("block_bytes").cast("long"), F.col("block_records").cast("long") * record_bytes))
    )
    position = M.table_position(F.col("name"), F.col("record_type"), target, F.col("_start"), length, record_bytes, F.col("block_rows").cast("long"))
    is_ascii = F.coalesce((F.upper("block_interchange_format") == "ASCII") | F.upper("name").rlike("SPREADSHEET|ASCII"), F.lit(False))
    rest = F.greatest(F.col("file_size") - F.col("p.start"), F.lit(0).cast("long"))
    return rows.withColumn("p", position).withColumns(
        {
            "as_rows": F.col("p.as_rows"), "start": F.col("p.start"), "is_ascii": is_ascii, "row_bytes_whole": whole_row,
            "length": F.when(F.col("p.as_rows"), F.col("p.length")).when(F.col("file_size").isNotNull(), F.least(F.coalesce(F.col("p.length"), rest), rest)),
        }
    ).drop("p", "_start")


def image_facts() -> Column:
    """struct of an image's layout from its block: records of lines, their bytes, what one pixel is."""
    bands, bits = F.coalesce("block_bands", F.lit(1)), F.col("block_sample_bits")
    order = F.when(bands == 1, "BAND_SEQUENTIAL").otherwise(F.coalesce("block_band_storage_type", F.lit("BAND_SEQUENTIAL")))
    pixel = (bits / 8).cast("int")
    by_sample = order == "SAMPLE_INTERLEAVED"
    code = binary.type_code(F.coalesce("block_sample_type", F.lit("UNSIGNED_INTEGER")), pixel)
    prefix, suffix = F.coalesce("block_line_prefix_bytes", F.lit(0)), F.coalesce("block_line_suffix_bytes", F.lit(0))
    return F.struct(
        F.col("block_lines").alias("lines"), F.col("block_line_samples").alias("line_samples"), bands.alias("bands"), order.alias("order"), prefix.alias("prefix"), pixel.alias("pixel_bytes"),
        code["kind"].alias("kind"), code["order"].alias("byte_order"), code["is_signed"].alias("is_signed"),
        (prefix + suffix + F.col("block_line_samples") * pixel * F.when(by_sample, bands).otherwise(1)).alias("record_bytes"), (F.col("block_lines").cast("long") * F.when(by_sample, 1).otherwise(bands)).alias("records"),
    )


def format_table(meta: DataFrame, objects: DataFrame) -> DataFrame:
    """(product, block_at, fingerprint, fields): the format of each table object, as data."""
    fields = formats.fields_of_blocks(meta, "product").withColumnRenamed("object_at", "block_at")
    text_tables = objects.where("kind = 'table' AND block_at IS NOT NULL").groupBy("product", "block_at").agg(F.max("is_ascii").alias("is_ascii"))
    return formats.fingerprinted(fields.join(text_tables, ["product", "block_at"]), ["product", "block_at"])


def table_rows(objects: DataFrame, fmts: DataFrame, columns: dict[str, str] | None = None, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(product, name, fingerprint, row, columns): the rows of all tables of fixed records, whatever their formats, in one pass.

    ``columns``: names and types of all formats together (default: of ``fmts``, one look at their distinct columns). Tables that are delimited, counted in
    rows or have a special reader are not in it: see ``readers``. A table without a format, a row size or a file has no rows.
    """
    columns = formats.merged_schema(fmts) if columns is None else columns
    tables = objects.where("kind = 'table' AND reader IS NULL AND NOT as_rows AND file IS NOT NULL AND row_bytes_whole > 0 AND block_field_delimiter IS NULL")
    held = tables.join(fmts, ["product", "block_at"]).select("product", "name", "fingerprint", "fields", "file", "start", "length", F.col("row_bytes_whole").alias("record_bytes"), F.coalesce("block_row_prefix_bytes", F.lit(0)).alias("skip_bytes"))
    planned = ranges.planned(held, F.col("start"), F.col("length"), F.col("record_bytes"), range_bytes)
    return formats.decoded_by_format(ranges.dealt(planned, task_bytes=ranges.DECODED_TASK_BYTES), ["product", "name", "fingerprint"], columns)


def image_lines(objects: DataFrame, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(product, name, band, line, samples array<double>): the lines of all images, pads cut off, in any storage order.

    A range holds whole lines. Images without sizes, with a sample type that has no reading, or without a file have no rows; lines that the file does not
    hold whole are left out.
    """
    images = objects.where("kind = 'image' AND file IS NOT NULL").withColumn("i", image_facts()).where("i.record_bytes > 0 AND i.kind IN ('integer', 'ieee', 'vax', 'ibm')")
    planned = ranges.planned(images.select("product", "name", "file", "start", "length", "i.*"), F.col("start"), F.col("length"), F.col("record_bytes"), range_bytes)
    schema = StructType([*planned.select("product", "name").schema.fields, *StructType.fromDDL("band int, line int, samples array<double>").fields])
    return ranges.dealt(planned, task_bytes=ranges.DECODED_TASK_BYTES).mapInArrow(vectorized.image_decoder(["product", "name"], "file"), schema)


def _cells(found: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(product, name, fingerprint, row, columns) of rows with cells and the names of their fields."""
    names = F.transform("fields", lambda f: f["name"])

    def cell(name: str, type_: str) -> Column:
        raw = F.get("cells", F.array_position("_names", name).cast("int") - 1)
        at = F.get("fields", F.array_position("_names", name).cast("int") - 1)
        value = raw if type_ in ("string", "binary") else F.when(at["scale"].isNotNull() | at["offset"].isNotNull(), (raw.try_cast("double") * F.coalesce(at["scale"], F.lit(1.0)) + F.coalesce(at["offset"], F.lit(0.0))).try_cast(type_)).otherwise(raw.try_cast(type_))
        return value.cast(type_).alias(name)

    return found.withColumn("_names", names).select("product", "name", "fingerprint", "row", *[cell(c, t) for c, t in columns.items()])


def text_rows(objects: DataFrame, fmts: DataFrame, columns: dict[str, str] | None = None, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(product, name, fingerprint, row, columns): the rows of tables that are cut by lines, delimiters or a reader of their own.

    Beside those with a reader these are delimited tables and those whose place is counted in lines. They go to their block's BYTES, else to the file's end.
    Where rows are counted, by place or by a reader that numbers them, those beyond the label's ROWS are left out. Cells that have no reading in their column's type are null. A reader that does not exist raises an error. Each
    file is read once, by the group of readers that its tables need.
    """
    columns = formats.merged_schema(fmts) if columns is None else columns
    held = objects.where("kind = 'table' AND file IS NOT NULL AND (reader IS NOT NULL OR as_rows OR block_field_delimiter IS NOT NULL)").join(fmts, ["product", "block_at"])
    sep = F.when(F.col("block_field_delimiter").isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for pair in records.DELIMITERS.items() for x in pair])[F.col("block_field_delimiter")], F.raise_error(F.concat(F.lit("no delimiter is named "), "block_field_delimiter")).cast("string")))
    start = F.when(F.col("as_rows"), F.lit(0).cast("long")).otherwise(F.col("start"))
    end = F.when(~F.col("as_rows") & F.col("block_bytes").isNotNull(), F.least(start + F.col("block_bytes"), F.col("file_size"))).otherwise(F.col("file_size"))
    tables = held.select(
        "product", "name", "fingerprint", "fields", "file", readers.chosen(F.col("reader"), F.col("block_field_delimiter")).alias("reader"), sep.alias("delimiter"), F.col("row_bytes_whole").alias("record_bytes"),
        F.coalesce("skip_lines", F.when(F.col("as_rows"), F.col("start")), F.lit(0).cast("long")).alias("skip_lines"), F.when(F.col("as_rows") | ~F.coalesce(F.col("reader"), F.lit("delimited")).isin(readers.LINE_READERS), F.col("block_rows")).alias("_rows"), start.alias("object_start"), end.alias("object_end"),
    )
    key = ["product", "name"]
    out = None
    for names, read in readers.GROUPS:
        own = tables.where(F.col("reader").isin(names))
        planned = ranges.planned(own, F.col("object_start"), F.col("object_end") - F.col("object_start"), range_bytes=range_bytes)
        lines = ranges.line_numbers(ranges.lines(ranges.dealt(planned, task_bytes=ranges.DECODED_TASK_BYTES)), key)
        if read is readers.by_line:  # places counted in lines
            lines = lines.where("row >= skip_lines").withColumn("row", F.col("row") - F.col("skip_lines"))
        facts = own.select(*key, "fingerprint", "fields", "_rows")
        found = read(lines, key).select(*key, "row", "cells").join(facts, key).where("_rows IS NULL OR row < _rows")
        rows = _cells(found, columns)
        out = rows if out is None else out.unionByName(rows)
    return out


#: Bytes of a text object at most, as its readers take it.
TEXT_LIMIT = 80_000


def texts(objects: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """(product, name, text): headers, texts and descriptions, with LF line ends.

    By bytes: the first ``limit`` of the object, each byte a character of ISO 8859-1. By rows: the lines asked for, as UTF-8 with a replacement for what is none.
    Portable documents (.pdf) are no texts and are left out.
    """
    held = objects.where("kind IN ('text', 'header') AND file IS NOT NULL").where(~F.endswith(F.lower("file"), F.lit(".pdf")))
    by_bytes = ranges.planned(held.where("NOT as_rows").select("product", "name", "file", "start", F.least("length", F.lit(limit).cast("long")).alias("length")), F.col("start"), F.col("length"), range_bytes=limit)
    one = ranges.contents(ranges.dealt(by_bytes)).select("product", "name", text.canonical_lines(F.decode("content", "ISO-8859-1")).alias("text"))
    asked = held.where("as_rows").select("product", "name", "file", "file_size", F.col("start").alias("_from"), F.coalesce("length", F.lit((1 << 62))).alias("_n"), F.lit(0).cast("long").alias("object_start"), F.col("file_size").alias("object_end"))
    cut = ranges.line_numbers(ranges.lines(ranges.dealt(ranges.planned(asked, F.lit(0), F.col("file_size")))), ["product", "name"])
    line = F.try_validate_utf8(F.col("line").cast("string"))
    rows = cut.where("row >= _from AND row < _from + _n").select("product", "name", F.struct("row", F.coalesce(line, F.make_valid_utf8(F.col("line").cast("string"))).alias("line")).alias("l"))
    joined = rows.groupBy("product", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    return one.unionByName(joined)


def ingest_archive(of: Archive, out: str, range_bytes: int = ranges.RANGE_BYTES) -> None:
    """All tables and images of an archive to the columnar store: ``out``/tables by format, ``out``/images."""
    columns = formats.merged_schema(of.formats)
    rows = table_rows(of.objects, of.formats, columns, range_bytes).unionByName(text_rows(of.objects, of.formats, columns, range_bytes))
    write_store(rows, f"{out}/tables", ["fingerprint"])
    write_store(image_lines(of.objects, range_bytes).withColumn("object", F.col("name")), f"{out}/images", ["object"])
