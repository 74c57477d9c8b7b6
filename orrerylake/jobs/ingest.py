"""A whole archive to tables: labels to a catalogue, records of one format to a typed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.functions import binary, values
from orrerylake.operators import formats
from orrerylake.operators import metadata as M
from orrerylake.operators import statements as S
from orrerylake.sources import files, records

from .sinks import write_store


def catalogue(spark: SparkSession, path: str, glob: str = "*.{lbl,LBL}") -> DataFrame:
    """The long metadata table of every label below ``path``; the product is the label's path."""
    found = files.scan(spark, path, glob, with_content=True)
    labels = found.select(F.col("path").alias("product"), files.attached_label(F.col("content")).alias("label")).where("label is not null")
    return S.metadata(labels, "product", "label")


def objects(meta: DataFrame) -> DataFrame:
    """(product, name, kind, file, value, units): what each label's pointers say of its objects."""
    pointed = M.numbered_pointers(meta, "product")
    parts = values.parts_of_quantities(F.col("value_raw"))
    first, last = parts[0], F.try_element_at(parts, F.lit(-1))
    file = F.when(~first["value"].rlike("^[0-9]+$"), first["value"])
    target = pointed.select("product", F.col("indexed").alias("name"), file.alias("file"), last["value"].try_cast("bigint").alias("value"), last["units"].alias("units"))
    return target.withColumn("kind", M.object_kind(F.col("name"), F.coalesce("file", F.lit("x.dat"))))


def field_table(meta: DataFrame, block: str = "COLUMN") -> DataFrame:
    """(product, seq, NAME, DATA_TYPE, START_BYTE, BYTES, ITEMS, ITEM_BYTES, ITEM_OFFSET, code): columns as labels define them."""
    inside = F.try_element_at("path", F.lit(-1)) == block
    keys = ["NAME", "DATA_TYPE", "START_BYTE", "BYTES", "ITEMS", "ITEM_BYTES", "ITEM_OFFSET"]
    rows = meta.where(inside & F.col("key").isin(keys)).withColumn("seq", F.try_element_at("blocks", F.lit(-1)))
    wide = rows.groupBy("product", "seq").agg(*[F.first(F.when(F.col("key") == k, F.coalesce("value_string", "value_raw")), ignorenulls=True).alias(k) for k in keys])
    numbers = {k: F.col(k).try_cast("int") for k in keys[2:]}
    return wide.withColumns(numbers).withColumn("code", binary.type_code(F.col("DATA_TYPE"), F.col("BYTES")))


def format_of(fields: DataFrame, product: str) -> list[dict]:
    """One product's format as a short list for ``formats.decode_records``; names are made unique."""
    named = formats.unique_names(fields.where(F.col("product") == product), ["product"], ["seq"])
    return [{"name": r.unique, "kind": r.code.kind, "order": r.code.order, "start": r.START_BYTE, "width": r.BYTES, "is_signed": r.code.is_signed} for r in named.orderBy("seq").collect()]


def store_records(found: DataFrame, fmt: list[dict], out: str, data_set: str, name: str) -> None:
    """Records of one format (column record) to the columnar store."""
    decoded = formats.decode_batches(found, fmt)
    write_store(decoded.withColumns({"data_set": F.lit(data_set), "object": F.lit(name)}), out, ["data_set", "object"])


def ingest_binary(spark: SparkSession, data: str, fmt: list[dict], row_bytes: int, out: str, data_set: str, name: str) -> None:
    """All files of one format, which hold records only, to the columnar store."""
    store_records(records.read_fixed_records(spark, data, row_bytes), fmt, out, data_set, name)
