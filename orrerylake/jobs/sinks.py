"""Outputs: tables as CSV, texts, image rows, and the columnar store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerylake.sources.image_files import ImageFiles


def output_name(product: Column, object_: Column, scaled: bool | None = None, band: Column | None = None) -> Column:
    """``<product>_<object>[_scaled|_unscaled][_<band>]``."""
    parts = [product, object_]
    if scaled is not None:
        parts.append(F.lit("scaled" if scaled else "unscaled"))
    if band is not None:
        parts.append(band.cast("string"))
    return F.concat_ws("_", *parts)


def turned(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A table of one row written as (name, value)."""
    return frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def write_csv(frame: DataFrame, path: str, by: list[str]) -> None:
    """One folder for each output. Rows are dealt by output, and large outputs are split over tasks when the sizes are known."""
    frame.hint("rebalance", *by).write.partitionBy(*by).option("header", "true").csv(path)


def write_text(frame: DataFrame, path: str, text: str, by: list[str]) -> None:
    """Texts as files of one folder for each output; null texts are left out."""
    frame.select(*by, F.col(text).alias("value")).where("value is not null").hint("rebalance", *by).write.partitionBy(*by).text(path)


def grey_map_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, content): the bytes of each image's portable grey map as its head, line -1, and one row for each line of pixels.

    Sorted by (by, line) they follow one another in the file, so no image need fit a row or a task. ``rows``: by, line, samples
    (bytes, all of one length in an image). An image without rows has no head.
    """
    pixels = F.unhex(F.array_join(F.transform("samples", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))
    sizes = rows.groupBy(*by).agg(F.max(F.size("samples")).alias("w"), F.count("*").alias("h"))
    head = F.concat(F.lit("P5\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n"))
    heads = sizes.select(*by, F.lit(-1).alias("line"), F.encode(head, "US-ASCII").alias("content"))
    return heads.unionByName(rows.select(*by, F.col("line").cast("int").alias("line"), pixels.alias("content")))


def write_grey_maps(cells: DataFrame, path: str, by: list[str], band: str | None = None, scaled: bool | None = None, byte: str = "byte") -> None:
    """One portable grey map for each image at ``path``: ``<by...>[_scaled|_unscaled][_<band>].pgm``; with ``band`` one for each of its bands.

    ``cells``: by, line, sample and bytes of pixels (null: 0). All segments of an image go to one task in order and are streamed into its file, so no image is held whole;
    files get their names when all are written. An image without cells has no file.
    """
    keys = [*by, *([band] if band else [])]
    named = cells.withColumn("_file", F.concat(output_name(F.concat_ws("_", *[F.col(b).cast("string") for b in by[:-1]]) if by[:-1] else F.col(by[-1]).cast("string"), F.col(by[-1]).cast("string") if by[:-1] else F.lit(None).cast("string"), scaled, F.col(band) if band else None), F.lit(".pgm")))
    lines = named.groupBy("_file", *keys, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", F.coalesce(byte, F.lit(0)).alias("b")))), lambda s: s["b"]).alias("samples"))
    segments = grey_map_lines(lines.select(F.col("_file").alias("file"), "line", "samples"), ["file"])
    segments.sparkSession.dataSource.register(ImageFiles)
    segments.repartition("file").sortWithinPartitions("file", "line").select("file", "content").write.format("image_files").option("path", path).mode("append").save()


def write_tables(frame: DataFrame, path: str, by: list[str]) -> None:
    """CSV outputs, a folder each; an output of one row is written turned, as (name, value).

    Which outputs have one row is asked of counts, one row an output. Turned and other outputs lie in ``path``/turned and ``path``/rows.
    """
    columns = [c for c in frame.columns if c not in by]
    counts = frame.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = frame.join(counts, by)
    write_csv(joined.where("_n > 1").drop("_n"), f"{path}/rows", by)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    write_csv(joined.where("_n = 1").select(*by, cells.alias("x")).select(*by, "x.*"), f"{path}/turned", by)


def write_labels(frame: DataFrame, path: str, label: str, by: list[str]) -> None:
    """Labels as files, those in XML in ``path``/xml, others in ``path``/txt; null ones are left out."""
    is_xml = F.col(label).rlike(r"^\s*<(\?xml|[A-Za-z_])")
    write_text(frame.where(is_xml), f"{path}/xml", label, by)
    write_text(frame.where(~is_xml), f"{path}/txt", label, by)


def write_store(frame: DataFrame, path: str, by: list[str]) -> None:
    """The columnar store of decoded objects, in folders by data set and object; large objects are split over tasks."""
    frame.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
