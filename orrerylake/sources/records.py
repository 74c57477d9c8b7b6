"""Records: delimited, fixed width, separated by patterns, binary; headers of cards; irregular rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrerylake.functions.text import stripped

#: Places of a file whose rows one window numbers.
BLOCK = 10_000
#: Names of delimiters.
DELIMITERS = {"COMMA": ",", "VERTICAL_BAR": "|", "SEMICOLON": ";", "TAB": "\t"}


def delimiter(name: str | None) -> str:
    if name is None:
        return ","
    if name not in DELIMITERS:
        raise ValueError(f"no delimiter is named {name}")
    return DELIMITERS[name]


def delimited(lines: DataFrame, line: str, sep: str, names: list[str]) -> DataFrame:
    """One stripped text column for each field; quoted parts may hold the delimiter. Rows with another number of
    fields have nulls and ``fits`` false.
    """
    parts = F.from_csv(F.regexp_replace(line, "[\r\n]+$", ""), ", ".join(f"_{i} string" for i in range(len(names) + 1)), {"sep": sep, "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"})
    # Counted with the quoted parts taken out: an empty last field is a field too.
    fits = F.size(F.split(F.regexp_replace(F.col(line), '"[^"]*"', ""), "\\Q" + sep + "\\E", -1)) == len(names)
    return lines.select("*", parts.alias("_p")).select(*lines.columns, *[F.when(fits, stripped(F.col("_p")[f"_{i}"])).alias(n) for i, n in enumerate(names)], fits.alias("fits"))


def fixed_width(line: Column, start: int, width: int) -> Column:
    """A field by bytes: the line is cut before it is decoded, so that other letters do not shift it."""
    return stripped(F.decode(F.substring(line.cast("binary"), start, width), "UTF-8"))


def fixed_records(content: Column, record_bytes: int, n: Column | None = None) -> Column:
    """Records of fixed length from one file's bytes, by count and not by lines."""
    count = n if n is not None else F.floor(F.octet_length(content) / record_bytes).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(content, i * record_bytes + 1, F.lit(record_bytes)))).otherwise(F.array().cast("array<binary>"))


def read_fixed_records(spark: SparkSession, path: str, record_bytes: int, at_once: int = 4096) -> DataFrame:
    """(record) of files that hold nothing else; such files are split over many tasks.

    Python only joins ``at_once`` records to a block, and Spark cuts them again. A file of another length than a whole number of
    records raises an error; empty files give no records.
    """

    def blocks(rows: Iterable[bytes]) -> Iterator[tuple[bytearray]]:
        rows = iter(rows)
        while part := b"".join(islice(rows, at_once)):
            yield (bytearray(part),)

    joined = spark.sparkContext.binaryRecords(path, record_bytes).mapPartitions(blocks).toDF("block binary")
    return joined.select(F.explode(fixed_records(F.col("block"), record_bytes)).alias("record"))


def split_fields(line: Column, pattern: str = r"\s+") -> Column:
    """Fields between runs of white space, or by another pattern."""
    return F.split(F.trim(line, F.lit(" \t\r\n")), pattern)


def numbers_in(text: Column) -> Column:
    """Every signed number of a text as double."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def axes(position: Column, sizes: list[int]) -> list[Column]:
    """Places along each axis, the last one fastest, of a flat position."""
    out, rest = [], position
    for n in reversed(sizes):
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return out[::-1]


CARD = 80


def cards(header: Column) -> Column:
    """array<struct<key, value, comment>> of 80-byte cards; blank keys go, undefined values are null."""
    n = F.ceil(F.length(header) / CARD).cast("int")
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(header, i * CARD + 1, F.lit(CARD)))

    def card(x: Column) -> Column:
        body = F.substr(x, F.lit(11), F.lit(70))
        quoted = F.regexp_extract(body, r"^\s*'((?:[^']|'')*)'", 1)
        is_quoted = body.rlike(r"^\s*'")
        bare = F.trim(F.regexp_extract(body, r"^([^/]*)", 1))
        value = F.when(is_quoted, F.rtrim(F.regexp_replace(quoted, "''", "'"))).otherwise(F.nullif(bare, F.lit("")))
        comment = F.trim(F.regexp_extract(F.when(is_quoted, F.regexp_replace(body, r"^\s*'(?:[^']|'')*'", "")).otherwise(body), "/(.*)$", 1))
        return F.struct(F.trim(F.substring(x, 1, 8)).alias("key"), value.alias("value"), F.nullif(comment, F.lit("")).alias("comment"))

    return F.filter(F.transform(every, card), lambda c: ~c["key"].isin("", "END"))


def unit_at(objects: DataFrame, units: DataFrame, target: str, factors: tuple[int, ...] = (1, 2880)) -> DataFrame:
    """``objects`` with the header-and-data unit that starts at their target, taken as byte, else as record, from 1.

    Each distinct target is looked up once; repeated rows all stay, a null target has no unit.
    """
    asked = objects.select(F.col(target).alias("_target")).dropna().distinct()
    candidates = asked.select("_target", F.posexplode(F.array(*[(F.col("_target") - 1) * f for f in factors])).alias("_rank", "_at"))
    found = candidates.join(units.select(F.col("start").alias("_at"), "unit"), "_at").groupBy("_target").agg(F.min_by("unit", F.struct("_rank", "unit")).alias("unit"))
    return objects.join(found, F.col(target) == F.col("_target"), "left").select(*[objects[c] for c in objects.columns], "unit")


def without_nuls(line: Column) -> Column:
    return F.translate(line, "\x00", "")


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(#|//|/\*)")


def after_marker(lines: DataFrame, file: str, order: str, marker: Column) -> DataFrame:
    """Lines of each file after its first line that the marker fits; files without one have none."""
    first = lines.where(marker).groupBy(file).agg(F.min(order).alias("_first"))
    return lines.join(first, file).where(F.col(order) > F.col("_first")).drop("_first")


def numbered(frame: DataFrame, file: str, order: str) -> DataFrame:
    """``frame`` with the column row, from 0 without gaps, in each file's order (a whole number without ties).

    Rows are numbered inside blocks of places, and blocks by the sums of those before them, so no window holds a whole file.
    """
    held = frame.withColumn("_block", F.floor(F.col(order) / BLOCK))
    counts = held.groupBy(file, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inside = F.row_number().over(Window.partitionBy(file, "_block").orderBy(order)) - 1
    return held.withColumn("row", inside).join(counts.select(file, "_block", before.alias("_before")), [file, "_block"]).withColumn("row", F.col("row") + F.col("_before")).drop("_block", "_before")
