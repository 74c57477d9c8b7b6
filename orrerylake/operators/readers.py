"""Readers of tables that the plain ones do not fit: one for each value of READER that rules give, and an error for any other.

Each takes lines with their place (object_, row, line) and gives records or fields; none depends on how a file was split, as
positions in a file come from sums over its lines, which Spark takes over ranges first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerylake.functions import text
from orrerylake.sources import records

#: Lines whose running sums one window takes at once: sums of blocks of so many lines are put in order first.
BLOCK_LINES = 10_000


def running_bytes(lines: DataFrame, object_: list[str], size: Column, row: str = "row") -> DataFrame:
    """``lines`` with the column before: the sum of ``size`` over all earlier lines of the object.

    Sums are taken inside blocks of ``BLOCK_LINES`` lines, and over the blocks of an object, so that no window holds a whole file.
    """
    block = F.floor(F.col(row) / BLOCK_LINES).alias("_block")
    sized = lines.withColumn("_size", size.cast("long")).withColumn("_block", block)
    blocks = sized.groupBy(*object_, "_block").agg(F.sum("_size").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(*object_).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ahead = blocks.select(*object_, "_block", earlier.alias("_ahead"))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy(*object_, "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return sized.withColumn("_inside", inside).join(ahead, [*object_, "_block"]).withColumn("before", F.col("_ahead") + F.col("_inside")).drop("_size", "_block", "_ahead", "_inside")


def renumbered(lines: DataFrame, object_: list[str], row: str = "row") -> DataFrame:
    """Rows numbered without gaps, in their order."""
    return running_bytes(lines, object_, F.lit(1), row).withColumn(row, F.col("before")).drop("before")


def records_by_bytes(lines: DataFrame, object_: list[str], record_bytes: Column, line: str = "line", row: str = "row") -> DataFrame:
    """(object_, row, line): records of ``record_bytes`` bytes each, whatever the line breaks: missing ones are added, and those in a wrong place moved.

    A record is the bytes between two multiples of its length, breaks not counted. A line is cut at those multiples, and the parts of a
    record are joined again, by one shuffle on the record. ``record_bytes`` may differ from object to object, not within one. The rest at the end is
    the last record. Empty lines and NULs add nothing; a null line is empty.
    """
    held = lines.withColumn(line, F.coalesce(F.translate(F.col(line).cast("string"), "\x00", "").cast("binary"), F.lit(b""))).withColumn("_record", record_bytes.cast("long"))
    placed = running_bytes(held, object_, F.octet_length(line), row).where(F.octet_length(line) > 0)
    first, last = F.floor(F.col("before") / F.col("_record")), F.floor((F.col("before") + F.octet_length(line) - 1) / F.col("_record"))
    parts = placed.withColumn("_at", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_at") * F.col("_record") - F.col("before"), F.lit(0).cast("long"))
    end = F.least((F.col("_at") + 1) * F.col("_record") - F.col("before"), F.octet_length(line).cast("long"))
    piece = F.hex(F.substr(F.col(line), (begin + 1).cast("int"), (end - begin).cast("int")))
    joined = parts.groupBy(*object_, "_at").agg(F.sort_array(F.collect_list(F.struct("before", piece.alias("p")))).alias("_parts"))
    return joined.select(*object_, F.col("_at").alias("row"), F.unhex(F.array_join(F.transform("_parts", lambda x: x["p"]), "")).alias("line"))


def section(lines: DataFrame, first: Column, n: Column, row: str = "row") -> DataFrame:
    """Rows of a section of a file: ``n`` lines from line ``first`` (from 0); a null ``n`` goes to the end. Rows count from the section's first line."""
    return lines.where((F.col(row) >= first) & (n.isNull() | (F.col(row) < first + n))).withColumn(row, (F.col(row) - first).cast("long"))


def without_nuls(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.withColumn(line, F.translate(F.col(line).cast("string"), "\x00", "").cast("binary"))


def after_marker(lines: DataFrame, object_: list[str], line: str = "line", row: str = "row") -> DataFrame:
    """Lines behind the object's first one that begins with ``//``, numbered anew; objects without such a line have none."""
    marked = lines.where(F.startswith(F.col(line).cast("string"), F.lit("//"))).groupBy(*object_).agg(F.min(row).alias("_first"))
    return lines.join(marked, object_).where(F.col(row) > F.col("_first")).withColumn(row, F.col(row) - F.col("_first") - 1).drop("_first")


def delimited_fields(line: Column, sep: Column) -> Column:
    """Fields of a delimited line; quoted parts may hold the delimiter; padding and quotes at the ends go."""
    t = line.cast("string")
    field = F.concat(F.lit("\\Q"), sep, F.lit("\\E((?:\"[^\"]*\"|[^\\Q"), sep, F.lit("\\E])*)"))
    parts = F.when(t.contains('"'), F.regexp_extract_all(F.concat(sep, t), field, F.lit(1))).otherwise(F.split(t, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1))
    return F.transform(parts, lambda x: text.stripped(x))


def fixed_fields(line: Column, fields: Column) -> Column:
    """Fields of a line by the bytes of a format (array<struct<start, width, ...>>), padding taken off."""
    return F.transform(fields, lambda f: text.stripped(F.decode(F.substr(line, f["start"], f["width"]), "ISO-8859-1")))


def last_before(lines: DataFrame, object_: list[str], value: Column, row: str = "row") -> DataFrame:
    """``lines`` with the column last: the last ``value`` that is not null up to this line, in the object's order.

    Carried over blocks of ``BLOCK_LINES`` lines: inside a block by a window, from block to block by each block's last value.
    """
    held = lines.withColumn("_value", value).withColumn("_block", F.floor(F.col(row) / BLOCK_LINES))
    of_block = held.groupBy(*object_, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(row))).alias("_own"))
    carried = F.last("_own", ignorenulls=True).over(Window.partitionBy(*object_).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ahead = of_block.select(*object_, "_block", carried.alias("_carried"))
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(*object_, "_block").orderBy(row))
    return held.withColumn("_inside", inside).join(ahead, [*object_, "_block"]).withColumn("last", F.coalesce("_inside", "_carried")).drop("_value", "_block", "_inside", "_carried")


#: Readers that look at one line at a time.
LINE_READERS = ["delimited", "white space", "fixed width", "without nuls", "null spellings"]
#: Readers that need other lines of the table, too.
TABLE_READERS = ["records by bytes", "added breaks", "moved breaks", "after marker", "sections", "spreadsheet", "filled headers", "quoted records"]


def chosen(reader: Column, delimiter: Column) -> Column:
    """A table's reader: its own, else delimited if it has a delimiter, else of fixed width. One that does not exist raises an error that names it."""
    own = F.coalesce(reader, F.when(delimiter.isNotNull(), "delimited").otherwise("fixed width"))
    return F.when(own.isin(LINE_READERS + TABLE_READERS), own).otherwise(F.raise_error(F.concat(F.lit("there is no reader named "), own)).cast("string"))


def _by_delimiter(lines: DataFrame) -> DataFrame:
    return lines.withColumn("cells", delimited_fields(F.col("line"), F.coalesce("delimiter", F.lit(","))))


def _by_width(lines: DataFrame) -> DataFrame:
    return lines.withColumn("cells", fixed_fields(F.col("line"), F.col("fields")))


def _without_notes(lines: DataFrame) -> DataFrame:
    """Neither empty lines nor comments; rows are numbered as they stood."""
    return lines.where((F.length(F.trim(F.col("line").cast("string"))) > 0) & ~records.is_comment(F.col("line").cast("string")))


def _end(fields: Column) -> Column:
    """The last byte of a format; null without one."""
    return F.aggregate(fields, F.lit(0), lambda n, f: F.greatest(n, f["start"] + f["width"] - 1))


def by_line(lines: DataFrame, object_: list[str]) -> DataFrame:
    """Each line by itself, without a shuffle; a row keeps the number of its line, so dropped ones leave gaps.

    A line of a delimited table that has another number of fields than the format, and is long enough for all its bytes, is read by width.
    """
    reader, sep = F.col("reader"), F.coalesce("delimiter", F.lit(","))
    plain = without_nuls(lines)
    cut = delimited_fields(F.col("line"), sep)
    cells = (
        F.when(reader.isin("fixed width", "without nuls"), fixed_fields(F.col("line"), F.col("fields")))
        .when(reader == "white space", records.split_fields(F.col("line").cast("string")))
        .when((reader == "delimited") & (F.size(cut) != F.size("fields")) & (F.octet_length("line") >= _end(F.col("fields"))), fixed_fields(F.col("line"), F.col("fields")))
        .when(reader == "null spellings", F.transform(cut, lambda x: text.null_spellings(x)))
        .otherwise(cut)
    )
    return _without_notes(plain).withColumn("cells", cells)


def by_bytes(lines: DataFrame, object_: list[str]) -> DataFrame:
    facts = lines.groupBy(*object_).agg(F.first("fields", ignorenulls=True).alias("fields"))
    return _by_width(records_by_bytes(lines, object_, F.col("record_bytes")).join(facts, object_))


def quoted_records(lines: DataFrame, object_: list[str], line: str = "line", row: str = "row") -> DataFrame:
    """(object_, row, line): records of lines, where a line end inside quotes ends none; the lines of a record are joined by LF.

    Whether a line begins inside quotes is the parity of all quotes before it, which sums over blocks of lines tell, whatever the splits. A quote that is never closed
    takes the rest of its object into one record. A null line is empty.
    """
    held = lines.withColumn(line, F.coalesce(F.col(line), F.lit(b"")))
    t = F.col(line).cast("string")
    counted = running_bytes(held, object_, F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit(""))), row)
    marked = last_before(counted, object_, F.when(F.col("before") % 2 == 0, F.col(row)), row)
    joined = marked.groupBy(*object_, F.col("last").alias(row)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), t.alias("t")))), lambda x: x["t"]), "\n").cast("binary").alias(line))
    return renumbered(joined, object_, row)


def by_quotes(lines: DataFrame, object_: list[str]) -> DataFrame:
    facts = lines.groupBy(*object_).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("fields", "delimiter")])
    return _by_delimiter(quoted_records(lines, object_).join(facts, object_))


def behind_marker(lines: DataFrame, object_: list[str]) -> DataFrame:
    return _by_delimiter(after_marker(lines, object_))


def sections(lines: DataFrame, object_: list[str]) -> DataFrame:
    return _by_delimiter(section(lines, F.coalesce("skip_lines", F.lit(0).cast("long")), F.lit(None).cast("long")))


def headers_filled(lines: DataFrame, object_: list[str]) -> DataFrame:
    """A line with fewer fields than it lacks is a header; each line behind it gets its fields in front of its own. Lines before a first header go."""
    split = _by_delimiter(_without_notes(lines))
    marked = split.withColumn("_head", F.when(F.size("cells") < F.size("fields") - F.size("cells"), F.col("cells")))
    filled = renumbered(last_before(marked, object_, F.col("_head")).where("_head IS NULL"), object_)
    return filled.where(F.col("last").isNotNull()).withColumn("cells", F.concat("last", "cells")).drop("_head", "last")


#: Which function reads what. Each takes the lines of tables of its own readers: object_, row, line (binary), reader, fields (a format, see
#: ``formats.FORMAT``), delimiter, record_bytes and skip_lines, and gives object_, row and cells (array<string>, in the order of the fields).
GROUPS: list[tuple[list[str], Callable[[DataFrame, list[str]], DataFrame]]] = [
    (LINE_READERS, by_line),
    (["records by bytes", "added breaks", "moved breaks"], by_bytes),
    (["after marker"], behind_marker),
    (["sections", "spreadsheet"], sections),
    (["filled headers"], headers_filled),
    (["quoted records"], by_quotes),
]
