"""Special cases as data: a table of rules patches label facts; and header rows filled onto detail rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import readers

RULES = "priority int, stage string, column string, test string, operand string, low double, high double, field string, value string"


def fits(condition: Row, column: Column) -> Column:
    """Whether a column equals, starts with, contains, lacks or matches a condition's operand, or lies in its interval; null fits nothing."""
    given, operand = column.cast("string"), F.lit(condition.operand)
    tests = {
        "equals": given == operand,
        "starts": F.startswith(given, operand),
        "contains": F.contains(given, operand),
        "lacks": ~F.contains(given, operand),
        "regex": F.regexp_like(given, operand),
        "interval": given.try_cast("double").between(condition.low, condition.high),
    }
    return F.coalesce(tests.get(condition.test, F.lit(False)), F.lit(False))


def overrides(rows: DataFrame, rules: DataFrame, stage: str, of: list[str], most_rules: int = 5_000) -> DataFrame:
    """``rows`` with the column override: map of field to value, the first fitting rule by priority for each field.

    Rows of rules that share priority, field and value are the conditions of one rule, all of which must fit. A null column fits
    no condition. Without rules of the stage the map is empty.

    Rules are a stated table of at most ``most_rules`` rows, which is checked before they travel with the tasks; more
    raise an error. No row is joined with another, so nothing is shuffled.
    """
    held = rules.where(F.col("stage") == stage).orderBy("priority").limit(most_rules + 1).collect()
    if len(held) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    out = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fields: dict[str, dict[tuple, list]] = {}
    for r in held:
        fields.setdefault(r.field, {}).setdefault((r.priority, r.value), []).append(r)
    for field, own in fields.items():
        value = F.lit(None).cast("string")
        for (_, given), conditions in reversed(own.items()):
            held_all = reduce(and_, [fits(r, F.col(r["column"])) if r["column"] in of else F.lit(False) for r in conditions])
            value = F.when(held_all, F.lit(given)).otherwise(value)
        out = F.when(value.isNotNull(), F.map_concat(out, F.create_map(F.lit(field), value))).otherwise(out)
    return rows.withColumn("override", out)


def patched(column: Column, field: str, cast: str) -> Column:
    """The override of a field if there is one, else the label's own value."""
    return F.coalesce(F.col("override")[field].try_cast(cast), column)


def filled_headers(rows: DataFrame, file: str, order: str, is_header: Column, header: list[str], block: int) -> DataFrame:
    """Detail rows with the columns of the header row before them; blocks of other than ``block`` details go.

    Files are independent; ``order`` is a whole number, such as the number of a record in its file, without ties. The last header is carried from block to block
    of records, so that no window holds a whole file; one more shuffle, by header, counts its details. Rows before a file's first header go.
    """
    head = F.when(is_header, F.struct(F.col(order).alias("at"), *[F.col(c).alias(f"h{i}") for i, c in enumerate(header)]))
    held = readers.last_before(rows, [file], head, order).where(F.col("last").isNotNull() & ~F.coalesce(is_header, F.lit(False)))
    whole = F.count("*").over(Window.partitionBy(file, "last.at"))
    kept = held.withColumn("_n", whole).where(F.col("_n") == block)
    return kept.select(*[F.col(c) for c in rows.columns], *[F.col(f"last.h{i}").alias(f"header_{c}") for i, c in enumerate(header)])


def xml_fields(label: Column, schema: str) -> Column:
    """A label's XML as a struct by schema; name spaces are taken off first."""
    bare = F.regexp_replace(F.regexp_replace(label, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")
    return F.from_xml(bare, schema)


def structures(files: DataFrame, key: str, areas: str) -> DataFrame:
    """(key, file_name, kind, id, position): the entries of a label's file areas; ids default to KIND_n.

    ``areas``: array<struct<file_name, entries: array<struct<kind, id>>>>.
    """
    area = files.select(key, F.posexplode(areas).alias("_area", "_a"))
    entries = area.select(key, "_area", F.col("_a.file_name").alias("file_name"), F.posexplode("_a.entries").alias("position", "_e"))
    same = Window.partitionBy(key, F.col("_e.kind")).orderBy("_area", "position")
    return entries.select(key, "file_name", F.col("_e.kind").alias("kind"), F.coalesce("_e.id", F.concat_ws("_", F.upper("_e.kind"), (F.row_number().over(same) - 1).cast("string"))).alias("id"), "position")
