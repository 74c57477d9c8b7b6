"""Label text to statements, blocks and the long metadata table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerylake.functions import values
from orrerylake.functions.binding import let

#: Deepest block that is expected; a bound, so that paths need windows only. Deeper ones are an error, never cut off.
MOST_DEPTH = 8
OPENERS = ["OBJECT", "GROUP", "BEGIN_OBJECT", "BEGIN_GROUP"]
CLOSER, LAST = "END_OBJECT", "END"
_BLANK = " \t\r\n\x0b\x0c"


def _ends(line: Column) -> Column:
    return F.startswith(line, F.lit(CLOSER)) | (line == LAST)


def statements(label: Column) -> Column:
    """array<struct<key, value>> of a label's text, in one row, without a shuffle.

    Comments end with their line. A statement begins at a line with ``=`` whose first eight characters are
    their own upper case, at one that starts with END_OBJECT, or at END; other lines continue the value, the first
    of them without a blank. Heads without exactly one ``=`` are dropped.
    """
    plain = F.regexp_replace(label, r"/\*[^\n]*?(\r|\n|/\*)", "\n")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x, F.lit(_BLANK))), lambda x: x != "")

    def begins(line: Column) -> Column:
        head = F.substring(line, 1, 8)
        return F.when(line.contains("="), head == F.upper(head)).otherwise(_ends(line))

    def assembled(lines: Column, starts: Column) -> Column:
        def statement(at: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(starts, i + 1), F.size(lines))
            rest = F.slice(lines, at + 2, stop - at - 1)

            def parsed(head: Column) -> Column:
                parts = F.split(head, "=")
                end = _ends(head)
                key = F.when(head == LAST, LAST).when(end, CLOSER).when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(0)), F.lit(_BLANK)))
                value = F.when(end, "").otherwise(F.concat(F.trim(F.get(parts, F.lit(1)), F.lit(_BLANK)), F.concat_ws(" ", rest)))
                return F.struct(key.alias("key"), value.alias("value"))

            return let(F.get(lines, at), parsed)

        return F.filter(F.transform(starts, statement), lambda s: s["key"].isNotNull())

    def starts_of(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.when(begins(x) | (i == 0), i))
        return F.array_compact(marked)

    return let(lines, lambda ls: let(starts_of(ls), lambda starts: assembled(ls, starts)))


def statement_rows(labels: DataFrame, product: str, label: str) -> DataFrame:
    """(product, seq, key, value): one row for each statement, seq from 0 in label order."""
    return labels.select(product, F.posexplode(statements(F.col(label))).alias("seq", "s")).select(product, "seq", "s.key", "s.value")


def nested(rows: DataFrame, product: str, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Statement rows with depth, path (names of the blocks around), blocks (where those open) and attached; the
    lines that open and close blocks stay.

    Any key that starts with END closes a block, or nothing at the top. A statement in a block that is never
    closed is not attached. One shuffle, by product. A block deeper than ``most_depth`` raises an error that asks for a larger
    one. Null keys are plain statements; an empty table stays empty.
    """
    in_order = Window.partitionBy(product).orderBy("seq")
    opens = F.col("key").isin(OPENERS)
    closes = ~opens & F.col("key").startswith("END")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    sums = rows.withColumns({"_opens": opens, "_closes": closes, "_sum": F.sum(step).over(in_order)})
    deep = sums.withColumn("_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(in_order)))
    # A block line stands in the block around it.
    deep = deep.withColumn("depth", (F.col("_after") - F.col("_opens").cast("int")).cast("int"))
    names = {f"_n{k}": F.last(F.when(F.col("_opens") & (F.col("_after") == k), F.col("value")), ignorenulls=True).over(in_order) for k in range(1, most_depth + 1)}
    names |= {f"_b{k}": F.last(F.when(F.col("_opens") & (F.col("_after") == k), F.col("seq")), ignorenulls=True).over(in_order) for k in range(1, most_depth + 1)}
    later = F.min("_after").over(in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = deep.withColumns(names).withColumn("attached", F.least(later, F.col("depth")) == 0)

    def upto(letter: str) -> Column:
        whole = F.slice(F.array(*[F.col(n) for n in names if n[1] == letter]), F.lit(1), F.col("depth"))
        return F.when(F.col("depth") <= most_depth, whole).otherwise(F.raise_error(F.lit(f"a block lies deeper than most_depth={most_depth}")))

    return out.select(product, "seq", "depth", upto("n").alias("path"), upto("b").alias("blocks"), "key", "value", "attached", F.col("_opens").alias("opens"), F.col("_closes").alias("closes"))


def metadata(labels: DataFrame, product: str, label: str) -> DataFrame:
    """The long metadata table: one typed row for each parameter at every level."""
    rows = nested(statement_rows(labels, product, label), product).where("not opens and not closes")
    v = values.typed(F.col("value"))
    return rows.select(product, "seq", "depth", "path", "blocks", "key", F.col("value").alias("value_raw"), "attached", v.alias("v")).select(
        product, "seq", "depth", "path", "blocks", "key", "value_raw", "attached", "v.*"
    )
