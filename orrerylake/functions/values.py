"""Values of label statements: typing, quantities, integers of other bases, collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = "^[+-]?(0+|[1-9][0-9]*)$"
REAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"
BASED = "^[0-9]{1,2}#[0-9A-Za-z]+#$"
#: Words that stand for a number.
NO_NUMBER = ["NULL", "UNK", "N/A"]


def based_integer(text: Column) -> Column:
    """``base#digits#`` as bigint."""
    parts = F.split(text, "#")
    base = parts[0].cast("int")
    return F.when(text.rlike(BASED) & base.between(2, 36), F.call_function("conv", parts[1], base, F.lit(10)).cast("bigint"))


def unquoted(text: Column) -> Column:
    return F.when(text.rlike("(?s)^\"[^\"]*\"$|^'[^']*'$"), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)


#: A quoted text, a bracket, a comma, or a run of anything else, with its unit if it has one.
TOKEN = r"""\"[^\"]*\"|'[^']*'|[(){},]|[^(){},\"'<]*<[^>]*>|[^(){},\"'<]+|["'<]"""
_COLLECTION = r"(?s)^[({].*[)}]$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def raw_items(text: Column) -> Column:
    """Parts of a collection as they are written, blanks at the ends taken off; commas in quotes, units and inner collections split nothing.

    A text that is no collection is one part; an empty collection has none.
    """

    def step(state: Column, token: Column) -> Column:
        opens, closes = token.isin("(", "{"), token.isin(")", "}")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ends = (token == ",") & (state["depth"] == 1) | closes & (depth == 0)
        outer = opens & (state["depth"] == 0)
        return F.struct(
            depth.alias("depth"), F.when(ends | outer, "").otherwise(F.concat(state["part"], token)).alias("part"), F.when(ends, F.concat(state["out"], F.array(F.trim(state["part"])))).otherwise(state["out"]).alias("out")
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(tokens(text), start, step, lambda s: s["out"])
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    # Without quotes, units and inner brackets a comma is a comma.
    plain = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    held = F.when(~text.rlike(_COLLECTION), F.array(text)).when(inner.rlike("[(){}\"'<]"), whole).otherwise(plain)
    return F.when((F.size(held) == 1) & (F.get(held, F.lit(0)) == ""), F.array().cast("array<string>")).otherwise(held)


def items(text: Column) -> Column:
    """Parts of a collection ``(a, b)`` or ``{a, b}`` as texts: quotes taken off, integers of other bases in base 10, inner collections as they are written."""
    return F.transform(raw_items(text), lambda x: F.coalesce(based_integer(x).cast("string"), unquoted(x)))


def nested_value(text: Column) -> Column:
    """A value as VARIANT: collections as arrays to any depth, integers of any base, reals, ``{value, units}`` of quantities, texts.

    Null where brackets do not match; a null text is null.
    """

    def as_json(token: Column) -> Column:
        t = F.trim(token)
        q = quantity(t)
        number = F.when(t.rlike(INTEGER) | t.rlike(REAL) & ~t.rlike("^[+-]?0+[1-9][0-9]*$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[+]", ""), r"^(-?)[.]", "$10."), r"[.]($|[eE])", ".0$1"))
        string = F.to_json(F.array(unquoted(t)))
        string = F.substr(string, F.lit(2), F.length(string) - 2)
        units = F.to_json(F.array(q["units"]))
        measured = F.concat(F.lit('{"value":'), F.coalesce(F.when(q["value"].try_cast("double").isNotNull(), q["value"].try_cast("double").cast("string")), F.lit("null")), F.lit(',"units":'), F.substr(units, F.lit(2), F.length(units) - 2), F.lit("}"))
        return F.when(t.isin("(", "{"), "[").when(t.isin(")", "}"), "]").when(t.isin(",", ""), t).when(based_integer(t).isNotNull(), based_integer(t).cast("string")).when(q.isNotNull(), measured).otherwise(F.coalesce(number, string))

    t = F.trim(text)
    return F.when(t.rlike(_COLLECTION), F.try_parse_json(F.array_join(F.transform(tokens(t), as_json), ""))).otherwise(F.try_parse_json(as_json(t)))


def quantity(text: Column) -> Column:
    """struct<value, units> of ``n <UNIT>``, both as text; null where the text is none.

    What stands before the first ``<`` must be a number or a word for none; the unit goes to the last ``>``.
    """
    head = F.trim(F.substring_index(text, "<", 1))
    number = head.rlike(REAL) | head.rlike(INTEGER) | head.isin(NO_NUMBER)
    unit = F.substring_index(F.substr(text, F.instr(text, "<") + 1), ">", -2)
    unit = F.substring_index(unit, ">", 1)
    return F.when(F.contains(text, F.lit("<")) & F.endswith(F.rtrim(text), F.lit(">")) & number, F.struct(head.alias("value"), unit.alias("units")))


def typed(text: Column) -> Column:
    """A label value by its first fitting reading: integer of a base, integer, real, quoted text, collection,
    quantity, or plain text. Numbers with leading zeros stay text, as dates do.

    struct<type, value_long, value_double, value_string, units, items>
    """
    t = F.trim(text)
    is_based, is_integer, is_real = t.rlike(BASED), t.rlike(INTEGER), t.rlike(REAL) & ~t.rlike("^[+-]?0+[1-9][0-9]*$")
    is_quoted = t.rlike("(?s)^\"[^\"]*\"$|^'[^']*'$")
    is_collection = t.rlike(_COLLECTION)
    is_quantity = ~is_quoted & ~is_collection & quantity(t).isNotNull()
    kind = F.when(is_based, "based").when(is_integer, "integer").when(is_real, "real").when(is_quoted, "quoted").when(is_collection, "collection").when(is_quantity, "quantity").otherwise("text")
    q = quantity(t)
    number = F.when(is_quantity, q["value"]).otherwise(t)
    return F.struct(
        kind.alias("type"),
        F.when(is_based, based_integer(t)).when(is_integer | is_quantity & number.rlike(INTEGER), number.try_cast("bigint")).alias("value_long"),
        F.when(is_integer | is_real | is_quantity, number.try_cast("double")).alias("value_double"),
        F.when(is_quoted, unquoted(t)).when(kind == "text", t).alias("value_string"),
        F.when(is_quantity, q["units"]).alias("units"),
        F.when(is_collection, items(t)).alias("items"),
    )


def parts_of_quantities(text: Column) -> Column:
    """Each part of a collection, or the one value, as struct<value, units>: ``("A.DAT", 1000 <BYTES>)``."""

    def part(x: Column) -> Column:
        return F.when(quantity(x).isNotNull(), quantity(x)).otherwise(F.struct(F.coalesce(based_integer(x).cast("string"), unquoted(x)).alias("value"), F.lit(None).cast("string").alias("units")))

    return F.transform(raw_items(F.trim(text)), part)
