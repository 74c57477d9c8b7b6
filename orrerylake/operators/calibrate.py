"""Special constants, masks and scaling of values."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which labels state constants.
CONSTANT_NAMES = """
    CORE_HIGH_INST_NULL CORE_HIGH_INST_SATURATION CORE_HIGH_INST_SAT CORE_HIGH_REPR_NULL CORE_HIGH_REPR_SATURATION CORE_HIGH_REPR_SAT CORE_HIGH_NULL CORE_HIGH_SATURATION CORE_HIGH_SAT
    CORE_LOW_INST_NULL CORE_LOW_INST_SATURATION CORE_LOW_INST_SAT CORE_LOW_REPR_NULL CORE_LOW_REPR_SATURATION CORE_LOW_REPR_SAT CORE_LOW_NULL CORE_LOW_SATURATION CORE_LOW_SAT
    CORE_INST_NULL CORE_INST_SATURATION CORE_INST_SAT CORE_REPR_NULL CORE_REPR_SATURATION CORE_REPR_SAT CORE_NULL CORE_SATURATION CORE_SAT
    BAND_SUFFIX_HIGH_INST_NULL BAND_SUFFIX_HIGH_INST_SATURATION BAND_SUFFIX_HIGH_INST_SAT BAND_SUFFIX_HIGH_REPR_NULL BAND_SUFFIX_HIGH_REPR_SATURATION BAND_SUFFIX_HIGH_REPR_SAT BAND_SUFFIX_HIGH_NULL BAND_SUFFIX_HIGH_SATURATION BAND_SUFFIX_HIGH_SAT
    BAND_SUFFIX_LOW_INST_NULL BAND_SUFFIX_LOW_INST_SATURATION BAND_SUFFIX_LOW_INST_SAT BAND_SUFFIX_LOW_REPR_NULL BAND_SUFFIX_LOW_REPR_SATURATION BAND_SUFFIX_LOW_REPR_SAT BAND_SUFFIX_LOW_NULL BAND_SUFFIX_LOW_SATURATION BAND_SUFFIX_LOW_SAT
    BAND_SUFFIX_INST_NULL BAND_SUFFIX_INST_SATURATION BAND_SUFFIX_INST_SAT BAND_SUFFIX_REPR_NULL BAND_SUFFIX_REPR_SATURATION BAND_SUFFIX_REPR_SAT BAND_SUFFIX_NULL BAND_SUFFIX_SATURATION BAND_SUFFIX_SAT
    SAMPLE_SUFFIX_HIGH_INST_NULL SAMPLE_SUFFIX_HIGH_INST_SATURATION SAMPLE_SUFFIX_HIGH_INST_SAT SAMPLE_SUFFIX_HIGH_REPR_NULL SAMPLE_SUFFIX_HIGH_REPR_SATURATION SAMPLE_SUFFIX_HIGH_REPR_SAT SAMPLE_SUFFIX_HIGH_NULL SAMPLE_SUFFIX_HIGH_SATURATION SAMPLE_SUFFIX_HIGH_SAT
    SAMPLE_SUFFIX_LOW_INST_NULL SAMPLE_SUFFIX_LOW_INST_SATURATION SAMPLE_SUFFIX_LOW_INST_SAT SAMPLE_SUFFIX_LOW_REPR_NULL SAMPLE_SUFFIX_LOW_REPR_SATURATION SAMPLE_SUFFIX_LOW_REPR_SAT SAMPLE_SUFFIX_LOW_NULL SAMPLE_SUFFIX_LOW_SATURATION SAMPLE_SUFFIX_LOW_SAT
    SAMPLE_SUFFIX_INST_NULL SAMPLE_SUFFIX_INST_SATURATION SAMPLE_SUFFIX_INST_SAT SAMPLE_SUFFIX_REPR_NULL SAMPLE_SUFFIX_REPR_SATURATION SAMPLE_SUFFIX_REPR_SAT SAMPLE_SUFFIX_NULL SAMPLE_SUFFIX_SATURATION SAMPLE_SUFFIX_SAT
    LINE_SUFFIX_HIGH_INST_NULL LINE_SUFFIX_HIGH_INST_SATURATION LINE_SUFFIX_HIGH_INST_SAT LINE_SUFFIX_HIGH_REPR_NULL LINE_SUFFIX_HIGH_REPR_SATURATION LINE_SUFFIX_HIGH_REPR_SAT LINE_SUFFIX_HIGH_NULL LINE_SUFFIX_HIGH_SATURATION LINE_SUFFIX_HIGH_SAT
    LINE_SUFFIX_LOW_INST_NULL LINE_SUFFIX_LOW_INST_SATURATION LINE_SUFFIX_LOW_INST_SAT LINE_SUFFIX_LOW_REPR_NULL LINE_SUFFIX_LOW_REPR_SATURATION LINE_SUFFIX_LOW_REPR_SAT LINE_SUFFIX_LOW_NULL LINE_SUFFIX_LOW_SATURATION LINE_SUFFIX_LOW_SAT
    LINE_SUFFIX_INST_NULL LINE_SUFFIX_INST_SATURATION LINE_SUFFIX_INST_SAT LINE_SUFFIX_REPR_NULL LINE_SUFFIX_REPR_SATURATION LINE_SUFFIX_REPR_SAT LINE_SUFFIX_NULL LINE_SUFFIX_SATURATION LINE_SUFFIX_SAT
    HIGH_INST_NULL HIGH_INST_SATURATION HIGH_INST_SAT HIGH_REPR_NULL HIGH_REPR_SATURATION HIGH_REPR_SAT HIGH_NULL HIGH_SATURATION HIGH_SAT
    LOW_INST_NULL LOW_INST_SATURATION LOW_INST_SAT LOW_REPR_NULL LOW_REPR_SATURATION LOW_REPR_SAT LOW_NULL LOW_SATURATION LOW_SAT
    INST_NULL INST_SATURATION INST_SAT REPR_NULL REPR_SATURATION REPR_SAT NULL SATURATION SAT
    INVALID_CONSTANT MISSING_CONSTANT INFINITY_CONSTANT NOT_APPLICABLE_CONSTANT NULL_CONSTANT UNKNOWN_CONSTANT
""".split()
#: Constants that data of a type hold without their label saying so. None for unsigned bytes.
IMPLICIT = {
    "int16": {"N/A": -32768, "UNK": 32767, "ISIS_LOW_INST_SAT": -32766, "ISIS_LOW_REPR_SAT": -32767, "ISIS_HIGH_INST_SAT": -32765, "ISIS_HIGH_REPR_SAT": -32764},
    "uint16": {"NULL": 0, "N/A": 65533, "UNK": 65534, "ISIS_LOW_INST_SAT": 2, "ISIS_LOW_REPR_SAT": 1, "ISIS_HIGH_INST_SAT": 65534, "ISIS_HIGH_REPR_SAT": 65535},
    "int32": {"N/A": -214743648, "UNK": 2147483647},
    "int64": {"N/A": -214743648, "UNK": 2147483647},
    "uint32": {"N/A": 4294967293, "UNK": 4294967294, "ISIS_NULL": 4286578683, "ISIS_LOW_INST_SAT": 4286578685, "ISIS_LOW_REPR_SAT": 4286578684, "ISIS_HIGH_INST_SAT": 4286578686, "ISIS_HIGH_REPR_SAT": 4286578687},
    "float32": {
        "NULL": -3.4028226550889044521e38, "N/A": -1e32, "UNK": 1e32, "ISIS_LOW_INST_SAT": -3.4028230607370965e38, "ISIS_LOW_REPR_SAT": -3.4028228579130005e38,
        "ISIS_HIGH_INST_SAT": -3.4028232635611926e38, "ISIS_HIGH_REPR_SAT": -3.4028234663852886e38,
    },
    "float64": {"NULL": -3.4028226550889044521e38},
}
INVALIDS = "INVALIDS"


def of_kind(constant: float, kind: str) -> float:
    """A constant as data of the type hold it: a 4-byte float is rounded to its nearest."""
    return struct.unpack("<f", struct.pack("<f", constant))[0] if kind == "float32" else float(constant)


def explicit_constants(meta: DataFrame, object_: str) -> DataFrame:
    """(object, name, constant): constants that labels name; N/A says nothing, a collection means its first item."""
    raw = F.coalesce(F.get("items", F.lit(0)), "value_string", "value_raw")
    return meta.where(F.col("key").isin(CONSTANT_NAMES) & (F.trim("value_raw", F.lit('"')) != "N/A")).select(object_, F.col("key").alias("name"), raw.try_cast("double").alias("constant")).dropna()


def finite(value: Column) -> Column:
    return ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))


def implicit_constants(pixels: DataFrame, object_: str, value: str, kind: str, known: dict[str, float] | None = None) -> DataFrame:
    """(object, name, constant): those of the type's constants that the object's data hold, and INVALIDS.

    ``known`` replaces the type's constants altogether. Constants are compared as values of the type, so those of 4-byte floats
    are found in 4-byte and in 8-byte columns. Null values are none of them. One pass with partial aggregation.
    """
    v = F.col(value).cast("double") if kind.startswith("float") else F.col(value)
    names = [(n, of_kind(c, kind)) for n, c in (known if known is not None else IMPLICIT.get(kind, {})).items()]
    marks = [F.struct(F.lit(n).alias("name"), F.lit(c).alias("constant"), F.max(F.coalesce(v == c, F.lit(False))).alias("there")) for n, c in names]
    marks.append(F.struct(F.lit(INVALIDS).alias("name"), F.lit(None).cast("double").alias("constant"), F.max(F.coalesce(~finite(v.cast("double")), F.lit(False))).alias("there")))
    return pixels.groupBy(object_).agg(F.array(*marks).alias("_m")).select(object_, F.explode("_m").alias("_c")).where("_c.there").select(object_, "_c.name", "_c.constant")


def constants_by_object(*found: DataFrame, object_: str) -> DataFrame:
    """(object, specials: array<double>, invalids: boolean)."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy(object_).agg(F.array_distinct(F.collect_list("constant")).alias("specials"), F.max(F.col("name") == INVALIDS).alias("invalids"))


def masked(value: Column, specials: Column, invalids: Column) -> Column:
    """Null where the value is special, or no finite number where the data have such."""
    v = value.cast("double")
    special = F.coalesce(F.array_contains(specials, v), F.lit(False)) & ~F.isnan(v)
    return F.when(~special & ~(F.coalesce(invalids, F.lit(False)) & ~finite(v)), value)


def scale_factor(text: Column, neutral: float) -> Column:
    """A label's factor or offset; missing, NULL and N/A are neutral."""
    t = F.upper(F.trim(text))
    return F.when(text.isNull() | t.isin("", "NULL", "N/A"), neutral).otherwise(text.try_cast("double"))


def scaled(value: Column, factor: Column, offset: Column) -> Column:
    """value * factor + offset; nulls are neutral, as are factors of 0."""
    return value * F.coalesce(F.nullif(factor, F.lit(0.0)), F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))


def scaled_around(value: Column, special: Column, factor: Column, offset: Column) -> Column:
    """Special values are not scaled."""
    return F.when(special, value.cast("double")).otherwise(scaled(value.cast("double"), factor, offset))


def is_constant(value: Column, constants: dict[str, float]) -> Column:
    """Equal to any constant but those that bound the valid range."""
    named = [v for n, v in constants.items() if not n.startswith("valid_")]
    return F.coalesce(value.isin(named), F.lit(False)) if named else F.lit(False)


def smallest_type(low: Column, high: Column) -> Column:
    """Name of the smallest integer type that holds low to high; exact where none does."""
    out = F.lit("exact")
    for bits in (64, 32, 16, 8):
        out = F.when((low >= F.lit(str(-(2 ** (bits - 1)))).cast("decimal(38,0)")) & (high <= F.lit(str(2 ** (bits - 1) - 1)).cast("decimal(38,0)")), f"int{bits}").otherwise(
            F.when((low >= 0) & (high <= F.lit(str(2**bits - 1)).cast("decimal(38,0)")), f"uint{bits}").otherwise(out)
        )
    return out


def scaled_table(pixels: DataFrame, constants: DataFrame, object_: str, value: str, factor: Column, offset: Column) -> DataFrame:
    """Find, mask and scale: ``pixels`` with the column scaled, null where masked.

    ``constants``: one row per object, as from ``constants_by_object``; joined by object.
    """
    held = pixels.join(constants, object_, "left")
    return held.withColumn("scaled", scaled(masked(F.col(value), F.col("specials"), F.col("invalids")).cast("double"), factor, offset)).drop("specials", "invalids")


def bit_masked(value: Column, mask: Column, specials: list[int]) -> Column:
    """An integer AND-ed with the label's bit mask; special values stay as they are, a null mask changes nothing, null stays null."""
    own = F.when(value.isin(specials), value) if specials else F.when(F.lit(False), value)
    return own.when(mask.isNull(), value).otherwise(value.bitwiseAND(mask.cast("bigint")))
