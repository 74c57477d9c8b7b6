"""Exact quantiles of any number of values and groups in bounded memory: counts over ordered prefixes of the values' bits.

A double becomes a whole number of 64 bits that sorts as it does. Counts by the first 16 bits tell in which of at most 65,536
buckets a rank lies, counts by the next 16 bits in which part of that bucket, and so on: four passes, all groups and all ranks
at once, and no task ever holds the values of a group.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerylake.functions.binding import let
from orrerylake.jobs.scratch import kept

_STEP = 16
_INFINITE = 0x7FF0 << 48


def ordered_key(value: Column) -> Column:
    """A bigint that sorts as the double does: its bits, for negative values below zero. Both zeros are equal, NaN is the largest."""

    def exponent_of(size: Column) -> Column:
        guess = F.floor(F.log2(size)).cast("int")
        return let(guess, lambda e: e + F.when(size >= _power(e + 1), 1).when(size < _power(e), -1).otherwise(0))

    def bits(size: Column) -> Column:
        # Numbers below the smallest normal one are whole multiples of 2^-1074.
        small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
        normal = let(exponent_of(size), lambda e: (e + 1023).cast("bigint") * F.lit(1 << 52) + ((size / _power(e) - 1) * F.lit(2.0**52)).cast("bigint"))
        return F.when(size == float("inf"), F.lit(_INFINITE)).when(size < F.lit(2.0**-1022), small).otherwise(normal)

    v = value.cast("double")
    return let(v, lambda x: F.when(F.isnan(x), F.lit(_INFINITE + 1)).otherwise(let(F.abs(x), bits) * F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))))


def _power(e: Column) -> Column:
    """2^e, exact for every exponent of a normal double."""
    half = F.floor(e / 2)
    return F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (e - half).cast("double"))


def quantiles(frame: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, the names of ``shares``): the quantile of each share of a group's values, with linear interpolation between the two nearest.

    Null values do not count, NaN counts as the largest value; a group without values has no row; null groups are groups; an empty table stays
    empty. Repeated rows count as often as they stand. The frame is read five times, once to count; what is written between the passes is one row for each
    group and rank.
    """
    for share in shares.values():
        if math.isnan(share) or not 0 <= share <= 1:
            raise ValueError(f"{share} is no share")
    group = [f"_g{i}" for i in range(len(by))]
    held = frame.select(*[F.col(b).alias(g) for b, g in zip(by, group, strict=True)], F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_key", ordered_key(F.col("_v")))

    def same(a: DataFrame, b: DataFrame, *others: Column) -> Column:
        return reduce(and_, [*[a[g].eqNullSafe(b[g]) for g in group], *others], F.lit(True))

    n = held.groupBy(*group).agg(F.count("*").alias("_n"))
    ranks = F.array(*[F.floor(F.lit(s) * (F.col("_n") - 1)).cast("bigint") + F.lit(k) for s in shares.values() for k in (0, 1)])
    asked = n.select(*group, "_n", F.explode(F.array_distinct(F.filter(F.transform(ranks, lambda r: F.least(r, F.col("_n") - 1)), lambda r: r >= 0))).alias("_rank"))
    targets = kept(asked.select(*group, "_rank", F.col("_rank").alias("_left"), F.lit(None).cast("bigint").alias("_prefix")), "ranks")
    for shift in range(64 - _STEP, -1, -_STEP):
        rows = held
        if shift + _STEP < 64:
            open_ = targets.select(*group, "_prefix").distinct()
            rows = held.join(open_, same(held, open_, F.shiftright(held["_key"], shift + _STEP) == open_["_prefix"]), "left_semi")
        parent = F.shiftright("_key", shift + _STEP) if shift + _STEP < 64 else F.lit(None).cast("bigint")
        counts = rows.groupBy(*group, parent.alias("_parent"), F.shiftright("_key", shift).alias("_digit")).agg(F.count("*").alias("_c"), F.min("_v").alias("_value"))
        upto = F.sum("_c").over(Window.partitionBy(*group, "_parent").orderBy("_digit"))
        counts = counts.withColumn("_upto", upto)
        targets = targets.select(*group, "_rank", "_left", "_prefix")
        hit = same(targets, counts, targets["_prefix"].eqNullSafe(counts["_parent"]), counts["_upto"] > targets["_left"], counts["_upto"] - counts["_c"] <= targets["_left"])
        found = targets.join(counts, hit).select(*[targets[g] for g in group], "_rank", (targets["_left"] - counts["_upto"] + counts["_c"]).alias("_left"), counts["_digit"].alias("_prefix"), counts["_value"])
        targets = kept(found, "ranks")

    values = targets.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    joined = n.join(values, same(n, values)).select(*[n[g].alias(b) for g, b in zip(group, by, strict=True)], "_n", "_at")

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("_n") - 1)
        low = F.floor(place).cast("bigint")
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", F.least(low + 1, F.col("_n") - 1))
        rest = place - low
        return F.when((rest == 0) | (a == b), a).otherwise(a + (b - a) * rest)

    return joined.select(*by, *[at(s).alias(name) for name, s in shares.items()])
