"""Statistics and integrity over a corpus."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles


def described(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column; the quartiles are exact (see ``quantiles``), and null where a group has no value."""
    plain = frame.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles.quantiles(frame, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnsRenamed({b: f"_{b}" for b in by})
    joined = plain.join(q, reduce(and_, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True)), "left")
    return joined.select(*by, "count", "mean", "std", "min", "q1", "median", "q3", "max")


LARGE = {"delimited": 20_000_000, "fixed": 40_000_000}


def size_check(records: Column, fields: Column, kind: str, cell_bytes: int = 8, task_bytes: int = 128 << 20) -> Column:
    """struct<cells, large, tasks>: whether a table is large, and into how many tasks to read it."""
    cells = records.cast("bigint") * fields
    return F.struct(cells.alias("cells"), (cells > LARGE[kind]).alias("large"), F.greatest(F.ceil(cells * cell_bytes / task_bytes), F.lit(1)).alias("tasks"))


def missing(objects: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    return objects.join(loaded, keys, "left_anti")


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, cells, different) of two readings, cell by cell, nulls equal to nulls; a row that one lacks differs in
    every cell.
    """
    one = a.select(*keys, F.struct(*columns).alias("_a"))
    other = b.select(*keys, F.struct(*columns).alias("_b"))
    both = one.join(other, keys, "full_outer")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    sums = both.agg(F.count("*").alias("cells"), *[F.sum((~(whole & F.col("_a")[c].eqNullSafe(F.col("_b")[c]))).cast("long")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("cells"), F.coalesce(c, F.lit(0)).alias("different")) for c in columns])).alias("s")).select("s.*")


def object_hash(frame: DataFrame, object_: list[str], columns: list[str]) -> DataFrame:
    """One number for each object's content, whatever the order of its rows."""
    return frame.groupBy(*object_).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash"))


def prefix_tables(tables: DataFrame, images: DataFrame) -> DataFrame:
    """(table, image): tables that start where an image does, in the same file."""
    return tables.join(images, ["file", "start_byte"]).select("table", "image")


def unit_headers(headers: DataFrame, units: DataFrame) -> DataFrame:
    """(header, unit): headers that end where a unit's data start, in the same file."""
    ends = headers.withColumn("data_start", F.col("offset") + F.col("length"))
    return ends.join(units, ["file", "data_start"]).select("header", "unit")
