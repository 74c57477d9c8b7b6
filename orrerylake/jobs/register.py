"""The register that query modules add themselves to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes where much is made of each row.
TASK_ROWS = 5_000
#: Rows that one task sorts, where there are more than the cores share. With so many, 240 million rows go to the 200 tasks up to which Spark writes a shuffle without holding its rows.
SORT_ROWS = 1_200_000


def tasks_for(rows: int, task_rows: int = TASK_ROWS, least: int = 1) -> int:
    return max(least, -(-rows // task_rows))


def spread(frame: DataFrame, key: Column | str | list[str], task_rows: int = TASK_ROWS, least: int = 1) -> DataFrame:
    """``frame`` dealt by ``key`` to tasks of about ``task_rows`` rows, and to ``least`` tasks or more.

    A table of narrow rows is a small file, or one group of rows in it, which Spark reads in one task; that task would do all the work on what is made of
    them. With as many tasks as the rows need, none does more when the table grows, and what is put together by ``key`` afterwards needs no other shuffle.
    """
    return frame.repartition(tasks_for(frame.count(), task_rows, least), *(key if isinstance(key, list) else [key]))
