"""All registered queries of the archive jobs, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, calibration_queries, format_queries, image_queries, label_queries, record_queries, sink_queries  # noqa: F401
from .register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed metadata table of all labels."""
    return QUERIES["m3_metadata"](spark, sf_dir)
