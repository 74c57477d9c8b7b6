"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and
#: carriage return. ``bytes.split()`` splits UTF-8 text at exactly these six.
WORD_BREAKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and driver and tasks are one process, as in tests, a local temporary folder stands in; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            held = spark.sparkContext.getCheckpointDir()
        folder = held
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back. ``compression``: zstd for whole texts, to spare disk.

    Cuts the lineage at a table which outlives any executor, and gives Catalyst real sizes.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("parquet.compression.codec.zstd.level", "6").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, key: str, at_most: int) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of ``key`` alone, so that every run picks the same."""
    rows = df.count()
    if rows <= at_most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * at_most / rows))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
