"""The row-local readers over files as they arrive: the same expressions, no state and no watermark needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrerylake.sources import records


def fixed_width_stream(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """Typed columns (name, start, width, type) of lines in files that land in ``path``; what does not fit is null."""
    lines = spark.readStream.text(path)
    return lines.select(*[records.fixed_width(F.col("value"), a, n).try_cast(t).alias(c) for c, a, n, t in fields])


def to_store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there exactly once, then stop; called again, it goes on from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
