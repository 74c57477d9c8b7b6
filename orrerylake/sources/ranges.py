"""Objects inside files, read by byte range: only their bytes, and a large object by many tasks.

Ranges are planned by Spark from the object table, which grows with the archive, and read by tasks, not by the driver. Files
are opened by ``pyarrow.fs`` (local, HDFS, S3, GCS, ...). ``scanned`` is for stores that only Spark's own readers
reach: it takes whole files, of 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a range, and of the ranges of a task, about.
RANGE_BYTES, TASK_BYTES = 32 << 20, 128 << 20
#: The same for ranges that are decoded to rows, which take many times their bytes.
DECODED_TASK_BYTES = 8 << 20


def planned(objects: DataFrame, start: Column, length: Column, record_bytes: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``objects`` with one row for each range of the object's bytes: range (from 0), at (byte in the file), size, first_row.

    Ranges hold whole records of ``record_bytes``, but for a rest at the object's end; first_row is the number of the range's first record.
    Objects without records have ranges of bytes, and a null first_row. An object of no length, or of a null one, has no range.
    """
    record = F.when(record_bytes > 0, record_bytes.cast("long")) if record_bytes is not None else F.lit(None).cast("long")
    step = F.coalesce(F.greatest(F.floor(F.lit(range_bytes) / record), F.lit(1).cast("long")) * record, F.lit(range_bytes).cast("long"))
    held = objects.withColumns({"_start": start.cast("long"), "_length": length.cast("long"), "_step": step, "_record": record}).where("_length > 0 AND _start IS NOT NULL")
    each = held.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_length") / F.col("_step")) - 1)))
    skip = F.col("range") * F.col("_step")
    out = each.withColumns({"at": F.col("_start") + skip, "size": F.least(F.col("_step"), F.col("_length") - skip), "first_row": F.floor(skip / F.col("_record"))})
    return out.drop("_start", "_length", "_step", "_record")


def dealt(ranges: DataFrame, file: str = "file", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The ranges dealt to as many tasks as their bytes need; ranges that follow each other in a file may go to different tasks."""
    total = ranges.agg(F.sum("size")).first()[0] or 0
    return ranges.repartition(max(1, -(-int(total) // task_bytes)), file, "at")


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon:
        return pyarrow.fs.LocalFileSystem(), path
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def slices(batch: pa.RecordBatch, file: str = "file") -> Iterator[tuple[int, bytes | None]]:
    """(row, bytes) of each range of a batch, one at a time; None where there is no such file, less at the file's end.

    A file stays open from row to row.
    """
    names, ats, sizes = (batch.column(c).to_pylist() for c in (file, "at", "size"))
    held, name = None, None
    for row in sorted(range(batch.num_rows), key=lambda r: (names[r] or "", ats[r])):
        if names[row] != name:
            if held is not None:
                held.close()
            name, held = names[row], None
            if name is not None:
                try:
                    fs, path = _file_system(name)
                    held = fs.open_input_file(path)
                except FileNotFoundError:
                    held = None
        # read_at stops at the file's end by itself, but does not bear a place behind it.
        yield row, None if held is None else held.read_at(max(0, min(sizes[row], held.size() - ats[row])), min(ats[row], held.size()))
    if held is not None:
        held.close()


def contents(ranges: DataFrame, file: str = "file", at_once: int = RANGE_BYTES) -> DataFrame:
    """``ranges`` with the column content: the range's bytes, null where there is no such file."""
    columns = ranges.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], [], 0
            for row, content in slices(batch, file):
                rows.append(row)
                held.append(content)
                size += len(content or b"")
                if size >= at_once:
                    yield _with(batch, rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield _with(batch, rows, held)

    def _with(batch: pa.RecordBatch, rows: list[int], held: list[bytes | None]) -> pa.RecordBatch:
        part = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*columns, "content"])

    return ranges.mapInArrow(read, ranges.select("*", F.lit(None).cast("binary").alias("content")).schema)


def scanned(ranges: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """The same from ``files`` (path, content): for stores that only Spark's readers reach. Files are at most 2 GB."""
    whole = files.select(F.col("path").alias(file), F.col("content").alias("_content"))
    cut = F.substr("_content", F.col("at") + 1, F.col("size").cast("int"))
    return ranges.join(whole, file, "left").withColumn("content", cut).select(*ranges.columns, "content")


LONGEST_LINE = 1 << 20


def lines(ranges: DataFrame, file: str = "file", longest: int = LONGEST_LINE) -> DataFrame:
    """``ranges`` of bytes with one row for each line: line_in_range (from 0) and line (bytes, without its end).

    A line belongs to the range in which it begins, which reads on behind its own end for the rest of it. A range's object ends at
    ``object_end``, a column of ``ranges``; ``object_start`` is where it begins. Lines end with LF or CR LF. A line that needs more than ``longest`` bytes
    behind its range raises an error. Missing files have no lines.
    """
    columns = ranges.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, ats, sizes = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("object_start", "object_end", "at", "size"))
            # One byte before the range tells whether its first line begins with it.
            lead = (ats > starts).astype(np.int64)
            rest = ends - ats - sizes
            over = np.minimum(rest, longest)
            wide = batch.set_column(batch.schema.get_field_index("at"), "at", pa.array(ats - lead)).set_column(batch.schema.get_field_index("size"), "size", pa.array(sizes + lead + over))
            for row, content in slices(wide, file):
                own = int(sizes[row] + lead[row])
                first = 0 if content is None or not lead[row] else content.find(b"\n") + 1
                if content is None or lead[row] and not first or first >= min(own, len(content)):
                    continue  # no file, or no line begins here
                last = content.find(b"\n", own - 1)
                if last < 0 and rest[row] > over[row]:
                    raise ValueError(f"a line of {batch.column(file)[row].as_py()} is longer than {longest} bytes")
                body = content[first:] if last < 0 else content[first:last]
                found = [x.removesuffix(b"\r") for x in body.split(b"\n")]
                for k in range(0, len(found), 50_000):
                    part = batch.slice(row, 1).take(pa.array(np.zeros(len(found[k : k + 50_000]), np.int64)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(range(k, k + part.num_rows), pa.int64()), pa.array(found[k : k + 50_000], pa.binary())], names=[*columns, "line_in_range", "line"])

    return ranges.mapInArrow(cut, ranges.select("*", F.lit(None).cast("long").alias("line_in_range"), F.lit(None).cast("binary").alias("line")).schema)


def line_numbers(cut: DataFrame, object_: list[str]) -> DataFrame:
    """``lines`` with the column row: the line's number in its object, from 0. Only counts of lines, one row a range, are put in order."""
    counts = cut.groupBy(*object_, "range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*object_).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return cut.join(counts.select(*object_, "range", before.alias("_before")), [*object_, "range"]).withColumn("row", F.col("_before") + F.col("line_in_range")).drop("_before")
