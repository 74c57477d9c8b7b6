"""Image files written by Spark: a Data Source writer that joins ordered segments into one file each, and commits in two phases.

    spark.dataSource.register(ImageFiles)
    segments.write.format("image_files").option("path", folder).mode("append").save()

Rows are (file, content): all rows of a file in one task, in the order of its bytes (see ``sinks.write_grey_maps``). A task streams them
into hidden files of its own attempt; only when all tasks are done are these moved to their names, so a lost executor or a
second attempt leaves no half file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ranges import _file_system


@dataclass
class Written(WriterCommitMessage):
    """Hidden files and the names that they get."""

    moves: list[tuple[str, str]]


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["file", "content"]:
            raise ValueError("image files are made of the columns file and content")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        fs, folder = _file_system(self.path)
        fs.create_dir(folder, recursive=True)
        attempt, moves, seen = uuid.uuid4().hex, [], set()
        name, out = None, None
        try:
            for row in rows:
                if row["file"] is None or "/" in row["file"] or row["file"].startswith("."):
                    raise ValueError(f"{row['file']!r} is no name of a file")
                if row["file"] != name:
                    if out is not None:
                        out.close()
                    if row["file"] in seen:
                        raise ValueError(f"the rows of {row['file']} do not follow each other")
                    name = row["file"]
                    seen.add(name)
                    moves.append((f"{folder}/.{name}-{attempt}", f"{folder}/{name}"))
                    out = fs.open_output_stream(moves[-1][0])
                out.write(bytes(row["content"] or b""))
        except BaseException:
            if out is not None:
                out.close()
            _removed(fs, moves)
            raise
        if out is not None:
            out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _file_system(self.path)
        moves = [m for written in messages if written is not None for m in written.moves]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            _removed(fs, moves)
            raise ValueError("rows of one file came to several tasks")
        for hidden, to in moves:
            fs.move(hidden, to)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _file_system(self.path)
        _removed(fs, [m for written in messages if written is not None for m in written.moves])


def _removed(fs: pyarrow.fs.FileSystem, moves: list[tuple[str, str]]) -> None:
    for hidden, _ in moves:
        if fs.get_file_info(hidden).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(hidden)
