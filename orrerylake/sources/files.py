"""Finding products: scans, suffixes, labels beside data, names in other cases, candidate paths, bytes."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.operators.metadata import FITS_SUFFIXES, IMAGE_SUFFIXES, LABEL_SUFFIXES, RASTER_SUFFIXES, TABLE_SUFFIXES, TEXT_SUFFIXES, suffixes

#: Suffixes by kind of file.
KINDS = {"label": LABEL_SUFFIXES, "image": RASTER_SUFFIXES, "table": TABLE_SUFFIXES, "text": TEXT_SUFFIXES, "fits": FITS_SUFFIXES, "desktop image": IMAGE_SUFFIXES}
COMPRESSED = ["gz", "bz2", "zip"]
LABEL_ORDER = ["xml", "lbl", "lblx"]


def scan(spark: SparkSession, path: str, glob: str = "*", with_content: bool = False) -> DataFrame:
    """One row for each file below ``path``: path, modificationTime, length and, if asked for, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files if with_content else files.drop("content")


def file_kind(file: Column) -> Column:
    """The first kind one of whose suffixes is among all the file's suffixes."""
    found = suffixes(file)
    out = F.lit("other")
    for kind, ends in reversed(KINDS.items()):
        out = F.when(F.arrays_overlap(found, F.array(*map(F.lit, ends))), kind).otherwise(out)
    return out


def folder(file: Column) -> Column:
    return F.regexp_extract(file, "^(.*)/[^/]*$", 1)


def file_name(file: Column) -> Column:
    return F.regexp_extract(file, "([^/]*)$", 1)


def stem(file: Column) -> Column:
    """Folder and lower-cased name without its last suffix."""
    return F.concat_ws("/", folder(file), F.lower(F.regexp_replace(file_name(file), r"\.[^.]*$", "")))


def folded(file: Column) -> Column:
    """Folder and lower-cased name; a suffix of compression is dropped unless it is the only suffix."""
    name = F.lower(file_name(file))
    bare = F.when(name.rlike(r"\..*\.(gz|bz2|zip)$"), F.regexp_replace(name, r"\.(gz|bz2|zip)$", "")).otherwise(name)
    return F.concat_ws("/", folder(file), bare)


def with_labels(data: DataFrame, files: DataFrame, file: str = "file", explicit: str | None = None) -> DataFrame:
    """``data`` with the column label_file: given, the file itself if it is a label, or one of the same stem."""
    rank = {e: i for i, e in enumerate(LABEL_ORDER)}
    last = F.lower(F.regexp_extract(F.col("label_file"), r"\.([^.]*)$", 1))
    candidates = files.select(F.col(file).alias("label_file")).where(last.isin(LABEL_ORDER))
    order = F.array_position(F.array(*map(F.lit, LABEL_ORDER)), last)
    best = candidates.groupBy(stem(F.col("label_file")).alias("_stem")).agg(F.min_by("label_file", F.struct(order, "label_file")).alias("_near"))
    own = F.when(F.lower(F.regexp_extract(F.col(file), r"\.([^.]*)$", 1)).isin(list(rank)), F.col(file))
    given = [F.col(explicit)] if explicit else []
    return data.withColumn("_stem", stem(F.col(file))).join(best, "_stem", "left").withColumn("label_file", F.coalesce(*given, own, "_near")).drop("_stem", "_near")


def resolved(names: DataFrame, files: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """``names`` with resolved (null if no file fits) and hits: exact names first, else in any case and compression.

    Each distinct name is looked up once; repeated rows all stay, null names have no hit. Of several files that fit equally well the
    first by name is taken. Repeated rows of ``files`` are one file.
    """
    there = files.select(F.col(file).alias("_file"), folded(F.col(file)).alias("_fold")).distinct()
    asked = names.select(F.col(name).alias("_name")).dropna().distinct().withColumn("_fold", folded(F.col("_name")))
    picked = F.min_by("_file", F.struct(F.col("_file") != F.col("_name"), "_file"))
    found = asked.join(there, "_fold").groupBy("_name").agg(picked.alias("resolved"), F.count("_file").alias("hits"))
    return names.join(found, F.col(name) == F.col("_name"), "left").select(*[names[c] for c in names.columns], "resolved", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def candidate_paths(names: DataFrame, file: str, folders: str, root_of: Column | None = None) -> DataFrame:
    """Every search folder with every name, in order; with ``root_of``, label folders of the root before the last
    folder named data come last.
    """
    root = F.regexp_extract(root_of, "(?i)^(.*)/data(?:/.*)?$", 1) if root_of is not None else None
    more = F.when(root != "", F.array(F.concat(root, F.lit("/label")), F.concat(root, F.lit("/LABEL")))).otherwise(F.array().cast("array<string>")) if root is not None else F.array().cast("array<string>")
    paths = F.concat(F.col(folders), more)
    return names.select("*", F.posexplode(paths).alias("position", "search_folder")).withColumn("path", F.concat_ws("/", "search_folder", F.col(file)))


def byte_range(content: Column, size: int, offset: int = 0, tail: bool = False) -> Column:
    """``size`` bytes from ``offset``; with ``tail`` both count from the end."""
    if not tail:
        return F.substring(content, offset + 1, size)
    n = F.octet_length(content)
    return F.substr(content, F.greatest(n - offset - size, F.lit(0)) + 1, F.least(F.lit(size), n - offset))


def unpacked(name: str, content: bytes | None) -> bytes | None:
    last = name.lower().rsplit(".", 1)[-1]
    if content is None:
        return None
    if last == "gz":
        return gzip.decompress(content)
    if last == "bz2":
        return bz2.decompress(content)
    if last == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(z.namelist()[0])
    return content


def decompressed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content) with the content unpacked by the name's last suffix, a batch at a time."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one file at a time: contents may be large
                n, c = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([unpacked(n, c)], pa.binary())], names=["path", "content"])

    return files.select(F.col(path), F.col(content)).mapInArrow(unpack, "path string, content binary")


LABEL_LIMIT = 1000 * 1024
#: How a label ends.
ENDINGS = ["\nEND {0,8}(?:\r| {8})", "\x00\x00\x00", "\nEND\n"]
ENDING = "|".join(ENDINGS)


def attached_label(content: Column, limit: int = LABEL_LIMIT) -> Column:
    """The label at a file's head, cut after its first ending within the limit; null if the head is no ASCII."""
    head = F.decode(F.substring(content, 1, limit), "ISO-8859-1")
    at = F.regexp_instr(head, F.lit(ENDING))
    found = F.regexp_extract(head, ENDING, 0)
    cut = F.when(at > 0, F.substr(head, F.lit(1), at + F.length(found) - 1)).otherwise(head)
    return F.when(F.substring(head, 1, 20).rlike("^[\\x00-\\x7F]*$"), cut)
