"""Queries over the long metadata table: lookups, blocks, identifiers, pointers, objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerylake.jobs.scratch import kept

#: The keys that identify a product.
IDENTIFIERS = """
    DATA_SET_ID DATA_SET_NAME DATA_QUALITY_DESC FILE_NAME FILE_RECORDS INSTRUMENT_ID INSTRUMENT_HOST_NAME INSTRUMENT_NAME LABEL_RECORDS NOTE PRODUCT_ID
    PRODUCT_TYPE RECORD_BYTES RECORD_TYPE ROW_BYTES ROWS SPACECRAFT_NAME STANDARD_DATA_PRODUCT_ID
""".split()


def key_counts(meta: DataFrame, product: str) -> DataFrame:
    """(product, key, n, repeated): keys at all levels."""
    return meta.groupBy(product, "key").agg(F.count("*").alias("n")).withColumn("repeated", F.col("n") > 1)


def first_values(meta: DataFrame, product: str, keys: list[str]) -> DataFrame:
    """(product, key, value_raw): the first value of each key, shallower levels first, then label order."""
    return meta.where(F.col("key").isin(keys)).groupBy(product, "key").agg(F.min_by("value_raw", F.struct("depth", "seq")).alias("value_raw"))


def metaget(meta: DataFrame, products: DataFrame, product: str, key: str, default: str | None = None) -> DataFrame:
    """(product, value) for every product: the first value of the key, or the default."""
    found = first_values(meta, product, [key]).select(product, F.col("value_raw").alias("value"))
    return products.select(product).join(found, product, "left").select(product, F.coalesce("value", F.lit(default)).alias("value"))


def metablock(meta: DataFrame, product: str, name: str) -> DataFrame:
    """Rows of the first block of that name in each product, deeper blocks in it included; the whole label where the name is a parameter's, and no block's.

    Products with neither have no rows.
    """
    level = F.array_position("path", name).cast("int")
    held = meta.withColumn("_block", F.when(level > 0, F.struct(level.alias("level"), F.get("blocks", level - 1).alias("at"))))
    first = held.groupBy(product).agg(F.min("_block").alias("_first"), F.max(F.col("key") == name).alias("_named")).where("_first IS NOT NULL OR _named")
    return held.join(first, product).where("_first IS NULL OR _block = _first").drop("_block", "_first", "_named")


def identifiers(meta: DataFrame, product: str, keys: list[str] = IDENTIFIERS) -> DataFrame:
    """One row for each product, one column for each key; missing ones are empty texts."""
    first = meta.where(F.col("key").isin(list(keys))).groupBy(product)
    value = F.coalesce("value_string", "value_raw")
    wide = first.agg(*[F.min_by(value, F.when(F.col("key") == k, F.struct("depth", "seq"))).alias(k.lower()) for k in keys])
    return wide.na.fill("", [k.lower() for k in keys])


def pointers(meta: DataFrame) -> DataFrame:
    """Rows whose key is a pointer, and the name it points to."""
    return meta.where(F.col("key").startswith("^")).withColumn("name", F.expr("substring(key, 2)"))


def numbered_pointers(meta: DataFrame, product: str) -> DataFrame:
    """Pointers with repeated ones numbered in label order: NAME_0, NAME_1. Structures never are."""
    same = Window.partitionBy(product, "key")
    number = F.row_number().over(same.orderBy("seq")) - 1
    plain = F.col("key").rlike("STRUCTURE|PDS_OBJECT") | (F.count("*").over(same) == 1)
    return pointers(meta).withColumn("indexed", F.when(plain, F.col("name")).otherwise(F.concat_ws("_", F.col("name"), number.cast("string"))))


def is_trivial(name: Column) -> Column:
    """Objects that are never read by themselves: picture tags, format structures, and inner pipeline objects."""
    tags = name.contains("TIFF") & ~name.contains("IMAGE") & ~name.contains("DOCUMENT")
    return tags | name.contains("STRUCTURE") | name.contains("PDS_OBJECT")


#: Suffixes of files by how they are read.
FITS_SUFFIXES = "fits fit fz".split()
RASTER_SUFFIXES = "img rgb".split()
TEXT_SUFFIXES = "txt md".split()
TABLE_SUFFIXES = "tab csv".split()
IMAGE_SUFFIXES = "bmp tif tiff jp2 jpf jpc jpx jpg jpeg gif png webp".split()
LABEL_SUFFIXES = "xml lbl lblx 2bl 2al 2cl 01l 3bl 3al 3cl".split()
#: Parts of object names.
TEXT_WORDS = "TEXT PDF MAP_PROJECTION_CATALOG FILENAME DESC".split()
TABLE_WORDS = "TABLE SPREADSHEET CONTAINER SERIES SPECTRUM HISTOGRAM FILE".split()
IMAGE_WORDS = "IMAGE QUB XDR_DOCUMENT".split()
#: Ends of names of catalogue and description objects, which reading everything skips.
SKIPPED_ENDS = ["_DESC", "DESCRIPTION"]


def suffixes(file: Column) -> Column:
    """All suffixes of a file's name, lower-cased."""
    name = F.element_at(F.split(F.lower(file), "/"), -1)
    parts = F.split(name, r"\.")
    return F.slice(parts, F.lit(2), F.size(parts))


def has_suffix(file: Column, kinds: list[str]) -> Column:
    return F.arrays_overlap(suffixes(file), F.array(*map(F.lit, kinds)))


def _holds(name: Column, words: list[str], behind: str = "") -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w + behind) for w in words])


def kind_by_suffix(file: Column) -> Column:
    """How an object is read that is known by its file's name only."""
    by = [(FITS_SUFFIXES, "fits"), (RASTER_SUFFIXES, "image"), (TEXT_SUFFIXES, "text"), (TABLE_SUFFIXES, "table"), (IMAGE_SUFFIXES, "desktop image")]
    return reduce(lambda out, c: F.when(has_suffix(file, c[0]), c[1]).otherwise(out), reversed(by), F.lit("unknown"))


def object_kind(name: Column, file: Column) -> Column:
    """How an object is read: the first that fits of an ordered cascade over its name and its file's suffixes.

    A null name or file counts as empty: it holds no word and has no suffix.
    """
    name, file = F.upper(F.coalesce(name, F.lit(""))), F.coalesce(file, F.lit(""))
    table = _holds(name, TABLE_WORDS) & ~_holds(name, TABLE_WORDS, "_HEADER") & ~_holds(name, TABLE_WORDS, "_NAME") & ~name.contains("HISTOGRAM_IMAGE")
    cases = [
        (is_trivial(name), F.lit("trivial")),
        (name == "LABEL", F.lit("label")),
        (has_suffix(file, FITS_SUFFIXES), F.lit("fits")),
        (has_suffix(file, IMAGE_SUFFIXES), F.lit("desktop image")),
        (_holds(name, TEXT_WORDS), F.lit("text")),
        (name.contains("ARRAY"), F.lit("array")),
        (table, F.lit("table")),
        (name.contains("HEADER"), F.lit("header")),
        (_holds(name, IMAGE_WORDS), F.lit("image")),
        (name.contains("FILE_NAME"), kind_by_suffix(file)),
    ]
    return reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), reversed(cases), F.lit("unknown"))


def is_skipped(name: Column) -> Column:
    """Whether reading everything leaves the object out: catalogue entries and descriptions, numbered ones included."""
    bare = F.regexp_replace(F.upper(name), "_[0-9]*$", "")
    return F.startswith(F.upper(name), F.lit("DATA_SET_MAP_PROJECT")) | F.endswith(F.upper(name), F.lit(SKIPPED_ENDS[0])) | F.endswith(F.upper(name), F.lit(SKIPPED_ENDS[1])) | F.endswith(bare, F.lit(SKIPPED_ENDS[1]))


def start_byte(target: Column, record_bytes: Column, row_bytes: Column, n_rows: Column, file_size: Column) -> Column:
    """First byte, from 0, of an object's target struct<file, value, units>.

    1 is the file's start; bytes count from 1; other units and bare numbers are records; a number without
    record size is counted from the file's end by its rows; no number is 0.
    """
    n, units = target["value"], F.upper(target["units"])
    from_end = F.when(n_rows.isNotNull(), F.greatest(file_size - n_rows * row_bytes, F.lit(0)))
    return F.when(n.isNull(), 0).when(units == "BYTES", n - 1).when(n == 1, 0).otherwise(F.coalesce(record_bytes * (n - 1), from_end))


def table_length(n_bytes: Column, n_records: Column, record_bytes: Column, row_bytes: Column, row_suffix: Column) -> Column:
    """Bytes of a table: given, or its records by the block's record size, row size, or the product's."""
    row = row_bytes + F.coalesce(row_suffix, F.lit(0))
    return F.coalesce(n_bytes, n_records * F.coalesce(record_bytes, row))


def table_position(name: Column, record_type: Column, target: Column, start: Column, length: Column, record_bytes: Column, n_rows: Column) -> Column:
    """struct<as_rows, start, length>: where a table lies, in rows (lines) or in bytes.

    In rows only where a stream's records have no known size, the name says text (ASCII, SPREADSHEET or HEADER) and the target counts records;
    the first row is number 0. Else in bytes.
    """
    by_rows = F.coalesce((record_type == "STREAM") & record_bytes.isNull() & F.upper(name).rlike("ASCII|SPREADSHEET|HEADER") & (F.coalesce(F.upper(target["units"]), F.lit("")) != "BYTES"), F.lit(False))
    first = F.greatest(F.coalesce(target["value"], F.lit(1).cast("long")) - 1, F.lit(0).cast("long"))
    return F.struct(by_rows.alias("as_rows"), F.when(by_rows, first).otherwise(start).cast("long").alias("start"), F.when(by_rows, n_rows).otherwise(length).cast("long").alias("length"))


def numbered_blocks(blocks: DataFrame, product: str) -> DataFrame:
    """``blocks`` (at, path, kind) with the column indexed: blocks of one name in one product are NAME_0, NAME_1 in label order, as their pointers are."""
    same = Window.partitionBy(product, "kind")
    number = (F.row_number().over(same.orderBy("at")) - 1).cast("string")
    plain = F.col("kind").rlike("STRUCTURE|PDS_OBJECT") | (F.count("*").over(same) == 1)
    return blocks.withColumn("indexed", F.when(plain, F.col("kind")).otherwise(F.concat_ws("_", "kind", number)))


def edited(meta: DataFrame, where: Column, value: Column | None = None, key: Column | None = None) -> DataFrame:
    """The table with values or keys replaced where a condition holds, at any level."""
    out = meta
    if value is not None:
        out = out.withColumn("value_raw", F.when(where, value).otherwise(F.col("value_raw")))
    if key is not None:
        out = out.withColumn("key", F.when(where, key).otherwise(F.col("key")))
    return out


def similarity(a: Column, b: Column) -> Column:
    """2 * LCS / (len + len): what insertions and deletions alone leave of two texts."""
    other = F.split(b, "")
    empty = F.transform(other, lambda _: F.lit(0))

    def row(before: Column, ch: Column) -> Column:
        start = F.struct(F.lit(0).alias("left"), F.lit(0).alias("corner"), F.array().cast("array<int>").alias("out"))

        def cell(s: Column, pair: Column) -> Column:
            value = F.when(pair["c"] == ch, s["corner"] + 1).otherwise(F.greatest(s["left"], pair["up"]))
            return F.struct(value.alias("left"), pair["up"].alias("corner"), F.concat(s["out"], F.array(value)).alias("out"))

        return F.aggregate(F.transform(other, lambda c, i: F.struct(c.alias("c"), F.get(before, i).alias("up"))), start, cell, lambda s: s["out"])

    common = F.element_at(F.aggregate(F.split(a, ""), empty, row), -1)
    return F.coalesce(F.try_divide(2.0 * F.coalesce(common, F.lit(0)), F.length(a) + F.length(b)), F.lit(1.0))


def _best(scored: DataFrame, term: str) -> DataFrame:
    return scored.groupBy(term).agg(F.min_by("key", F.struct(-F.col("ratio"), "key")).alias("key"), F.max("ratio").alias("ratio"))


def _pairs_of(text: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2))))


def fuzzy_candidates(keys: DataFrame, terms: DataFrame, term: str) -> DataFrame:
    """(term, key): keys that share a pair of neighbouring characters with a term, met by an equi-join on the pairs."""
    a = terms.select(term, F.explode(_pairs_of(F.col(term))).alias("_pair"))
    b = keys.select("key", F.explode(_pairs_of(F.col("key"))).alias("_pair"))
    return a.join(b, "_pair").select(term, "key").distinct()


def fuzzy_keys(meta: DataFrame, terms: DataFrame, term: str = "term", most_terms: int = 10_000) -> DataFrame:
    """(term, key, ratio): the distinct key most like each term; of equal ones the first by name.

    An insertion or deletion spoils two pairs of neighbouring characters at most, so a key of l characters that shares no pair with a term of n has
    a ratio of 1 - (n - 1) / 4n at most, whatever l is. Keys that share a pair are compared first; only terms whose best ratio is not above that bound
    are compared with all keys. Distinct keys are a vocabulary, small beside the table; terms are a stated query set of at most ``most_terms``, which is checked. Null
    terms and keys are left out; an empty term is unlike every key but an empty one.
    """
    terms = terms.select(term).dropna().distinct()
    if terms.limit(most_terms + 1).count() > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    keys = kept(meta.select("key").dropna().distinct(), "keys")
    near = kept(_best(fuzzy_candidates(keys, terms, term).withColumn("ratio", similarity(F.col(term), F.col("key"))), term), "near")
    n = F.length(term)
    sure = near.where(F.col("ratio") > 1 - (n - 1) / (4 * n))
    open_ = terms.join(sure.select(term), term, "left_anti")
    far = keys.join(F.broadcast(open_), F.lit(True)).select(term, "key", similarity(F.col(term), F.col("key")).alias("ratio"))
    return sure.unionByName(_best(far, term))
