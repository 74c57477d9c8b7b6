"""Format definitions as data: repeats, offsets, names, injected files, schemas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrerylake.functions import binary, vectorized

PLACEHOLDER = "PLACEHOLDER"


def repeats(n: Column) -> Column:
    """0 to n - 1; counts below 1 act as 1."""
    return F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1)


def flattened(fields: DataFrame) -> DataFrame:
    """Format rows with one row for each repeated block and item, and the byte each starts at.

    ``fields``: NAME, START_BYTE (from 1), BYTES, ITEMS, ITEM_BYTES, ITEM_OFFSET and, for the block around,
    BLOCK_START (from 1), BLOCK_REPETITIONS, BLOCK_BYTES; missing ones are null. Adds repetition, item, SB_OFFSET (from
    0) and WIDTH. A row whose ITEM_OFFSET is below its ITEM_BYTES has a null SB_OFFSET.
    """
    block = fields.select("*", F.explode(repeats(F.col("BLOCK_REPETITIONS"))).alias("repetition"))
    item = block.select("*", F.explode(repeats(F.col("ITEMS"))).alias("item"))
    width = F.coalesce("ITEM_BYTES", F.when(F.coalesce("ITEMS", F.lit(1)) > 1, (F.col("BYTES") / F.col("ITEMS")).cast("int")), "BYTES")
    step = F.coalesce("ITEM_OFFSET", width)
    before = F.coalesce(F.col("BLOCK_START") - 1 + F.col("repetition") * F.col("BLOCK_BYTES"), F.lit(0))
    offset = F.when(F.coalesce(F.col("ITEM_OFFSET") >= width, F.lit(True)), before + F.col("START_BYTE") - 1 + F.col("item") * step)
    return item.withColumns({"WIDTH": width.cast("int"), "SB_OFFSET": offset.cast("int")})


#: Blocks that define a field, and blocks that repeat what is in them.
FIELD_BLOCKS = ["COLUMN", "FIELD", "ELEMENT"]
REPEATED_BLOCKS = ["CONTAINER", "COLLECTION", "ARRAY"]
_TEXT_KEYS = ["NAME", "DATA_TYPE", "INTERCHANGE_FORMAT", "FIELD_DELIMITER", "SAMPLE_TYPE", "BAND_STORAGE_TYPE"]
_NUMBER_KEYS = ["START_BYTE", "BYTES", "ITEMS", "ITEM_BYTES", "ITEM_OFFSET", "REPETITIONS", "ROWS", "ROW_BYTES", "ROW_PREFIX_BYTES", "ROW_SUFFIX_BYTES", "RECORDS", "LINES", "LINE_SAMPLES", "SAMPLE_BITS", "BANDS", "LINE_PREFIX_BYTES", "LINE_SUFFIX_BYTES"]
_REAL_KEYS = ["SCALING_FACTOR", "OFFSET"]


def block_table(meta: DataFrame, product: str) -> DataFrame:
    """(product, at, path, chain, NAME, ..., kind): one row for each block of a label that has statements of its own.

    at: where the block opens; path and chain: names of all blocks around it and itself, and where they open; kind: its own name. Of a repeated key the first value counts. ``meta``: the
    long metadata table; a block of another label is another block.
    """
    inside = meta.where((F.col("depth") > 0) & F.col("key").isNotNull())
    keys = {k: F.min_by(F.coalesce("value_string", "value_raw"), F.when(F.col("key") == k, F.col("seq"))) for k in _TEXT_KEYS + _NUMBER_KEYS + _REAL_KEYS}
    wide = inside.groupBy(product, F.element_at("blocks", -1).alias("at")).agg(F.first("path").alias("path"), F.first("blocks").alias("chain"), *[c.alias(k) for k, c in keys.items()])
    return wide.withColumns({"kind": F.element_at("path", -1)} | {k: F.col(k).try_cast("int") for k in _NUMBER_KEYS} | {k: F.col(k).try_cast("double") for k in _REAL_KEYS})


def fields_of_blocks(meta: DataFrame, product: str) -> DataFrame:
    """Every field that the labels' blocks define, with the byte it starts at in the record, repetitions and items spread out.

    (product, object_at, object, at, NAME, DATA_TYPE, repetition, item, SB_OFFSET, WIDTH, SCALING_FACTOR, OFFSET). Blocks may lie in containers, collections
    and arrays to any depth: each adds its own start and its repetition's stride, innermost repetitions run fastest. Counts below 1
    act as 1; missing starts count as 1. No join: a product's repeated blocks, which its label holds in one row too, travel as one array beside each of its fields. Two shuffles at
    most, of block rows only; none where ``meta`` is dealt by product. An empty table stays empty.
    """
    c, of_product = F.col, Window.partitionBy(product)
    step = F.struct(F.coalesce("START_BYTE", F.lit(1)).alias("start"), F.coalesce("BYTES", F.lit(0)).alias("bytes"), F.greatest(F.coalesce("REPETITIONS", F.lit(1)), F.lit(1)).alias("times"))
    repeats_ = c("kind").isin(REPEATED_BLOCKS) & c(product).isNotNull() & c("at").isNotNull()
    beside = {"_at": F.collect_list(F.when(repeats_, c("at"))).over(of_product), "_step": F.collect_list(F.when(repeats_, step)).over(of_product)}
    fields = block_table(meta, product).withColumns(beside).where(c("kind").isin(FIELD_BLOCKS))
    around = F.transform(F.slice("chain", F.lit(1), F.size("chain") - 1), lambda at: F.get("_step", F.array_position("_at", at) - 1))
    above = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("chain", F.lit(1), F.size("chain") - 1), lambda kind, at: F.struct(kind.alias("kind"), at.alias("at")))
    own = F.try_element_at(F.filter(above, lambda b: ~b["kind"].isin(REPEATED_BLOCKS)), F.lit(-1))
    held = fields.withColumns({"object": own["kind"], "object_at": own["at"], "steps": F.array_compact(around)}).drop("_at", "_step")
    total = F.aggregate("steps", F.lit(1), lambda n, s: n * s["times"])
    each = held.withColumn("repetition", F.explode(F.sequence(F.lit(0), total - 1))).withColumn("item", F.explode(repeats(F.col("ITEMS"))))

    def outward(state: Column, s: Column) -> Column:
        own = state["rest"] % s["times"]
        return F.struct(F.floor(state["rest"] / s["times"]).cast("int").alias("rest"), (state["at"] + s["start"] - 1 + own * s["bytes"]).cast("int").alias("at"))

    before = F.aggregate(F.reverse("steps"), F.struct(F.col("repetition").alias("rest"), F.lit(0).alias("at")), outward, lambda x: x["at"])
    width = F.coalesce("ITEM_BYTES", F.when(F.coalesce("ITEMS", F.lit(1)) > 1, (F.col("BYTES") / F.col("ITEMS")).cast("int")), "BYTES")
    offset = before + F.coalesce("START_BYTE", F.lit(1)) - 1 + F.col("item") * F.coalesce("ITEM_OFFSET", width)
    return each.select(product, "object_at", "object", "at", "NAME", "DATA_TYPE", "repetition", "item", offset.cast("int").alias("SB_OFFSET"), width.cast("int").alias("WIDTH"), "SCALING_FACTOR", "OFFSET")


def filled_bytes(bytes_: Column, items: Column, item_bytes: Column) -> Column:
    return F.coalesce(bytes_, items * item_bytes)


def padded(flat: DataFrame, object_: str, row_bytes: str) -> DataFrame:
    """The rows and, where fields end before the row does, a placeholder for the rest."""
    end = flat.groupBy(object_).agg(F.max(F.col("SB_OFFSET") + F.col("WIDTH")).alias("_end"), F.max(row_bytes).alias("_row")).where("_end < _row")
    pad = end.select(object_, F.lit(PLACEHOLDER).alias("NAME"), F.col("_end").cast("int").alias("SB_OFFSET"), (F.col("_row") - F.col("_end")).cast("int").alias("WIDTH"))
    return flat.unionByName(pad, allowMissingColumns=True)


def without_placeholders(flat: DataFrame) -> DataFrame:
    return flat.where(~F.col("NAME").startswith(PLACEHOLDER))


def unique_names(fields: DataFrame, by: list[str], order: list[str], name: str = "NAME", start: str | None = "START_BYTE") -> DataFrame:
    """Column ``unique``: repeated names get _0, _1 in order; reserved fields are named after their first byte. A column named _nth goes."""
    same = Window.partitionBy(*by, name)
    # Numbered first: the order that numbering sorts by serves the counts too, and rows are sorted once.
    numbered = fields.withColumn("_nth", (F.row_number().over(same.orderBy(*order)) - 1).cast("string"))
    stem = F.col(name)
    if start:
        stem = F.when(stem == "RESERVED", F.concat_ws("_", stem, F.min(start).over(same).cast("string"))).otherwise(stem)
    return numbered.withColumn("unique", F.when((F.count("*").over(same) > 1) | (F.col(name) == "RESERVED"), F.concat_ws("_", stem, "_nth")).otherwise(stem)).drop("_nth")


#: Inclusions of format files by others at most, over the whole archive; a checked bound of what the driver looks at.
MOST_INCLUSIONS = 100_000


def is_structure_pointer(key: Column) -> Column:
    """Whether a key names a format file: ``^STRUCTURE``, or a longer name that ends so."""
    return (key == "^STRUCTURE") | (F.startswith(key, F.lit("^")) & F.endswith(key, F.lit("_STRUCTURE")))


def _longest_chain(links: list[tuple[str, str]]) -> int:
    """Steps of the longest way along the links, taken off from its ends."""
    left, steps = set(links), 0
    while left:
        going = {a for a, _ in left}
        ends = {(a, b) for a, b in left if b not in going}
        if not ends:
            raise ValueError("format files include themselves")
        left, steps = left - ends, steps + 1
    return steps


def injected(rows: DataFrame, files: DataFrame, object_: str, file_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): structure pointers replaced in place by the rows of the files they name, until none is left that names one.

    ``rows``: object_, order (array<int>), key, value; ``files``: file, seq, key, value. A pointer that names no file stays and is
    in ``missing``. Format files are few and shared by many objects; the join is by folded name. Whether another
    level is needed is asked of the files alone. Files that include themselves raise an error. Null keys are no pointers.
    """
    inner = files.select(F.col("file").alias("_file"), F.col("seq").alias("_seq"), F.col("key").alias("_key"), F.col("value").alias("_value"))

    def level(of: DataFrame) -> DataFrame:
        points = F.coalesce(is_structure_pointer(F.col("key")), F.lit(False))
        joined = of.withColumn("_file", F.when(points, file_of(F.col("value")))).join(inner, "_file", "left")
        found = F.col("_seq").isNotNull()
        return joined.select(
            object_,
            F.when(found, F.concat("order", F.array("_seq"))).otherwise(F.col("order")).alias("order"),
            F.when(found, F.col("_key")).otherwise(F.col("key")).alias("key"),
            F.when(found, F.col("_value")).otherwise(F.col("value")).alias("value"),
        )

    names = files.where(is_structure_pointer(F.col("key"))).select(F.col("file").alias("from"), file_of(F.col("value")).alias("to")).distinct()
    links = names.join(files.select(F.col("file").alias("to")).distinct(), "to").limit(MOST_INCLUSIONS + 1).collect()
    if len(links) > MOST_INCLUSIONS:
        raise ValueError(f"more than {MOST_INCLUSIONS} inclusions")
    levels = 1 + _longest_chain([(r["from"], r["to"]) for r in links])
    out = rows
    for _ in range(levels):
        out = level(out)
    return out, out.where(is_structure_pointer(F.col("key"))).select(object_, "value").distinct()


def is_ascii(fields: DataFrame, object_: str) -> DataFrame:
    """(object, ascii): any ASCII type, or a name or interchange format that says so."""
    says = F.col("DATA_TYPE").contains("ASCII") | F.upper(object_).rlike("SPREADSHEET|ASCII") | (F.coalesce(F.col("INTERCHANGE_FORMAT"), F.lit("")) == "ASCII")
    return fields.groupBy(object_).agg(F.coalesce(F.max(F.coalesce(says, F.lit(False))), F.lit(False)).alias("ascii"))


def group_names(groups: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Full names of fields in groups: unnamed groups become GROUP_n, siblings of one name are numbered."""
    level = Window.partitionBy(*by).orderBy(*order)
    unnamed = (F.sum(F.col("group_name").isNull().cast("int")).over(level) - 1).cast("string")
    named = groups.withColumn("_group", F.coalesce("group_name", F.concat(F.lit("GROUP_"), unnamed)))
    full = unique_names(named, [*by, "_group"], order, "field_name", None)
    return full.withColumn("full_name", F.concat_ws(", ", "_group", "unique")).drop("_group", "unique")


def nested_names(items: DataFrame, by: list[str], place: str = "place", is_group: str = "is_group", name: str = "name", depth: int | None = None, tasks: int | None = None) -> DataFrame:
    """``items`` with full_name: the names of the groups around an item, from the outermost, and its own, by ", ".

    ``place`` is an item's path in its object, array<int>: each number its position within the group that holds it. A group without
    a name becomes GROUP_n, n counted among the groups within the same one, named ones too; groups, or fields, of one name within
    the same group are numbered _0, _1. Groups nest to any depth. A field without a name counts as empty. An item whose place is null has no full
    name, one whose object is null only its own. Repeated rows all stay and are numbered like siblings; of groups with one place the first by name holds for what is in them.
    An empty table gives none. Columns of items named _inside, _own, _kind, _number and _outer go, one named full_name is replaced.

    ``depth``: groups around an item at most; an item with more raises an error. Without it a pass over the items finds it. ``tasks``: objects
    are dealt whole to so many tasks, in one shuffle; without it Spark deals groups, then outermost groups, as it chooses.
    """
    c = F.col
    if depth is None:
        depth = max(0, (items.agg(F.max(F.size(place))).first()[0] or 0) - 1)
    inside = F.when(F.size(place) - 1 > depth, F.raise_error(F.lit(f"an item lies in more than {depth} groups"))).when(F.size(place) > 1, F.slice(c(place), F.lit(1), F.size(place) - 1)).otherwise(F.array().cast("array<int>"))
    kinds = (items.repartition(tasks, *by) if tasks else items).withColumn("_inside", inside).withColumn("_kind", F.coalesce(c(is_group), F.lit(False)))
    siblings = Window.partitionBy(*by, "_inside", "_kind")
    number = F.dense_rank().over(siblings.orderBy(place)) - 1
    named = kinds.withColumn("_own", F.coalesce(name, F.when(c("_kind"), F.concat(F.lit("GROUP_"), number.cast("string"))).otherwise("")))
    same = Window.partitionBy(*by, "_inside", "_kind", "_own")
    numbered = named.withColumn("_number", (F.row_number().over(same.orderBy(place)) - 1).cast("string"))
    known = numbered.withColumn("_own", F.when(F.count("*").over(same) > 1, F.concat_ws("_", "_own", "_number")).otherwise(c("_own"))).withColumn("_outer", F.get(place, F.lit(0)))
    # In the order of places a group stands before all that is in it, so the last group of a level is the one around an item, if its place begins the item's.
    before = Window.partitionBy(*by, "_outer").orderBy(place, F.desc("_own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has_object = reduce(and_, [c(k).isNotNull() for k in by])

    def around(n: int) -> Column:
        group = F.last(F.when(c("_kind") & (F.size(place) == n), F.struct(c(place).alias("at"), c("_own").alias("name"))), ignorenulls=True).over(before)
        return F.when(has_object & (F.size("_inside") >= n) & (group["at"] == F.slice("_inside", F.lit(1), F.lit(n))), group["name"])

    full = known.withColumn("full_name", F.when(c(place).isNotNull(), F.concat_ws(", ", *map(around, range(1, depth + 1)), "_own")))
    return full.select(*[k for k in items.columns if k not in ("_inside", "_own", "_kind", "_number", "_outer", "full_name")], "full_name")


def line_prefix(rows: Column, suffix: Column, image: Column) -> Column:
    """struct<rows, row_suffix_bytes> of a table beside an image's lines, from the image block unless given."""
    return F.struct(F.coalesce(rows, image["LINES"]).alias("rows"), F.coalesce(suffix, (image["SAMPLE_BITS"] / 8 * image["LINE_SAMPLES"]).cast("int")).alias("row_suffix_bytes"))


#: Spark types of integers by width, signed and not.
INTEGERS = {(1, True): "tinyint", (2, True): "smallint", (4, True): "int", (8, True): "bigint", (1, False): "smallint", (2, False): "int", (4, False): "bigint", (8, False): "decimal(20,0)"}


_OTHERS = {"ascii_integer": "bigint", "ascii_real": "double", "boolean": "boolean", "logical": "boolean"}


def spark_type(kind: str, width: int, is_signed: bool) -> str:
    if kind == "integer":
        return INTEGERS[width, is_signed]
    if kind in _OTHERS:
        return _OTHERS[kind]
    if kind in ("ieee", "vax", "ibm"):
        return "float" if width == 4 and kind != "ibm" else "double"
    return {"text": "string", "ebcdic": "string", "bits": "string"}.get(kind, "binary")


def schema_of(fields: list[dict]) -> StructType:
    """Schema of one object's format: a short list of name, kind, width, is_signed."""
    return StructType.fromDDL(", ".join(f"`{f['name']}` {spark_type(f['kind'], f['width'], f['is_signed'])}" for f in fields))


def decoded(record: Column, kind: str, order: str, start: int, width: int, is_signed: bool) -> Column:
    """One field of a binary record by its decoder."""
    if kind == "integer":
        value = (binary.signed if is_signed else binary.unsigned)(record, start, width, order)
    elif kind == "ieee":
        value = binary.ieee(record, start, width, order)
    elif kind == "vax":
        value = binary.vax(record, start)
    elif kind == "ibm":
        value = binary.ibm(record, start, width)
    elif kind == "bits":
        value = binary.bit_text(record, start, width, order)
    elif kind == "ebcdic":
        value = binary.ebcdic(F.substring(record, start, width))
    elif kind in ("ascii_integer", "ascii_real"):
        value = F.trim(F.decode(F.substring(record, start, width), "ISO-8859-1"), F.lit(' \t\r\n",\0')).try_cast(spark_type(kind, width, is_signed))
    elif kind == "boolean":
        value = binary.hex_of(record, start, width, "big").rlike("[^0]")
    elif kind == "logical":
        value = F.substring(record, start, 1) == F.lit(b"T")
    elif kind == "text":
        value = F.rtrim(F.decode(F.substring(record, start, width), "ISO-8859-1"))
    else:
        value = F.substring(record, start, width)
    return value.cast(spark_type(kind, width, is_signed))


def decode_records(records: DataFrame, fields: list[dict], record: str = "record") -> DataFrame:
    """A typed column for each field of a format, all cut and decoded in one projection."""
    return records.select(*[decoded(F.col(record), f["kind"], f["order"], f["start"], f["width"], f["is_signed"]).alias(f["name"]) for f in fields])


def decode_batches(records: DataFrame, fields: list[dict], record: str = "record") -> DataFrame:
    """The same table as ``decode_records`` for records of one length, a batch of records at a time."""
    return vectorized.decoded_records(records, fields, schema_of(fields), record)


def group_offset(location: Column, groups: Column) -> Column:
    """First byte of a field, from 1, in nested groups: its own location and, for each group around, the group's
    location and its repetition's stride. ``groups``: array<struct<location, stride, repetition>>.
    """
    return F.aggregate(groups, location, lambda at, g: at + g["location"] - 1 + g["stride"] * g["repetition"])


def delimited_position(position: Column, groups: Column) -> Column:
    """Column of a delimited field in nested groups, from 1: groups repeat whole, ``fields`` columns at a time."""
    return F.aggregate(groups, position, lambda at, g: at + g["fields"] * g["repetition"])


def spread_cells(frame: DataFrame, column: str, n: int) -> DataFrame:
    """An array column as NAME_0 to NAME_n-1; cells that an array lacks are null."""
    return frame.select(*[c for c in frame.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{column}_{i}") for i in range(n)])


def clean_name(name: Column) -> Column:
    """A full name without its unnamed groups and without commas and blanks at its ends."""
    return F.trim(F.regexp_replace(name, r"GROUP_[0-9]+,?\s*", ""), F.lit(", "))


def array_offsets(start: Column, axes: Column, element_bytes: Column) -> Column:
    """First byte, from 0, of each element of an array field, in storage order; ``start`` is the array's first byte, from 1."""
    n = F.aggregate(axes, F.lit(1), lambda a, b: a * b.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: start - 1 + i * element_bytes)


def array_elements(record: Column, start: Column, axes: Column, element_bytes: Column, fields: list[dict]) -> Column:
    """An array field whose elements are blocks of fields, as array<struct>; fields start within their element.

    ``fields``: as for ``decode_records``. Elements beyond the record's end have null fields.
    """

    def element(at: Column) -> Column:
        own = F.substring(record, at + 1, element_bytes)
        return F.struct(*[decoded(own, f["kind"], f["order"], f["start"], f["width"], f["is_signed"]).alias(f["name"]) for f in fields])

    return F.transform(array_offsets(start, axes, element_bytes), element)


def sampled_field(i: Column, first: Column, step: Column, scale: str = "linear", base: float = 10.0) -> Column:
    """Value of a uniformly sampled field in record i, from 0: equal steps, equal ratios, or equal steps of a power's logarithm."""
    if scale == "logarithmic":
        return first * F.pow(step, i)
    if scale == "exponential":
        return F.log10(F.pow(F.lit(base), first) + i * step) / F.log10(F.lit(base))
    return first + i * step


def sampling_fits(made: Column, given: Column, tolerance: float = 0.001) -> Column:
    """Whether the last value that the sampling makes is the one that the label gives, to a thousandth; null where none is given."""
    return F.when(given.isNotNull(), F.abs(made - given) <= F.abs(given) * tolerance)


# --- formats as data: many products of many formats at once --------------------------------------------------------

FORMAT = "array<struct<name:string,kind:string,order:string,start:int,width:int,is_signed:boolean,scale:double,offset:double>>"
#: Columns of all formats together at most; a checked bound of what the driver holds as a schema.
MOST_COLUMNS = 20_000


def field_kind(data_type: Column, width: Column, is_ascii: Column) -> Column:
    """struct<kind, order, is_signed> of a field; in tables of text, numbers are text, and elsewhere where the type says so."""
    t = F.regexp_replace(F.upper(data_type), " ", "_")
    by_text = is_ascii | F.startswith(t, F.lit("ASCII_"))
    kind = F.when(t.contains("INTEGER"), "ascii_integer").when(t.rlike("REAL|FLOAT"), "ascii_real").otherwise("text")
    code = binary.type_code(data_type, width)
    own = F.when(t == "BOOLEAN", F.struct(F.lit("boolean").alias("kind"), F.lit("big").alias("order"), F.lit(False).alias("is_signed"))).otherwise(code)
    return F.when(by_text, F.struct(kind.alias("kind"), F.lit("big").alias("order"), F.lit(False).alias("is_signed"))).otherwise(own)


def fingerprinted(fields: DataFrame, object_: list[str], is_ascii: str = "is_ascii") -> DataFrame:
    """(object_, fingerprint, fields): each object's format as one value, and a hash of it that equal formats share.

    ``fields``: as ``fields_of_blocks`` gives them, and whether the table is one of text. Names are made unique; fields stand in the order of their
    bytes. A field whose type has no reading stays as bytes; placeholders and fields without a place or a width go. One shuffle, by object.
    """
    held = fields.where(F.col("NAME").isNotNull() & F.col("SB_OFFSET").isNotNull() & (F.col("WIDTH") > 0) & ~F.startswith("NAME", F.lit(PLACEHOLDER)))
    named = unique_names(held.withColumn("_first", F.col("SB_OFFSET")), object_, ["SB_OFFSET", "at"], start="_first")
    code = field_kind(F.col("DATA_TYPE"), F.col("WIDTH"), F.coalesce(F.col(is_ascii), F.lit(False)))
    kind = F.coalesce(code, F.struct(F.lit("void").alias("kind"), F.lit("big").alias("order"), F.lit(False).alias("is_signed")))
    one = F.struct((F.col("SB_OFFSET") + 1).alias("start"), F.col("unique").alias("name"), kind.alias("k"), F.col("WIDTH").alias("width"), F.nullif(F.col("SCALING_FACTOR"), F.lit(0.0)).alias("scale"), F.nullif(F.col("OFFSET"), F.lit(0.0)).alias("offset"))
    ordered = named.groupBy(*object_).agg(F.array_sort(F.collect_list(one)).alias("f"))
    fields_ = F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["k"]["kind"].alias("kind"), x["k"]["order"].alias("order"), x["start"].alias("start"), x["width"].alias("width"), x["k"]["is_signed"].alias("is_signed"), x["scale"].alias("scale"), x["offset"].alias("offset")))
    return ordered.select(*object_, fields_.cast(FORMAT).alias("fields")).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))


def type_of_field(field: dict) -> str:
    """The Spark type of a field; scaled numbers are doubles."""
    own = spark_type(field["kind"], field["width"], field["is_signed"])
    scaled = field["scale"] is not None or field["offset"] is not None
    return "double" if scaled and own not in ("string", "binary", "boolean") else own


_WIDER = ["tinyint", "smallint", "int", "bigint", "decimal(20,0)"]


def common_type(types: set[str]) -> str:
    """One type for a column that formats give differently: the widest integer, double for reals beside anything numeric, else text."""
    if len(types) == 1:
        return next(iter(types))
    if types <= set(_WIDER):
        return max(types, key=_WIDER.index)
    return "double" if types <= {*_WIDER, "float", "double"} else "string"


def merged_schema(formats: DataFrame, most_columns: int = MOST_COLUMNS) -> dict[str, str]:
    """Name to type of the columns of all formats, by name. Distinct names and types are looked at by the driver, and their number is checked."""
    each = formats.dropDuplicates(["fingerprint"]).select(F.explode("fields").alias("f")).select("f.name", "f.kind", "f.width", "f.is_signed", F.when(F.coalesce("f.scale", "f.offset").isNotNull(), 1.0).alias("scale"), F.lit(None).cast("double").alias("offset"))
    held = each.distinct().limit(most_columns + 1).collect()
    if len(held) > most_columns:
        raise ValueError(f"the formats have more than {most_columns} columns together")
    types: dict[str, set[str]] = {}
    for r in held:
        types.setdefault(r.name, set()).add(type_of_field(r.asDict()))
    return {name: common_type(types[name]) for name in sorted(types)}


def decoded_by_format(ranges: DataFrame, keys: list[str], columns: dict[str, str], file: str = "file") -> DataFrame:
    """(keys, row, columns): the records of byte ranges, each decoded by the format that its row carries, in one pass over all formats.

    ``ranges``: keys, file, at, size, first_row, record_bytes, skip_bytes (bytes before the fields of a record) and fields. ``columns``: as
    ``merged_schema`` gives them; a column that a format lacks is null. A record that is cut off at the file's end has nulls in the fields that it does
    not hold. Missing files give no rows.
    """
    asked = ranges.select(*dict.fromkeys([*keys, file, "at", "size", "first_row", "record_bytes", "skip_bytes", "fields"]))
    schema = StructType([*asked.select(*keys).schema.fields, *StructType.fromDDL(", ".join(["row bigint", *[f"`{c}` {t}" for c, t in columns.items()]])).fields])
    return asked.mapInArrow(vectorized.range_decoder(keys, columns, file), schema)
