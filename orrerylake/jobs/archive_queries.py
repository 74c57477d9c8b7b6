"""Queries that write an archive of products from a table and read it from labels to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.operators import rules, xml_labels
from orrerylake.sources import files, fits, made, ranges

from . import archive
from .register import query, spread, table
from .scratch import kept, new_folder

#: So small that each table of the test archive is read by several ranges.
_RANGE = 2000


#: Orders that one task makes products of.
_TASK_ORDERS = 20_000


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, those of a product in one task."""
    return spread(table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / made.ORDERS_EACH), _TASK_ORDERS)


def _archive(spark: SparkSession, sf_dir: str) -> tuple[archive.Archive, str]:
    """An archive of all orders, a file a product with its label at the head, and its folder."""
    path = new_folder(spark, "archive")
    made.written(made.order_products(_orders(spark, sf_dir)), path, "product", "content")
    return archive.opened(spark, path, "*.txt"), path


@query(
    sql=f"""
    SELECT CAST(o_orderkey // {made.ORDERS_EACH} AS VARCHAR) AS product, CAST(row_number() OVER (PARTITION BY o_orderkey // {made.ORDERS_EACH} ORDER BY o_orderkey) - 1 AS BIGINT) AS row, o_orderkey AS orderkey, CAST(o_custkey AS DOUBLE) AS custkey,
    o_totalprice AS price, CASE WHEN o_orderkey // {made.ORDERS_EACH} % 3 = 2 THEN year(o_orderdate) + 1 END AS next_year FROM orders
    """
)
def s12_tables_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, tables and images in one file each, three formats in the archive: from labels to rows in one call, split over ranges."""
    of, _ = _archive(spark, sf_dir)
    rows = archive.table_rows(of.objects, of.formats, range_bytes=_RANGE)
    product = F.regexp_extract("product", "product=([0-9]+)/", 1)
    return rows.select(product.alias("product"), "row", F.col("ORDERKEY").cast("bigint").alias("orderkey"), F.col("CUSTKEY").alias("custkey"), F.col("PRICE").alias("price"), F.col("YEARS_1").cast("bigint").alias("next_year"))


@query(
    sql=f"""
    SELECT CAST(o_orderkey // {made.ORDERS_EACH} AS VARCHAR) AS product, band, CAST(row_number() OVER (PARTITION BY o_orderkey // {made.ORDERS_EACH}, band ORDER BY o_orderkey) - 1 AS INTEGER) AS line,
    CAST(-o_custkey AS DOUBLE) AS first, CAST(o_orderkey + band AS DOUBLE) AS second FROM orders, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS band)
    """
)
def s15_images_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images behind the tables of the same files, in two storage orders."""
    of, _ = _archive(spark, sf_dir)
    lines = archive.image_lines(of.objects, range_bytes=_RANGE)
    return lines.select(F.regexp_extract("product", "product=([0-9]+)/", 1).alias("product"), "band", "line", F.col("samples")[0].alias("first"), F.col("samples")[1].alias("second"))


@query(sql=f"SELECT n % 3 AS format, count(*) AS rows, sum(price) AS prices FROM (SELECT o_orderkey // {made.ORDERS_EACH} AS n, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders) GROUP BY ALL")
def k4_mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of three formats to one store by one call; the store is read back by fingerprint."""
    of, path = _archive(spark, sf_dir)
    archive.ingest_archive(of, f"{path}-store", _RANGE)
    back = spark.read.parquet(f"{path}-store/tables")
    product = F.regexp_extract("product", "product=([0-9]+)/", 1).cast("bigint")
    return back.groupBy("fingerprint").agg(F.max(product % 3).alias("format"), F.count("*").alias("rows"), F.sum(F.col("PRICE").cast("decimal(18,2)")).alias("prices")).drop("fingerprint")


@query(
    sql=f"""
    WITH p AS (SELECT o_orderkey // {made.ORDERS_EACH} AS n, count(*) AS k FROM orders GROUP BY ALL)
    SELECT CAST(n AS VARCHAR) AS product, name, CAST(CASE name WHEN 'TABLE' THEN {made.HEAD_BYTES} ELSE {made.HEAD_BYTES} + k * w END AS BIGINT) AS start, CAST(CASE name WHEN 'TABLE' THEN k * w ELSE k * 20 END AS BIGINT) AS length
    FROM (SELECT *, CASE n % 3 WHEN 0 THEN {made.FORMATS[0][0]} WHEN 1 THEN {made.FORMATS[1][0]} ELSE {made.FORMATS[2][0]} END AS w FROM p), (SELECT unnest(['TABLE', 'IMAGE']) AS name)
    """
)
def m15_object_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each label's objects lie in its file."""
    of, _ = _archive(spark, sf_dir)
    return of.objects.select(F.regexp_extract("product", "product=([0-9]+)/", 1).alias("product"), "name", "start", "length")


@query(sql=f"SELECT CAST(o_orderkey // {made.ORDERS_EACH} AS VARCHAR) AS product, count(*) AS lines, CAST(sum(octet_length(encode(o_orderpriority)) + length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes, min(o_orderkey) AS first FROM orders GROUP BY ALL")
def s16_lines_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length, cut from ranges that split them anywhere, and numbered in their file."""
    path = new_folder(spark, "lines")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority")
    body = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / made.ORDERS_EACH).alias("product")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\r\n").alias("content"))
    made.written(body, path, "product", "content")
    found = files.scan(spark, path, "*.txt").select(F.col("path").alias("file"), F.lit(0).cast("long").alias("object_start"), F.col("length").alias("object_end"))
    cut = ranges.line_numbers(ranges.lines(ranges.dealt(ranges.planned(found, F.lit(0), F.col("object_end"), range_bytes=_RANGE))), ["file"])
    text = F.col("line").cast("string")
    return cut.groupBy(F.regexp_extract("file", "product=([0-9]+)/", 1).alias("product")).agg((F.max("row") + 1).alias("lines"), F.sum(F.octet_length("line")).alias("bytes"), F.min_by(F.substring_index(text, " ", 1), "row").cast("bigint").alias("first"))


@query(
    sql=f"""
    WITH o AS (SELECT *, o_orderkey // {made.ORDERS_EACH} AS n, ({made.LAYOUTS!r})[o_orderkey // {made.ORDERS_EACH} % {len(made.LAYOUTS)} + 1] AS layout FROM orders)
    SELECT layout, o_orderkey AS orderkey, o_custkey AS custkey, CASE WHEN layout <> 'null spellings' OR o_custkey % 3 <> 0 THEN o_totalprice END AS price FROM o
    """
)
def m18_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tables of a dozen layouts under like labels: rules name the reader of each, and the readers bring back the same rows."""
    path = new_folder(spark, "layouts")
    made.written(made.layout_products(_orders(spark, sf_dir)), path, "product", "content")
    held = [(1, "reader", "data_set_id", "equals", name, None, None, "READER", name) for name in made.LAYOUTS] + [(2, "reader", "data_set_id", "equals", "sections", None, None, "SKIP_LINES", "3")]
    of = archive.opened(spark, path, "*.txt", spark.createDataFrame(held, rules.RULES))
    rows = archive.text_rows(of.objects, of.formats, range_bytes=_RANGE)
    layout = F.get(F.array(*map(F.lit, made.LAYOUTS)), (F.regexp_extract("product", "product=([0-9]+)/", 1).cast("int") % len(made.LAYOUTS)))
    return rows.select(layout.alias("layout"), F.col("ORDERKEY").alias("orderkey"), F.col("CUSTKEY").alias("custkey"), F.col("PRICE").alias("price"))


def _product() -> Column:
    return F.regexp_extract("file", "product=([0-9]+)/", 1).alias("product")


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(units, cards) of files made of all orders."""
    path = new_folder(spark, "units")
    made.written(made.unit_products(_orders(spark, sf_dir)), path, "product", "content")
    found = kept(fits.units(files.scan(spark, path, "*.txt"), "path"), "units")
    return found, kept(fits.headers(found), "cards")




@query(
    sql=f"""
    WITH p AS (SELECT CAST(o_orderkey // {made.ORDERS_EACH} AS VARCHAR) AS product, count(*) AS n FROM orders GROUP BY ALL)
    SELECT product, unit, name, (2880 * unit + CASE WHEN unit > 0 THEN (n * 12 + 2879) // 2880 * 2880 ELSE 0 END + CASE WHEN unit > 1 THEN (n * 25 + 2879) // 2880 * 2880 ELSE 0 END)::BIGINT AS header_at, (n * width)::BIGINT AS data_bytes, object
    FROM p, (SELECT unnest([0, 1, 2])::INTEGER AS unit, unnest(['PRIMARY', 'ORDERS_0', 'ORDERS_1']) AS name, unnest([12, 25, 44]) AS width, unnest(['image''s /', NULL, NULL]) AS object)
    """
)
def s17_s18_header_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each unit of each file begins, as the headers before it tell, with its numbered name and a quoted card."""
    found, cards = _units(spark, sf_dir)
    names = cards.groupBy("file", "unit", "name").agg(F.max(F.when(F.col("key") == "OBJECT", F.col("value"))).alias("object"))
    return found.join(names, ["file", "unit"]).select(_product(), "unit", "name", "header_at", "data_bytes", "object")


@query(
    sql=f"""
    SELECT CAST(o_orderkey // {made.ORDERS_EACH} AS VARCHAR) AS product, name, (row_number() OVER (PARTITION BY o_orderkey // {made.ORDERS_EACH}, name ORDER BY o_orderkey) - 1)::BIGINT AS row, o_orderkey AS orderkey, o_totalprice AS price,
    CASE name WHEN 'ORDERS_0' THEN o_custkey * 2.0::DOUBLE END AS cust, CASE name WHEN 'ORDERS_0' THEN -o_custkey * 2.0::DOUBLE END AS minus_cust, CASE name WHEN 'ORDERS_0' THEN o_orderstatus = 'F' END AS done, CASE name WHEN 'ORDERS_1' THEN o_orderpriority END AS priority
    FROM orders, (SELECT unnest(['ORDERS_0', 'ORDERS_1']) AS name)
    """
)
def s19_unit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary and text tables of the same files, by their own forms, in one pass."""
    found, cards = _units(spark, sf_dir)
    rows = fits.table_rows(found, cards, kept(fits.table_fields(cards), "formats"), range_bytes=_RANGE)
    names = {"ORDERKEY": "orderkey", "PRICE": "price", "CUST_0": "cust", "CUST_1": "minus_cust", "DONE": "done", "PRIORITY": "priority"}
    return rows.select(_product(), "name", "row", *[F.col(c).alias(n) for c, n in names.items()])


@query(
    sql=f"""
    SELECT CAST(o_orderkey // {made.ORDERS_EACH} AS VARCHAR) AS product, 0 AS band, (row_number() OVER (PARTITION BY o_orderkey // {made.ORDERS_EACH} ORDER BY o_orderkey) - 1)::INTEGER AS line, o_custkey * 0.5::DOUBLE + 1 AS first, o_orderkey * 0.5::DOUBLE + 1 AS second, NULL::DOUBLE AS third FROM orders
    """
)
def s19_unit_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the same files, scaled, undefined pixels null."""
    found, cards = _units(spark, sf_dir)
    lines = fits.image_lines(found, cards, _RANGE)
    return lines.select(_product(), "band", "line", *[F.col("samples")[i].alias(n) for i, n in enumerate(("first", "second", "third"))])


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a label for each customer: two file areas, structures with and without names, and fields in a group."""
    c = F.col
    field = lambda name: made.text("<Field><name>", name, "</name><n>", c("c_nationkey"), "</n></Field>")
    label = made.text(
        '<?xml version="1.0"?>\n<!-- customer --><p:Product_Observational xmlns:p="http://x/y" xmlns="z"><Identification_Area><title>', c("c_name"), " &amp; co</title><balance unit='USD'>", F.format_string("%.2f", "c_acctbal"), "</balance></Identification_Area>",
        "<File_Area_Browse><File><file_name>b", c("c_custkey"), ".img</file_name></File><Array_2D><offset>", c("c_nationkey"), "</offset></Array_2D></File_Area_Browse>",
        "<File_Area_Observational><File><file_name>a", c("c_custkey"), ".dat</file_name></File><Header><name>", c("c_name"), "</name></Header><Array_3D/><Table_Binary><Record_Binary>", field(F.lit("one")), "<Group>", field(F.lit("two")), "</Group></Record_Binary></Table_Binary></File_Area_Observational>",
        "</p:Product_Observational>",
    )
    return kept(xml_labels.elements(spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", label.alias("label")), "c_custkey", "label"), "elements")


@query(
    sql="""
    SELECT c_custkey, '1.1.1' AS place, 'title' AS key, c_name || ' & co' AS value, NULL AS unit FROM customer UNION ALL SELECT c_custkey, '1.1.2', 'balance', printf('%.2f', c_acctbal), 'USD' FROM customer
    UNION ALL SELECT c_custkey, '1.3.4.1.1.1', 'name', 'one', NULL FROM customer UNION ALL SELECT c_custkey, '1.3.4.1.1.2', 'n', '' || c_nationkey, NULL FROM customer
    UNION ALL SELECT c_custkey, '1.3.4.1.2.1.1', 'name', 'two', NULL FROM customer UNION ALL SELECT c_custkey, '1.3.4.1.2.1.2', 'n', '' || c_nationkey, NULL FROM customer
    """
)
def m19_key_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements found by paths, from the root and below anchors, with their places."""
    found = _xml(spark, sf_dir)
    tables = xml_labels.findall(found, "c_custkey", "File_Area_Observational/Table_Binary")
    both = xml_labels.findall(found, "c_custkey", "Identification_Area/*").unionByName(xml_labels.findall(found, "c_custkey", ".//Field/*", tables).drop("anchor"))
    return both.select("c_custkey", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "key", "value", F.col("attributes")["unit"].alias("unit"))


@query(
    sql="""
    SELECT c_custkey, 'b' || c_custkey || '.img' AS file_name, 'array' AS kind, 'ARRAY_1' AS id, CAST(c_nationkey AS BIGINT) AS "offset" FROM customer UNION ALL SELECT c_custkey, 'a' || c_custkey || '.dat', 'header', c_name, 0 FROM customer
    UNION ALL SELECT c_custkey, 'a' || c_custkey || '.dat', 'array', 'ARRAY_0', 0 FROM customer UNION ALL SELECT c_custkey, 'a' || c_custkey || '.dat', 'table', 'TABLE_0', 0 FROM customer
    """
)
def m20_structures_in_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures found in the labels themselves."""
    return xml_labels.structures(_xml(spark, sf_dir), "c_custkey").select("c_custkey", "file_name", "kind", "id", "offset")
