"""Queries over records: tables are encoded in the query and read back, so the oracle is the plain column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrerylake.functions import binary, text, values
from orrerylake.operators import calibrate, formats, readers, rules, special_cases
from orrerylake.sources import made, records

from .register import query, table

_FIELDS = [
    {"name": n, "kind": k, "order": o, "start": s, "width": w, "is_signed": g}
    for n, k, o, s, w, g in (
        ("orderkey", "integer", "big", 1, 4, False), ("minus_key", "integer", "little", 5, 8, True), ("minus_line", "integer", "little", 13, 2, True), ("price", "ieee", "little", 15, 8, False), ("minus_quantity", "ieee", "big", 23, 4, False),
        ("vax_quantity", "vax", "little", 27, 4, False), ("ibm_quantity", "ibm", "big", 31, 4, False), ("quantity", "integer", "big", 35, 1, False), ("flag_bits", "bits", "big", 36, 1, False), ("returnflag", "ebcdic", "big", 37, 1, False),
    )
]


@query(
    sql="""
    SELECT l_orderkey AS orderkey, -l_orderkey AS minus_key, CAST(-l_linenumber AS SMALLINT) AS minus_line, l_extendedprice AS price, CAST(-l_quantity AS FLOAT) AS minus_quantity, CAST(l_quantity AS FLOAT) AS vax_quantity,
    l_quantity AS ibm_quantity, CAST(l_quantity AS SMALLINT) AS quantity, CASE WHEN l_linestatus = 'O' THEN '00000001' ELSE '00000000' END AS flag_bits, l_returnflag AS returnflag FROM lineitem
    """
)
def s12_binary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.decode_batches(made.binary_records(table(spark, sf_dir, "lineitem")), _FIELDS)


@query(sql="SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, true AS fits FROM lineitem")
def s9_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = made.delimited_lines(table(spark, sf_dir, "lineitem"), records.delimiter("VERTICAL_BAR"))
    found = records.delimited(lines, "line", "|", ["k", "n", "q", "f"])
    return found.select(text.ascii_integer(F.col("k")).cast("bigint").alias("l_orderkey"), F.col("n").cast("int").alias("l_linenumber"), text.ascii_real(F.col("q")).alias("l_quantity"), F.col("f").alias("l_returnflag"), "fits")


@query(sql="SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, date_trunc('day', l_shipdate) AS shipdate FROM lineitem")
def s10_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = made.fixed_lines(table(spark, sf_dir, "lineitem")).select("line")
    cut = lambda a, n: records.fixed_width(F.col("line"), a, n)
    return lines.select(cut(1, 12).try_cast("bigint").alias("l_orderkey"), cut(13, 4).try_cast("int").alias("l_linenumber"), cut(17, 10).try_cast("double").alias("l_quantity"), cut(27, 6).alias("l_returnflag"), text.archive_date(cut(33, 12)).alias("shipdate"))


@query(sql="SELECT o_orderkey, o_custkey FROM orders")
def s10_records_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each customer's orders joined into one content per customer, then cut by length."""
    one = F.concat(binary.integer_bytes(F.col("o_orderkey"), 8, "big"), binary.integer_bytes(F.col("o_custkey"), 4, "little"))
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.hex(one)), "").alias("digits"))
    each = files.select(F.explode(records.fixed_records(F.unhex("digits"), 12)).alias("r"))
    return each.select(binary.signed(F.col("r"), 1, 8, "big").alias("o_orderkey"), binary.signed(F.col("r"), 9, 4, "little").alias("o_custkey"))


@query(sql="SELECT s_suppkey, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def s11_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = made.text("  ", F.col("s_suppkey"), " \t ", F.col("s_name"), "   ", F.col("s_nationkey"), " ", F.format_string("%.2f", "s_acctbal"), " \r")
    parts = records.split_fields(line)
    return table(spark, sf_dir, "supplier").select(parts[0].cast("bigint").alias("s_suppkey"), parts[1].alias("name"), parts[2].cast("int").alias("s_nationkey"), parts[3].cast("double").alias("s_acctbal"))


@query(sql="SELECT vec_id, i // 8 AS line, i % 8 AS sample, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)")
def s13_ascii_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.array_join(F.transform("embedding", lambda v: F.format_string("%.17e", v.cast("double"))), " ; ")
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(records.numbers_in(body)).alias("i", "v"))
    line, sample = records.axes(F.col("i"), [8, 8])
    return cells.select("vec_id", line.cast("bigint").alias("line"), sample.cast("bigint").alias("sample"), F.col("v").alias("value"))


@query(
    sql="SELECT event_type, k AS bin, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND CAST(floor(e.value / 50) AS BIGINT) = k) AS n FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(range(0, (SELECT CAST(max(floor(value / 50)) AS BIGINT) + 1 FROM events))) AS k)"
)
def s14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of all values for each type, as many bins as the largest value needs, in one field that repeats."""
    held = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 50).cast("int").alias("k")).agg(F.count("*").alias("n"))
    bins = held.agg(F.max("k") + 1).first()[0] or 1
    counts = held.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.hex(binary.integer_bytes(F.coalesce(F.try_element_at("m", k), F.lit(0).cast("bigint")), 4, "big")))
    content = counts.select("event_type", F.unhex(F.array_join(digits, "")).alias("c"))
    each = content.select("event_type", "c", F.explode(formats.repeats(F.lit(bins))).alias("bin"))
    return each.select("event_type", F.col("bin").cast("bigint").alias("bin"), binary.unsigned(F.col("c"), F.col("bin") * 4 + 1, 4, "big").alias("n"))


@query(sql="SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM documents")
def s16_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.canonical_lines(F.regexp_replace("text", "\n", "\r\n")).alias("body"))


@query(
    sql="""
    SELECT p_partkey, 'NAXIS' AS key, '' || p_size AS value, 'axes of ' || p_brand AS comment FROM part UNION ALL SELECT p_partkey, 'OBJECT', p_name || ' ''x', NULL FROM part UNION ALL SELECT p_partkey, 'BLANK', NULL, 'none' FROM part
    """
)
def s17_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda *p: F.rpad(made.text(*p), 80, " ")
    header = F.concat(
        pad("NAXIS   = ", F.lpad(F.col("p_size").cast("string"), 20, " "), " / axes of ", F.col("p_brand")), pad(" " * 80), pad("OBJECT  = '", F.col("p_name"), " ''x   '"), pad("BLANK   =                      / none"), pad("END")
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(records.cards(header)).alias("c")).select("p_partkey", "c.*")


@query(sql="SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE o_custkey % 50 END AS unit FROM orders")
def s18_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 50
    target = F.when(F.col("o_custkey") % 3 == 0, k * 5760 + 1).when(F.col("o_custkey") % 3 == 1, k * 2 + 1).otherwise(F.lit(18))
    units = spark.range(50).select(F.col("id").alias("unit"), (F.col("id") * 5760).alias("start"))
    return records.unit_at(table(spark, sf_dir, "orders").select("o_orderkey", target.alias("target")), units, "target").select("o_orderkey", "unit")


@query(sql="SELECT o_orderkey, o_orderpriority AS priority, nullif(o_custkey, 1) AS custkey FROM orders")
def s21_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = made.text(F.col("o_orderkey"), ',"', F.col("o_orderpriority"), ',x",', F.when(F.col("o_custkey") == 1, "").otherwise(F.col("o_custkey").cast("string")))
    found = records.delimited(table(spark, sf_dir, "orders").select(line.alias("line")), "line", ",", ["k", "p", "c"])
    return found.select(F.col("k").cast("bigint").alias("o_orderkey"), F.regexp_extract("p", "^(.*),x$", 1).alias("priority"), text.null_spellings(F.col("c")).cast("bigint").alias("custkey"))


@query(sql="SELECT o_orderkey, o_custkey, o_orderpriority || ';' || chr(10) || chr(10) || o_orderstatus || ',x' AS note FROM orders")
def s21_quoted_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited records whose quoted fields hold delimiters and line ends, cut into lines and joined again by the parity of quotes, all orders as one file."""
    c = F.col
    record = made.text(c("o_orderkey"), ',"', c("o_orderpriority"), ';\n\n', c("o_orderstatus"), ',x",', c("o_custkey"))
    lines = table(spark, sf_dir, "orders").select(F.posexplode(F.split(record, "\n")).alias("k", "line"), (c("o_orderkey") * 8).alias("at"))
    held = lines.select(F.lit("all").alias("file"), (F.col("at") + F.col("k")).alias("row"), F.col("line").cast("binary").alias("line"))
    cells = readers.delimited_fields(F.col("line"), F.lit(","))
    found = readers.quoted_records(held, ["file"]).select(cells.alias("x"))
    return found.select(F.col("x")[0].cast("bigint").alias("o_orderkey"), F.col("x")[2].cast("bigint").alias("o_custkey"), F.col("x")[1].alias("note"))


@query(sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 7 ELSE l_linenumber & 5 END AS masked FROM lineitem")
def s22_masked_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binary.integer_bytes(F.col("l_linenumber"), 2, "big")
    masked = calibrate.bit_masked(binary.signed(raw, 1, 2, "big"), values.based_integer(F.lit("2#0101#")), [7])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", masked.alias("masked"))


@query(sql="SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders q WHERE q.o_custkey = orders.o_custkey AND q.o_orderstatus = 'F') AND o_orderstatus <> 'P'")
def s23_irregular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with NULs; those before a file's first marker, and comments, go."""
    line = F.when(F.col("o_orderstatus") == "F", "// start").when(F.col("o_orderstatus") == "P", " # note").otherwise("data\x00")
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", records.without_nuls(line).alias("line"), "o_orderstatus")
    body = records.after_marker(lines, "o_custkey", "o_orderkey", F.col("line").startswith("//")).where(~records.is_comment(F.col("line")) | (F.col("o_orderstatus") == "F"))
    return records.numbered(body, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.col("row").cast("bigint").alias("row"))


_RULES = [
    (1, "block", "p_brand", "equals", "Brand#13", None, None, "ROWS", "100"),
    (2, "block", "p_type", "regex", "^(PROMO|SMALL)$", None, None, "ROWS", "200"),
    (3, "block", "p_name", "contains", "widget", None, None, "BYTES", "12"),
    (4, "block", "p_size", "interval", None, 10.0, 20.0, "BYTES", "13"),
    (5, "other", "p_size", "interval", None, 0.0, 99.0, "ROWS", "1"),
]


@query(
    sql="""
    SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 100 WHEN p_type IN ('PROMO', 'SMALL') THEN 200 ELSE p_size END AS n_rows, CASE WHEN contains(p_name, 'widget') THEN 12 WHEN p_size BETWEEN 10 AND 20 THEN 13 ELSE 4 END AS n_bytes FROM part
    """
)
def m18_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = rules.overrides(table(spark, sf_dir, "part"), spark.createDataFrame(_RULES, rules.RULES), "block", ["p_brand", "p_type", "p_name", "p_size"])
    return held.select("p_partkey", rules.patched(F.col("p_size"), "ROWS", "int").alias("n_rows"), rules.patched(F.lit(4), "BYTES", "int").alias("n_bytes"))


#: Products and what the special cases say of them: a row for each case, by identifiers.
_SPECIAL = [
    (dict(data_set_id="CO-S-MIMI-4-CHEMS-CALIB-V1.0"), "READER", "spreadsheet"), (dict(instrument_host_name="CASSINI ORBITER", product_type="ANCILLARY", data_set_id="CO-S-MIMI-4-X"), "READER", "spreadsheet"),
    (dict(instrument_id="CHEMIN", name="CHMN_SPREADSHEET"), "READER", "spreadsheet"), (dict(data_set_id="MSL-M-SAM-2", product_id="X_QMS_1", name="QMS_TABLE"), "READER", "spreadsheet"),
    (dict(spacecraft_name="MAGELLAN", name="TABLE", note="Geometry of orbits"), "READER", "without nuls"), (dict(spacecraft_name="MAGELLAN", name="TABLE", note="No Geometry"), None, None),
    (dict(data_set_id="MGN-V-RSS-5-OCC-PROF-ABS", name="TABLE"), "READER", "records by bytes"), (dict(instrument_id="DLRE", product_type="PCP", name="TABLE"), "READER", "delimited"), (dict(instrument_id="DLRE", product_type="EDR", name="TABLE"), None, None),
    (dict(data_set_id="MRO-M-MCS-5-DDR-V2.0", name="TABLE"), "READER", "filled headers"), (dict(data_set_id="MRO-M-MCS-5-DDR-V1.0", name="TABLE"), None, None), (dict(data_set_id="IHW-C-PPOL-3-RDR-HALLEY-V1.0", name="TABLE"), "READER", "added breaks"),
    (dict(data_set_id="IHW-C-PPOL-3-RDR-HALLEY-V1.0", name="IMAGE"), None, None), (dict(data_set_id="VG2-U-LECP-4-RDR-STEP-12.8MIN-V1.0", interchange="ASCII", name="TABLE"), "READER", "white space"),
    (dict(data_set_id="VG2-U-LECP-4-RDR-STEP-12.8MIN-V1.0", interchange="BINARY", name="TABLE"), None, None), (dict(data_set_id="MER2-M-RSS-1-EDR-V1.0", product_type="UHFD", name="SPREADSHEET"), "READER", "delimited"),
    (dict(instrument_host_name="MARS EXPRESS", instrument_id="MRS", product_id="L1B_ODF", name="ODF_TABLE"), "READER", "sections"), (dict(instrument_host_name="MARS EXPRESS", instrument_id="MRS", product_id="ODF", name="ODF_TABLE"), None, None),
    (dict(data_set_id="ICE-C-MAG-3-RDR-X", file="TRAJ_ICE.TAB", name="TABLE"), "READER", "added breaks"), (dict(data_set_id="PVO-V-OIMS-4-IONDENSITY-12S-V1.0", name="TABLE"), "ROWS", "FILE_RECORDS"),
    (dict(data_set_id="X-VG2-N-MAG-4-RDR-HGCOORDS", standard_data_product_id="ASCII DATA", name="TABLE"), "ROW_BYTES", "145"), (dict(data_set_id="VG2-SS-PLS-3-RDR-FINE-RES-V1.0", name="TABLE", row_bytes="57"), "ROW_BYTES", "64"),
    (dict(data_set_id="VG2-SS-PLS-3-RDR-FINE-RES-V1.0", name="TABLE", row_bytes="64"), None, None), (dict(name="XDR_DOCUMENT"), "BLOCK", "IMAGE"), (dict(instrument_id="CRAT", product_type="EDR", name="TABLE_1"), "START_BYTE", "64"),
    (dict(data_set_id="CO-E/V/J-ISSNA/ISSWA-2-EDR-V1.0", clock="1360000000.5"), "START_BYTE", "computed"), (dict(data_set_id="CO-E/V/J-ISSNA/ISSWA-2-EDR-V1.0", clock="1363539030"), None, None),
    (dict(data_set_id="SLN-L-SP-2", name="SP_SPECTRUM_RAD"), "KIND", "image"),
]
_OF = "data_set_id instrument_host_name instrument_id instrument_name interchange clock file name note product_id product_type row_bytes spacecraft_name standard_data_product_id".split()


@query(
    sql="SELECT p_partkey, field, value FROM part JOIN (VALUES "
    + ", ".join(f"({i}, {'NULL' if f is None else repr(f)}, {'NULL' if v is None else repr(v)})" for i, (_, f, v) in enumerate(_SPECIAL))
    + f") t(i, field, value) ON p_partkey % {len(_SPECIAL)} = i"
)
def m18_special_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part stands for a product with the identifiers of one case; what the archive's rules change in it."""
    products = F.array(*[F.struct(*[F.lit(p.get(c)).cast("string").alias(c) for c in _OF]) for p, _, _ in _SPECIAL])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(products, (F.col("p_partkey") % len(_SPECIAL)).cast("int")).alias("p")).select("p_partkey", "p.*")
    stages = ["reader", "block", "start byte", "kind"]
    for k, stage in enumerate(stages):
        rows = rules.overrides(rows, special_cases.special_cases(spark), stage, _OF).withColumnRenamed("override", f"_of_{k}")
    every = F.flatten(F.array(*[F.map_entries(f"_of_{k}") for k in range(len(stages))]))
    return rows.select("p_partkey", F.get(every, F.lit(0))["key"].alias("field"), F.get(every, F.lit(0))["value"].alias("value"))


@query(sql="SELECT n_nationkey, n_name AS title, CAST(n_regionkey AS BIGINT) AS region, n_name || '_0,' || n_name || '_1' AS fields FROM nation")
def m19_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = made.text('<p:Product xmlns:p="http://x/y" xmlns="z"><p:title>', F.col("n_name"), "</p:title><Area><region>", F.col("n_regionkey"), "</region><Field><name>", F.col("n_name"), "_0</name></Field><Field><name>", F.col("n_name"), "_1</name></Field></Area></p:Product>")
    x = rules.xml_fields(F.col("label"), "title string, Area struct<region: bigint, Field: array<struct<name: string>>>")
    read = table(spark, sf_dir, "nation").select("n_nationkey", label.alias("label")).select("n_nationkey", x.alias("x"))
    return read.select("n_nationkey", F.col("x.title").alias("title"), F.col("x.Area.region").alias("region"), F.array_join("x.Area.Field.name", ",").alias("fields"))


@query(
    sql="""
    SELECT c_custkey, 'a.dat' AS file_name, 'Header' AS kind, c_name AS id FROM customer UNION ALL SELECT c_custkey, 'a.dat', 'Array', 'ARRAY_0' FROM customer UNION ALL SELECT c_custkey, 'b.dat', 'Array', 'ARRAY_1' FROM customer
    """
)
def m20_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda kind, name=None: F.struct(F.lit(kind).alias("kind"), (F.col(name) if name else F.lit(None).cast("string")).alias("id"))
    area = lambda file, *e: F.struct(F.lit(file).alias("file_name"), F.array(*e).alias("entries"))
    files = table(spark, sf_dir, "customer").select("c_custkey", F.array(area("a.dat", entry("Header", "c_name"), entry("Array")), area("b.dat", entry("Array"))).alias("areas"))
    return rules.structures(files, "c_custkey", "areas").select("c_custkey", "file_name", "kind", "id")


_OF_FOUR = """
    SELECT l_orderkey, l_linenumber, o_totalprice AS header_price FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4)
    """


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, at, price, l_orderkey, l_linenumber): orders as header rows, each before its lines; places in the stream have gaps."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    head = orders.select("o_custkey", (F.col("o_orderkey") * 1000).alias("at"), F.col("o_totalprice").alias("price"), F.lit(None).cast("bigint").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"))
    body = items.withColumn("_x", place).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return head.unionByName(body.select("o_custkey", (F.col("l_orderkey") * 1000 + F.col("_x")).alias("at"), F.lit(None).cast("double").alias("price"), "l_orderkey", "l_linenumber"))


@query(sql=_OF_FOUR)
def m21_filled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream per customer with an order as header row before its lines; only blocks of four lines stay."""
    filled = rules.filled_headers(_stream(spark, sf_dir), "o_custkey", "at", F.col("l_orderkey").isNull(), ["price"], 4)
    return filled.select("l_orderkey", "l_linenumber", "header_price")


@query(sql=_OF_FOUR)
def m21_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of one stream with all orders: no task holds it."""
    filled = rules.filled_headers(_stream(spark, sf_dir).withColumn("file", F.lit("all")), "file", "at", F.col("l_orderkey").isNull(), ["price"], 4)
    return filled.select("l_orderkey", "l_linenumber", "header_price")
