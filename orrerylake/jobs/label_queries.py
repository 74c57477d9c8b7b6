"""Queries over labels and files: each makes labels or paths from a table and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.functions import values
from orrerylake.operators import metadata as M
from orrerylake.operators import statements as S
from orrerylake.sources import files, made

from .register import query, spread, table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.part_labels(spread(table(spark, sf_dir, "part"), "p_partkey"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.metadata(_labels(spark, sf_dir), "p_partkey", "label")


#: Statements of the made label: seq, key, value (SQL), block lines included.
_STATEMENTS = [
    ("PDS_VERSION_ID", "'PDS3'"), ("PRODUCT_ID", """'"P' || p_partkey || '"'"""), ("^TABLE", """'("PART_' || p_partkey || '.TAB", ' || p_size || ' <BYTES>)'"""),
    ("^IMAGE", "'' || p_size"), ("^IMAGE", "'' || (p_size + 1)"), ("SPACECRAFT_NAME", "'''' || p_brand || ''''"), ("PRICE", "p_size || ' <USD>'"),
    ("CODES", """'(1, ' || p_size || ', "' || p_type || '")'"""), ("MASK", "'16#' || upper(to_hex(p_partkey)) || '#'"), ("PADDED", "'00' || (p_size + 1)"),
    ("DESCRIPTION", """'"firstpart of ' || p_name || '"'"""), ("END_TIME", "'' || p_size"), ("OBJECT", "'TABLE'"), ("ROWS", "'' || p_size"), ("PRODUCT_ID", "'INNER'"),
    ("OBJECT", "'COLUMN'"), ("NAME", "p_type"), ("BYTES", "'4'"), ("END_OBJECT", "''"), ("NOTE", "'1.5'"), ("END_OBJECT", "''"),
    ("OBJECT", "'TABLE'"), ("ROWS", "'-1'"), ("END_OBJECT", "''"), ("GROUP", "'OPEN'"), ("LEFT", "p_brand"), ("END", "''"),
]
#: The label's GROUP is closed by END; depth and path of each statement.
_DEPTH = [0] * 13 + [1, 1, 1, 2, 2, 2, 1, 1, 0, 1, 1, 0, 1, 1]
_PATH = {13: "TABLE", 14: "TABLE", 15: "TABLE", 16: "TABLE/COLUMN", 17: "TABLE/COLUMN", 18: "TABLE/COLUMN", 19: "TABLE", 20: "TABLE", 22: "TABLE", 23: "TABLE", 25: "OPEN", 26: "OPEN"}


def _rows(only=lambda key: True) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, {i} AS seq, '{k}' AS key, {v} AS value FROM part" for i, (k, v) in enumerate(_STATEMENTS) if only(k))


@query(sql=_rows())
def m1_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statement_rows(_labels(spark, sf_dir), "p_partkey", "label")


_PLAIN = [i for i, (k, _) in enumerate(_STATEMENTS) if k not in ("OBJECT", "GROUP") and not k.startswith("END")]
_NESTED = " UNION ALL ".join(f"SELECT p_partkey, {i} AS seq, {1 if i in (25,) else len([x for x in _PATH.get(i, '').split('/') if x])} AS depth, '{_PATH.get(i, '')}' AS path, '{_STATEMENTS[i][0]}' AS key, true AS attached FROM part" for i in _PLAIN)


@query(sql=_NESTED)
def m2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.nested(S.statement_rows(_labels(spark, sf_dir), "p_partkey", "label"), "p_partkey")
    return rows.where("not opens and not closes").select("p_partkey", "seq", "depth", F.array_join("path", "/").alias("path"), "key", "attached")


@query(
    sql="""
    SELECT p_partkey, 'PRICE' AS key, 'quantity' AS type, CAST(p_size AS BIGINT) AS value_long, CAST(p_size AS DOUBLE) AS value_double, NULL AS value_string, 'USD' AS units, NULL AS items FROM part
    UNION ALL SELECT p_partkey, 'CODES', 'collection', NULL, NULL, NULL, NULL, '1|' || p_size || '|' || p_type FROM part
    UNION ALL SELECT p_partkey, 'MASK', 'based', p_partkey, NULL, NULL, NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'PADDED', 'text', NULL, NULL, '00' || (p_size + 1), NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'NOTE', 'real', NULL, 1.5, NULL, NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'DESCRIPTION', 'quoted', NULL, NULL, 'firstpart of ' || p_name, NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'SPACECRAFT_NAME', 'quoted', NULL, NULL, p_brand, NULL, NULL FROM part
    """
)
def m3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _meta(spark, sf_dir).where(F.col("key").isin("PRICE", "CODES", "MASK", "PADDED", "NOTE", "DESCRIPTION", "SPACECRAFT_NAME"))
    return some.select("p_partkey", "key", "type", "value_long", "value_double", "value_string", "units", F.array_join("items", "|").alias("items"))


@query(sql=f"SELECT p_partkey, key, count(*) AS n FROM ({_rows(lambda k: k not in ('OBJECT', 'GROUP') and not k.startswith('END'))}) GROUP BY ALL")
def m3_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).groupBy("p_partkey", "key").agg(F.count("*").alias("n"))


@query(sql="SELECT p_partkey, 'PART_' || p_partkey || '.TAB' AS file, '' || p_size AS value, 'BYTES' AS units FROM part")
def m4_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = values.parts_of_quantities(F.col("value_raw"))
    return _meta(spark, sf_dir).where("key = '^TABLE'").select("p_partkey", parts[0]["value"].alias("file"), parts[1]["value"].alias("value"), parts[1]["units"].alias("units"))


@query(sql="SELECT o_orderkey, o_orderkey AS as_hex, o_orderkey AS as_octal, o_orderkey AS as_binary FROM orders")
def m5_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[values.based_integer(made.text(f"{b}#", F.conv(o, 10, b), "#")).alias(n) for b, n in ((16, "as_hex"), (8, "as_octal"), (2, "as_binary"))])


@query(sql=f"SELECT p_partkey, key, count(*) AS n, count(*) > 1 AS repeated FROM ({_rows(lambda k: k not in ('OBJECT', 'GROUP') and not k.startswith('END'))}) GROUP BY ALL")
def m6_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.key_counts(_meta(spark, sf_dir), "p_partkey")


@query(sql="SELECT p_partkey, '\"P' || p_partkey || '\"' AS id, p_type AS name, 'none' AS missing FROM part")
def m7_metaget(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, part = _meta(spark, sf_dir), table(spark, sf_dir, "part")
    got = [M.metaget(meta, part, "p_partkey", k, d).withColumnRenamed("value", n) for k, d, n in (("PRODUCT_ID", None, "id"), ("NAME", None, "name"), ("ABSENT", "none", "missing"))]
    return got[0].join(got[1], "p_partkey").join(got[2], "p_partkey")


@query(
    sql="""
    SELECT p_partkey, key, value FROM (
      SELECT p_partkey, 'ROWS' AS key, '' || p_size AS value FROM part UNION ALL SELECT p_partkey, 'PRODUCT_ID', 'INNER' FROM part UNION ALL SELECT p_partkey, 'NAME', p_type FROM part
      UNION ALL SELECT p_partkey, 'BYTES', '4' FROM part UNION ALL SELECT p_partkey, 'NOTE', '1.5' FROM part)
    """
)
def m8_metablock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metablock(_meta(spark, sf_dir), "p_partkey", "TABLE").select("p_partkey", "key", F.col("value_raw").alias("value"))


_TERMS = ["SPACECRAFT", "PRODUKT_ID", "DESCRIBTION", "PRIZE", "BYTE", "PADED"]


_KEYS = sorted({k for k, _ in _STATEMENTS if k not in ("OBJECT", "GROUP") and not k.startswith("END")})
#: The table of common subsequences, a cell at a time.
_FUZZY = f"""
    WITH RECURSIVE pairs AS (SELECT term, key FROM (SELECT unnest([{", ".join(f"'{t}'" for t in _TERMS)}]) AS term), (SELECT unnest([{", ".join(f"'{k}'" for k in _KEYS)}]) AS key) WHERE EXISTS (FROM part)),
    cells AS (
      SELECT term, key, 1 AS i, 1 AS j, list_resize([0], length(key) + 1, 0) AS above, [0] AS beside FROM pairs
      UNION ALL
      SELECT term, key, CASE WHEN j = length(key) THEN i + 1 ELSE i END, CASE WHEN j = length(key) THEN 1 ELSE j + 1 END,
      CASE WHEN j = length(key) THEN list_append(beside, v) ELSE above END, CASE WHEN j = length(key) THEN [0] ELSE list_append(beside, v) END
      FROM (SELECT *, CAST(CASE WHEN term[i] = key[j] THEN above[j] + 1 ELSE greatest(above[j + 1], beside[j]) END AS INTEGER) AS v FROM cells WHERE i <= length(term))
    ),
    scored AS (SELECT term, key, 2.0::DOUBLE * above[length(key) + 1] / (length(term) + length(key)) AS ratio FROM cells WHERE i = length(term) + 1)
    SELECT term, key, ratio FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ratio DESC, key) AS n FROM scored) WHERE n = 1
"""


@query(sql=_FUZZY)
def m9_fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fuzzy_keys(_meta(spark, sf_dir), spark.createDataFrame([(t,) for t in _TERMS], "term string"))


_IDENTIFIED = {"PRODUCT_ID": "'P' || p_partkey", "SPACECRAFT_NAME": "p_brand", "ROWS": "'' || p_size", "NOTE": "'1.5'"}
#: All keys of the identifiers, as the list in the library must have them.
_ALL_KEYS = (
    "DATA_SET_ID DATA_SET_NAME DATA_QUALITY_DESC FILE_NAME FILE_RECORDS INSTRUMENT_ID INSTRUMENT_HOST_NAME INSTRUMENT_NAME LABEL_RECORDS NOTE PRODUCT_ID "
    "PRODUCT_TYPE RECORD_BYTES RECORD_TYPE ROW_BYTES ROWS SPACECRAFT_NAME STANDARD_DATA_PRODUCT_ID"
).split()


@query(sql=f"SELECT p_partkey, {', '.join(_IDENTIFIED.get(k, repr('')) + ' AS ' + k.lower() for k in _ALL_KEYS)} FROM part")
def m10_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.identifiers(_meta(spark, sf_dir), "p_partkey")


@query(
    sql="""
    SELECT p_partkey, 'TABLE' AS name, 'TABLE' AS indexed, 'table' AS kind FROM part UNION ALL SELECT p_partkey, 'IMAGE', 'IMAGE_0', 'image' FROM part UNION ALL SELECT p_partkey, 'IMAGE', 'IMAGE_1', 'image' FROM part
    """
)
def m11_m12_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.numbered_pointers(_meta(spark, sf_dir), "p_partkey")
    return found.select("p_partkey", "name", "indexed", M.object_kind(F.col("name"), F.lit("x.img")).alias("kind"))


#: Names and files of objects, how they are read, and whether reading everything skips them.
_OBJECTS = [
    ("TABLE_STRUCTURE", "x.tab", "trivial", False), ("TIFF_HEADER", "x.dat", "trivial", False), ("PDS_OBJECT", "x.dat", "trivial", False), ("TIFF_IMAGE", "x.dat", "image", False), ("TIFF_DOCUMENT", "x.dat", "unknown", False),
    ("LABEL", "x.lbl", "label", False), ("IMAGE", "a.b/x.FIT.gz", "fits", False), ("IMAGE_HEADER", "x.fz", "fits", False), ("IMAGE", "x.jp2", "desktop image", False), ("TABLE", "x.tif", "desktop image", False),
    ("TEXT", "x.txt", "text", False), ("PDF_DOCUMENT", "x.pdf", "text", False), ("MAP_PROJECTION_CATALOG", "x.cat", "text", False), ("DATA_SET_MAP_PROJECTION", "x.cat", "unknown", True), ("FILENAME", "x.img", "text", False),
    ("INSTRUMENT_DESC", "x.cat", "text", True), ("DESCRIPTION_2", "x.cat", "text", True), ("DESCRIPTIVE_FILE", "x.tab", "text", False), ("ARRAY_TABLE", "x.dat", "array", False), ("TIME_SERIES", "x.dat", "table", False),
    ("SPECTRUM", "x.dat", "table", False), ("SPREADSHEET", "x.dat", "table", False), ("CONTAINER", "x.dat", "table", False), ("HISTOGRAM", "x.dat", "table", False), ("HISTOGRAM_IMAGE", "x.img", "image", False),
    ("FILE", "x.dat", "table", False), ("TABLE_HEADER", "x.tab", "header", False), ("TABLE_NAME", "x.tab", "unknown", False), ("FILE_NAME", "x.IMG", "image", False), ("FILE_NAME", "x.csv", "table", False),
    ("FILE_NAME", "x.md", "text", False), ("FILE_NAME", "x.bin", "unknown", False), ("IMAGE_HEADER", "x.img", "header", False), ("IMAGE_TIME_TABLE", "x.dat", "table", False), ("SPECTRAL_QUBE", "x.qub", "image", False),
    ("XDR_DOCUMENT", "x.xdr", "image", False), ("MODEL_X", "x.dat", "unknown", False),
]


@query(sql=f"SELECT p_partkey, name, kind, skipped FROM part JOIN (VALUES {', '.join(f'({i}, {n!r}, {k!r}, {x})' for i, (n, _, k, x) in enumerate(_OBJECTS))}) t(i, name, kind, skipped) ON p_partkey % {len(_OBJECTS)} = i")
def m13_m14_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.get(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("file")) for n, f, _, _ in _OBJECTS]), (F.col("p_partkey") % len(_OBJECTS)).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", of["name"].alias("name"), of["file"].alias("file"))
    return found.select("p_partkey", "name", M.object_kind(F.col("name"), F.col("file")).alias("kind"), M.is_skipped(F.col("name")).alias("skipped"))


@query(
    sql="""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey - 1 WHEN o_custkey = 1 THEN 0 WHEN o_orderstatus = 'O' THEN 100 * (o_custkey - 1) ELSE greatest(5000 - 13 * o_custkey, 0) END AS start_byte,
    CASE WHEN o_orderstatus = 'F' THEN 77 WHEN o_orderstatus = 'O' THEN 100 * o_custkey ELSE 15 * o_custkey END AS length FROM orders
    """
)
def m15_m16_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, n = F.col("o_orderstatus"), F.col("o_custkey")
    target = F.struct(F.lit("f").alias("file"), n.alias("value"), F.when(status == "F", "BYTES").alias("units"))
    record = F.when(status == "O", 100)
    start = M.start_byte(target, record, F.lit(13), n, F.lit(5000))
    length = M.table_length(F.when(status == "F", F.lit(77)), n, record, F.lit(13), F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", start.cast("bigint").alias("start_byte"), length.cast("bigint").alias("length"))


@query(sql="SELECT p_partkey, 'ROW_COUNT' AS key, CAST(p_size + 1 AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'ROW_COUNT', '0' FROM part")
def m17_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.col("key") == "ROWS"
    out = M.edited(_meta(spark, sf_dir), rows, value=(F.col("value_long") + 1).cast("string"), key=F.lit("ROW_COUNT"))
    return out.where("key = 'ROW_COUNT'").select("p_partkey", "key", F.col("value_raw").alias("value"))


@query(
    sql="""
    SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(url, '/[^/]*$', '') AS folder FROM pages
    """
)
def s1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", files.file_name(url).alias("name"), files.folder(url).alias("folder"))


#: Files and their kinds: each suffix once, some in upper case or before another one.
_FILES = [(f"x.{e.upper() if i % 2 else e}", "label") for i, e in enumerate("xml lbl lblx 2bl 2al 2cl 01l 3bl 3al 3cl".split())]
_FILES += [("a.img.gz", "image"), ("b.RGB", "image"), ("c.tab", "table"), ("d.csv.zip", "table"), ("e.txt", "text"), ("f.md", "text"), ("g.fits", "fits"), ("h.fit.gz", "fits"), ("i.FITS.bz2", "fits"), ("j.fz", "fits")]
_FILES += [(f"k.{e}", "desktop image") for e in "bmp tif tiff jp2 jpf jpc jpx jpg jpeg gif png webp".split()] + [(f"l.{e}", "other") for e in ("dat", "html", "fts", "gz", "bin")] + [("img", "other")]


@query(sql=f"SELECT p_partkey, file, kind FROM part JOIN (VALUES {', '.join(f'({i}, {f!r}, {k!r})' for i, (f, k) in enumerate(_FILES))}) t(i, file, kind) ON p_partkey % {len(_FILES)} = i")
def s2_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.get(F.array(*[F.lit(f) for f, _ in _FILES]), (F.col("p_partkey") % len(_FILES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", file.alias("file"), files.file_kind(F.concat(F.lit("/data/v.1/"), file)).alias("kind"))


@query(
    sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'v/F' || o_orderkey || '.xml' ELSE 'v/f' || o_orderkey || '.LBL' END AS label_file FROM orders
    """
)
def s3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    data = orders.select("o_orderkey", made.text("v/F", k, ".dat").alias("file"))
    xml = orders.where(k % 4 == 1).select(made.text("v/F", k, ".xml").alias("file"))
    lbl = orders.where(k % 4 != 0).select(made.text("v/f", k, ".LBL").alias("file"))
    return files.with_labels(data, xml.unionByName(lbl)).select("o_orderkey", "label_file")


@query(
    sql="""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'd/Part_' || p_partkey || '.TAB' WHEN 2 THEN 'd/PART_' || p_partkey || '.tab.gz' ELSE 'd/part_' || p_partkey || '.tab' END AS resolved,
    CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS hits FROM part
    """
)
def s4_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    names = part.select("p_partkey", made.text("d/part_", k, ".tab").alias("name"))
    there = F.when(k % 4 == 1, F.array(made.text("d/Part_", k, ".TAB"))).when(k % 4 == 2, F.array(made.text("d/PART_", k, ".tab.gz"))).when(k % 4 == 3, F.array(made.text("d/PART_", k, ".TAB"), made.text("d/part_", k, ".tab")))
    return files.resolved(names, part.select(F.explode(there).alias("file"))).select("p_partkey", "resolved", "hits")


@query(
    sql="""
    SELECT p_partkey, position, folder || '/' || p_name AS path FROM (
      SELECT p_partkey, p_name, unnest([0, 1, 2, 3]) AS position, unnest(['a', p_brand, '/vol' || p_size || '/Data/x/label', '/vol' || p_size || '/Data/x/LABEL']) AS folder FROM part)
    """
)
def s5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("folders", F.array(F.lit("a"), "p_brand"))
    found = files.candidate_paths(part, "p_name", "folders", made.text("/vol", F.col("p_size"), "/Data/x/DATA/y/f.lbl"))
    return found.select("p_partkey", "position", "path")


@query(sql="SELECT doc_id, text FROM documents")
def s6_decompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts gzipped in the query, then unpacked by the reader."""

    def pack(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([pa.array([f"{x}.txt.gz" for x in part.column(0).to_pylist()]), pa.array([gzip.compress(t.encode(), 1) for t in part.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    packed = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).mapInArrow(pack, "path string, content binary")
    return files.decompressed(packed).select(F.regexp_extract("path", "^(.*?)\\.", 1).cast("bigint").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


@query(sql="SELECT o_orderkey, substr(o_orderpriority, 3, 4) AS head, substr(o_orderpriority, -3) AS tail FROM orders")
def s7_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("o_orderpriority").cast("binary")
    return table(spark, sf_dir, "orders").select("o_orderkey", files.byte_range(raw, 4, 2).cast("string").alias("head"), files.byte_range(raw, 3, tail=True).cast("string").alias("tail"))


@query(sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A = ' || p_name || repeat(' ', 20) || chr(10) || 'END' || chr(13) END AS label FROM part")
def s8_attached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("p_size") % 2 == 0, "A").otherwise("é")
    content = F.encode(made.text(first, " = ", F.col("p_name"), " " * 20, "\nEND\r\néè data \nEND\r"), "ISO-8859-1")
    return table(spark, sf_dir, "part").select("p_partkey", files.attached_label(content).alias("label"))
