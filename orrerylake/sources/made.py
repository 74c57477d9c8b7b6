"""Labels and records made from the given tables, so that readers can be held against plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerylake.functions import binary


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def part_labels(part: DataFrame) -> DataFrame:
    """(p_partkey, label): a label with comments, continued values, pointers, quantities and nested blocks."""
    c = F.col
    label = text(
        "PDS_VERSION_ID = PDS3 /* first line\n", "/* ", c("p_name"), " */\n",
        "PRODUCT_ID = \"P", c("p_partkey"), "\"\n",
        "^TABLE = (\"PART_", c("p_partkey"), ".TAB\", ", c("p_size"), " <BYTES>)\n",
        "^IMAGE = ", c("p_size"), "\n", "^IMAGE = ", c("p_size") + 1, "\n",
        "SPACECRAFT_NAME = '", c("p_brand"), "'\n",
        "PRICE = ", c("p_size"), " <USD>\n",
        "CODES = (1, ", c("p_size"), ", \"", c("p_type"), "\")\n",
        "MASK = 16#", F.hex("p_partkey"), "#\n",
        "PADDED = 00", c("p_size") + 1, "\n",
        "DESCRIPTION = \"first\n   part of  \n", c("p_name"), "\"\n",
        "BAD = 1 = 2\n", "END_TIME = ", c("p_size"), "\n",
        "OBJECT = TABLE\n  ROWS = ", c("p_size"), "\n  PRODUCT_ID = INNER\n",
        "  OBJECT = COLUMN\n    NAME = ", c("p_type"), "\n    BYTES = 4\n  END_OBJECT = COLUMN\n", "  NOTE = 1.5\n",
        "END_OBJECT = TABLE\n", "OBJECT = TABLE\n  ROWS = -1\nEND_OBJECT\n", "GROUP = OPEN\n  LEFT = ", c("p_brand"), "\nEND\n",
    )
    return part.select("p_partkey", label.alias("label"))


def fixed_lines(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, l_linenumber, line): fixed-width text records of 44 bytes."""
    line = F.concat(
        F.lpad(F.col("l_orderkey").cast("string"), 12, " "),
        F.lpad(F.col("l_linenumber").cast("string"), 4, " "),
        F.lpad(F.format_string("%.2f", "l_quantity"), 10, " "),
        F.rpad(F.concat(F.lit('"'), "l_returnflag", F.lit('"')), 6, " "),
        F.rpad(F.date_format("l_shipdate", "yyyy-DDD"), 12, " "),
    )
    return lineitem.select("l_orderkey", "l_linenumber", line.alias("line"))


def delimited_lines(lineitem: DataFrame, sep: str = "|") -> DataFrame:
    line = F.concat_ws(sep, F.col("l_orderkey").cast("string"), F.concat(F.lit(" "), F.col("l_linenumber").cast("string")), F.format_string("%.2f", "l_quantity"), F.concat(F.lit('" '), "l_returnflag", F.lit('"')))
    return lineitem.select(F.concat(line, F.lit("\r")).alias("line"))


def binary_records(lineitem: DataFrame) -> DataFrame:
    """(record): 37 bytes with integers, floats, VAX and IBM reals, bits, a flag and EBCDIC text."""
    c = F.col
    quantity = c("l_quantity").cast("bigint")
    # A whole number below 64 as VAX F and IBM reals: mantissas by shifting up to the leading place.
    exponent = F.floor(F.log2(quantity.cast("double"))).cast("int") + 1
    fraction = F.expr("bigint(l_quantity) * bigint(pow(2, 24 - (int(floor(log2(double(bigint(l_quantity))))) + 1)))")
    vax_high = (exponent + 128) * 128 + F.shiftright(fraction, 16).bitwiseAND(F.lit(0x7F))
    vax = F.concat(binary.integer_bytes(vax_high, 2, "little"), binary.integer_bytes(fraction.bitwiseAND(F.lit(0xFFFF)), 2, "little"))
    ibm = F.concat(F.unhex(F.lit("42")), binary.integer_bytes(quantity * 65536, 3, "big"))
    record = F.concat(
        binary.integer_bytes(c("l_orderkey"), 4, "big"),
        binary.integer_bytes(-c("l_orderkey"), 8, "little"),
        binary.integer_bytes(-c("l_linenumber"), 2, "little"),
        binary.ieee_bytes(c("l_extendedprice"), 8, "little"),
        binary.ieee_bytes(-c("l_quantity"), 4, "big"),
        vax,
        ibm,
        binary.integer_bytes(quantity, 1, "big"),
        F.unhex(F.when(c("l_linestatus") == "O", "01").otherwise("00")),
        binary.to_ebcdic(c("l_returnflag")),
    )
    return lineitem.select(record.alias("record"))


def written(frame: DataFrame, path: str, by: str, content: str) -> None:
    """The bytes of each row as a file of their own in a folder named after ``by``; Spark ends them with a line feed."""
    frame.select(by, F.col(content).cast("string").alias("value")).write.partitionBy(by).text(path)


HEAD_BYTES = 2048
#: Orders of a product at most.
ORDERS_EACH = 256


def _column(name: str, data_type: str, start: int, width: int, *more: str) -> str:
    return "\n".join(["  OBJECT = COLUMN", f"    NAME = {name}", f"    DATA_TYPE = {data_type}", f"    START_BYTE = {start}", f"    BYTES = {width}", *[f"    {m}" for m in more], "  END_OBJECT = COLUMN"]) + "\n"


#: Three formats of the same facts: integers and reals of either order, numbers as text, and a scaled field with items and padding. Row bytes, columns.
FORMATS = [
    (20, "BINARY", _column("ORDERKEY", "MSB_INTEGER", 1, 8) + _column("CUSTKEY", "LSB_UNSIGNED_INTEGER", 9, 4) + _column("PRICE", "IEEE_REAL", 13, 8)),
    (40, "ASCII", _column("ORDERKEY", "INTEGER", 1, 12) + _column("CUSTKEY", "INTEGER", 14, 10) + _column("PRICE", "ASCII_REAL", 24, 16)),
    (22, "BINARY", _column("PRICE", "PC_REAL", 3, 8) + _column("ORDERKEY", "MSB_UNSIGNED_INTEGER", 11, 4) + _column("CUSTKEY", "LSB_INTEGER", 15, 4, "SCALING_FACTOR = 0.5") + _column("YEARS", "MSB_UNSIGNED_INTEGER", 19, 4, "ITEMS = 2", "ITEM_BYTES = 2")),
]


def order_products(orders: DataFrame) -> DataFrame:
    """(product, content): one file for each ``ORDERS_EACH`` keys of orders, with an attached label, a table in one of three formats, and an image of
    two bands with a line for each order and a prefix of two bytes.
    """
    c = F.col
    year = F.year("o_orderdate")
    one = F.concat(binary.integer_bytes(c("o_orderkey"), 8, "big"), binary.integer_bytes(c("o_custkey"), 4, "little"), binary.ieee_bytes(c("o_totalprice"), 8, "big"))
    other = F.concat(F.lpad(c("o_orderkey").cast("string"), 12, " "), F.lit(" "), F.lpad(c("o_custkey").cast("string"), 10, " "), F.lpad(F.format_string("%.2f", "o_totalprice"), 16, " "), F.lit("\n")).cast("binary")
    third = F.concat(F.unhex(F.lit("FFFF")), binary.ieee_bytes(c("o_totalprice"), 8, "little"), binary.integer_bytes(c("o_orderkey"), 4, "big"), binary.integer_bytes(c("o_custkey") * 2, 4, "little"), binary.integer_bytes(year, 2, "big"), binary.integer_bytes(year + 1, 2, "big"))
    product = F.floor(c("o_orderkey") / ORDERS_EACH)
    kind = product % 3
    line = [F.concat(F.unhex(F.lit("AABB")), binary.integer_bytes(-c("o_custkey"), 4, "little"), binary.integer_bytes(c("o_orderkey") + b, 4, "little")) for b in (0, 1)]
    row = F.struct("o_orderkey", F.hex(F.when(kind == 0, one).when(kind == 1, other).otherwise(third)).alias("row"), *[F.hex(x).alias(f"line{b}") for b, x in enumerate(line)])
    held = orders.groupBy(product.alias("product")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    n, kind = F.size("rows"), F.col("product") % 3
    row_bytes, interchange, columns = (F.when(kind == 0, F.lit(FORMATS[0][i])).when(kind == 1, F.lit(FORMATS[1][i])).otherwise(F.lit(FORMATS[2][i])) for i in range(3))
    label = text(
        "PDS_VERSION_ID = PDS3\nRECORD_TYPE = FIXED_LENGTH\nDATA_SET_ID = ORDERS\nPRODUCT_ID = ", F.col("product"), "\n^TABLE = ", F.lit(HEAD_BYTES + 1), " <BYTES>\n^IMAGE = ", HEAD_BYTES + 1 + n * row_bytes, " <BYTES>\n",
        "OBJECT = TABLE\n  INTERCHANGE_FORMAT = ", interchange, "\n  ROWS = ", n, "\n  ROW_BYTES = ", row_bytes, "\n", columns, "END_OBJECT = TABLE\n",
        "OBJECT = IMAGE\n  LINES = ", n, "\n  LINE_SAMPLES = 2\n  SAMPLE_TYPE = LSB_INTEGER\n  SAMPLE_BITS = 32\n  BANDS = 2\n  BAND_STORAGE_TYPE = ", F.when(kind == 0, "BAND_SEQUENTIAL").otherwise("LINE_INTERLEAVED"),
        "\n  LINE_PREFIX_BYTES = 2\nEND_OBJECT = IMAGE\nEND\n",
    )
    digits, by_band = F.array_join("rows.row", ""), F.concat(F.array_join("rows.line0", ""), F.array_join("rows.line1", ""))
    by_line = F.array_join(F.transform("rows", lambda r: F.concat(r["line0"], r["line1"])), "")
    return held.select("product", F.concat(F.rpad(label, HEAD_BYTES, " ").cast("binary"), F.unhex(digits), F.unhex(F.when(kind == 0, by_band).otherwise(by_line))).alias("content"))


#: Layouts of a text table of orders, by the product's number; each wants another reader. The label is the same for all but the delimiter.
LAYOUTS = ["delimited", "white space", "fixed width", "records by bytes", "moved breaks", "after marker", "sections", "null spellings", "filled headers", "without nuls", "added breaks", "spreadsheet", "quoted records"]
_TEXT_TABLE = _column("CUSTKEY", "INTEGER", 1, 10) + _column("ORDERKEY", "INTEGER", 12, 12) + _column("PRICE", "ASCII_REAL", 24, 16)
TEXT_ROW_BYTES = 39


def layout_products(orders: DataFrame) -> DataFrame:
    """(product, content): text tables of ``ORDERS_EACH`` keys of orders each, in one of ``LAYOUTS``, behind an attached label whose data set names the layout."""
    c = F.col
    product = F.floor(c("o_orderkey") / ORDERS_EACH)
    price = F.format_string("%.2f", "o_totalprice")
    fixed = F.concat(F.lpad(c("o_custkey").cast("string"), 10, " "), F.lit(" "), F.lpad(c("o_orderkey").cast("string"), 12, " "), F.lpad(price, 16, " "))
    cut = F.concat_ws(";", c("o_custkey").cast("string"), F.concat(F.lit('" '), c("o_orderkey").cast("string"), F.lit('"')), price)
    spelled = F.concat_ws(";", c("o_custkey").cast("string"), c("o_orderkey").cast("string"), F.when(c("o_custkey") % 3 == 0, "N/A").otherwise(price))
    under = F.concat(c("o_custkey").cast("string"), F.lit("\n"), c("o_orderkey").cast("string"), F.lit(";"), price)
    blank = F.concat_ws("  ", F.lit(""), c("o_custkey").cast("string"), c("o_orderkey").cast("string"), price)
    held = orders.groupBy(product.alias("product")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", fixed.alias("fixed"), cut.alias("cut"), spelled.alias("spelled"), under.alias("under"), blank.alias("blank")))).alias("rows"))
    kind, n = F.col("product") % len(LAYOUTS), F.size("rows")
    unbroken, by_line = F.array_join("rows.fixed", ""), F.array_join("rows.cut", "\r\n")
    body = {
        "delimited": by_line, "white space": F.array_join("rows.blank", "\n"), "fixed width": F.array_join("rows.fixed", "\n"), "records by bytes": unbroken, "moved breaks": F.regexp_replace(unbroken, "(.{25})", "$1\n"),
        "after marker": F.concat(F.lit("7;8;9\n// start\n"), by_line), "sections": F.concat(F.lit("a\nb\nc\n"), by_line, F.lit("\n1;2;3")), "null spellings": F.concat(F.lit("# note\n"), F.array_join("rows.spelled", "\n")), "filled headers": F.array_join("rows.under", "\n"),
        "without nuls": F.regexp_replace(F.array_join("rows.fixed", "\n"), "(\n|^)", "$1\u0000"), "added breaks": unbroken, "spreadsheet": by_line, "quoted records": F.array_join(F.transform("rows", lambda r: F.regexp_replace(r["cut"], '" ', '"\n')), "\r\n"),
    }
    layout, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, name in enumerate(LAYOUTS):
        layout, content = F.when(kind == k, name).otherwise(layout), F.when(kind == k, body[name]).otherwise(content)
    label = text(
        "PDS_VERSION_ID = PDS3\nDATA_SET_ID = \"", layout, "\"\n^TABLE = ", F.lit(HEAD_BYTES + 1), " <BYTES>\nOBJECT = TABLE\n  INTERCHANGE_FORMAT = ASCII\n  ROWS = ", n, "\n  ROW_BYTES = ", F.lit(TEXT_ROW_BYTES), "\n  FIELD_DELIMITER = SEMICOLON\n", _TEXT_TABLE, "END_OBJECT = TABLE\nEND\n",
    )
    return held.select("product", F.concat(F.rpad(label, HEAD_BYTES, " "), content).cast("binary").alias("content"))


def _cards(*cards: Column | str) -> Column:
    """Hex digits of a header: cards of 80 characters, filled to whole blocks."""
    whole = F.concat(*[F.rpad(F.lit(c) if isinstance(c, str) else c, 80, " ") for c in (*cards, "END")])
    return F.hex(F.rpad(whole, 2880 * -(-80 * (len(cards) + 1) // 2880), " ").cast("binary"))


def _blocks(digits: Column, fill: str = "0") -> Column:
    return F.rpad(digits, (F.ceil(F.length(digits) / 5760) * 5760).cast("int"), fill)


def unit_products(orders: DataFrame) -> DataFrame:
    """(product, content): files of three header-and-data units of ``ORDERS_EACH`` keys of orders each: an image with a line for each order, a binary
    table with cells of two values and a scaled column, and a table of text, both tables of the same name.
    """
    c = F.col
    cell = F.concat(binary.integer_bytes(c("o_orderkey"), 8, "big"), binary.ieee_bytes(c("o_totalprice"), 8, "big"), binary.integer_bytes(c("o_custkey"), 4, "big"), binary.integer_bytes(-c("o_custkey"), 4, "big"), F.when(c("o_orderstatus") == "F", F.lit(b"T")).otherwise(F.lit(b"F")))
    line = F.concat(binary.integer_bytes(c("o_custkey"), 4, "big"), binary.integer_bytes(c("o_orderkey"), 4, "big"), binary.integer_bytes(F.lit(-99), 4, "big"))
    written_ = F.concat(F.lpad(c("o_orderkey").cast("string"), 12, " "), F.lit(" "), F.lpad(F.format_string("%.2f", "o_totalprice"), 15, " "), F.lit(" "), F.rpad("o_orderpriority", 15, " ")).cast("binary")
    held = orders.groupBy(F.floor(c("o_orderkey") / ORDERS_EACH).alias("product")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.hex(cell).alias("cell"), F.hex(line).alias("line"), F.hex(written_).alias("text")))).alias("rows"))
    n = F.size("rows")

    def card(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key:<8}= "), F.lpad(value.cast("string"), 20, " "), F.lit(" / made"))

    image = _cards("SIMPLE  =                    T", "BITPIX  =                   32", "NAXIS   =                    2", "NAXIS1  =                    3", card("NAXIS2", n), "BSCALE  =                  0.5", "BZERO   =                  1.0", "BLANK   =                  -99", "OBJECT  = 'image''s /  '", "COMMENT none", "")
    cells = _cards("XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   25", card("NAXIS2", n), "PCOUNT  =                    0", "GCOUNT  =                    1", "TFIELDS =                    4", "TTYPE1  = 'ORDERKEY'", "TFORM1  = 'K       '", "TTYPE2  = 'PRICE   '", "TFORM2  = '1D      '", "TTYPE3  = 'CUST    '", "TFORM3  = '2J      '", "TSCAL3  =                  2.0", "TTYPE4  = 'DONE    '", "TFORM4  = 'L       '", "EXTNAME = 'ORDERS  '")
    texts = _cards("XTENSION= 'TABLE   '", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   44", card("NAXIS2", n), "PCOUNT  =                    0", "GCOUNT  =                    1", "TFIELDS =                    3", "TTYPE1  = 'ORDERKEY'", "TFORM1  = 'I12     '", "TBCOL1  =                    1", "TTYPE2  = 'PRICE   '", "TFORM2  = 'F15.2   '", "TBCOL2  =                   14", "TTYPE3  = 'PRIORITY'", "TFORM3  = 'A15     '", "TBCOL3  =                   30", "EXTNAME = 'ORDERS  '")
    body = F.concat(image, _blocks(F.array_join("rows.line", "")), cells, _blocks(F.array_join("rows.cell", "")), texts, _blocks(F.array_join("rows.text", ""), "20"))
    return held.select("product", F.unhex(body).alias("content"))
