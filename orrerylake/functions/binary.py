"""Decoders of binary fields as Spark expressions, and the encoders that tests and sinks need.

All take a binary column and a place in it (start from 1, in bytes), so a record is cut and decoded in one
projection without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrerylake.functions.binding import let

ORDERS = ("little", "big")


def _turned(digits: Column, width: int) -> Column:
    """Hex digits with the bytes in the other order."""
    return let(digits, lambda d: F.concat(*[F.substring(d, 2 * i - 1, 2) for i in range(width, 0, -1)]))


def hex_of(raw: Column, start: Column | int, width: int, order: str) -> Column:
    """Hex digits of the field, most significant byte first."""
    digits = F.hex(F.substring(raw, start, width) if isinstance(start, int) else F.substr(raw, start, F.lit(width)))
    return digits if order == "big" or width == 1 else _turned(digits, width)


def unsigned(raw: Column, start: Column | int, width: int, order: str) -> Column:
    """Unsigned integer: bigint up to 4 bytes, decimal(20,0) for 8. Short fields are null."""
    value = let(hex_of(raw, start, width, order), lambda d: F.conv(F.when(F.length(d) == 2 * width, d), 16, 10))
    return value.cast("decimal(20,0)" if width > 4 else "bigint")


def signed(raw: Column, start: Column | int, width: int, order: str) -> Column:
    """Two's complement integer of 1, 2, 4 or 8 bytes as bigint."""
    u = unsigned(raw, start, width, order)
    if width > 4:
        return let(u, lambda x: F.when(x >= F.lit(str(2**63)).cast("decimal(20,0)"), x - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(x).cast("bigint"))
    return let(u, lambda x: F.when(x >= 1 << (8 * width - 1), x - (1 << 8 * width)).otherwise(x))


def ieee(raw: Column, start: Column | int, width: int, order: str) -> Column:
    """IEEE float of 4 or 8 bytes as double, with infinities, NaN and subnormal values."""
    field, bias, fraction = (signed(raw, start, 8, order), 1023, 52) if width == 8 else (unsigned(raw, start, 4, order), 127, 23)

    def value(bits: Column) -> Column:
        exponent = F.shiftrightunsigned(bits, fraction).bitwiseAND(F.lit(2 * bias + 1))
        mantissa = bits.bitwiseAND(F.lit((1 << fraction) - 1)).cast("double")
        negative = bits < 0 if width == 8 else bits >= 1 << 31
        size = (
            F.when(exponent == 0, mantissa * F.lit(2.0 ** (1 - bias - fraction)))
            .when((exponent == 2 * bias + 1) & (mantissa == 0), F.lit(float("inf")))
            .when(exponent == 2 * bias + 1, F.lit(float("nan")))
            .otherwise((1 + mantissa / float(1 << fraction)) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
        )
        return size * F.when(negative, -1.0).otherwise(1.0)

    return let(field, value)


def vax(raw: Column, start: Column | int) -> Column:
    """VAX F real: the 16-bit words are swapped; (0.5 + m / 2^24) * 2^(e - 128), zero where e is 0."""
    at = F.lit(start) if isinstance(start, int) else start
    high, low = unsigned(raw, at, 2, "little"), unsigned(raw, at + 2, 2, "little")

    def value(words: Column) -> Column:
        exponent = F.shiftright(words["high"], 7).bitwiseAND(F.lit(0xFF))
        mantissa = (words["high"].bitwiseAND(F.lit(0x7F)) * 65536 + words["low"]).cast("double")
        size = F.when(exponent == 0, 0.0).otherwise((0.5 + mantissa / float(1 << 24)) * F.pow(F.lit(2.0), (exponent - 128).cast("double")))
        return size * F.when(words["high"] >= 1 << 15, -1.0).otherwise(1.0)

    return let(F.struct(high.alias("high"), low.alias("low")), value)


def ibm(raw: Column, start: Column | int, width: int) -> Column:
    """IBM real of 4 or 8 bytes, big-endian: m / 2^24 (or 2^56) * 16^(e - 64)."""
    at = F.lit(start) if isinstance(start, int) else start
    head = unsigned(raw, at, 1, "big")
    digits = F.conv(F.hex(F.substr(raw, at + 1, F.lit(width - 1))), 16, 10).cast("decimal(20,0)").cast("double")
    size = digits / float(1 << 8 * (width - 1)) * F.pow(F.lit(16.0), (head.bitwiseAND(F.lit(0x7F)) - 64).cast("double"))
    return F.when(head >= 128, -size).otherwise(size)


_LATIN = bytes(range(256)).decode("latin-1")
_CP500 = bytes(range(256)).decode("cp500")


def ebcdic(raw: Column) -> Column:
    """EBCDIC (code page 500) bytes as text, by a table of 256 characters."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _LATIN, _CP500)


def to_ebcdic(text: Column) -> Column:
    return F.encode(F.translate(text, _CP500, _LATIN), "ISO-8859-1")


def bit_text(raw: Column, start: Column | int, width: int, order: str = "big") -> Column:
    """The field's bits as text of fixed length; fields of more than 8 bytes are taken in words."""
    digits = hex_of(raw, start, width, order)
    words = [(i, min(8, width - i)) for i in range(0, width, 8)]
    return F.concat(*[F.lpad(F.conv(F.substring(digits, 2 * i + 1, 2 * n), 16, 2), 8 * n, "0") for i, n in words])


def bit_columns(bits: Column, places: list[tuple[int, int]]) -> Column:
    """Parts of a bit text as an array: (first bit from 1, number of bits)."""
    return F.array(*[F.substring(bits, a, n) for a, n in places])


def bit_items(bits: Column, first: int, items: int, item_bits: int) -> Column:
    return bit_columns(bits, [(first + i * item_bits, item_bits) for i in range(items)])


def boolean(raw: Column, start: Column | int) -> Column:
    return unsigned(raw, start, 1, "big") != 0


def type_code(data_type: Column, width: Column) -> Column:
    """struct<kind, order, is_signed> for a physical type and width; null where the pair has no reading.

    kind: integer, ieee, vax, ibm, bits, text, ebcdic, void. Blanks in names count as underscores.
    """
    t = F.regexp_replace(F.upper(data_type), " ", "_")
    ascii_ = t.contains("ASCII")
    little = t.rlike("^(PC|LSB|VAX)")
    real = t.rlike("REAL|FLOAT") & ~ascii_
    kind = (
        F.when((t.contains("INTEGER") | (t == "BOOLEAN")) & ~ascii_, F.when(width.isin(1, 2, 4, 8), "integer"))
        .when(t == "VAX_REAL", F.when(width == 4, "vax"))
        .when(t == "IBM_REAL", F.when(width.isin(4, 8), "ibm"))
        .when(real, F.when(width.isin(4, 8) & t.isin("IEEE_REAL", "PC_REAL", "FLOAT", "REAL", "MAC_REAL", "SUN_REAL"), "ieee"))
        .when(t.isin("MSB_BIT_STRING", "LSB_BIT_STRING"), "bits")
        .when(t.isin("CHARACTER", "DATE", "TIME", "ASCII_REAL", "ASCII_INTEGER"), "text")
        .when(t.isin("EBCDIC", "EBCDIC_CHARACTER"), "ebcdic")
        .when(t.isin("VOID", "BCD", "BINARY_CODED_DECIMAL"), "void")
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(little, "little").otherwise("big").alias("order"), ((kind == "integer") & ~t.contains("UNSIGNED")).alias("is_signed")))


def integer_bytes(value: Column, width: int, order: str) -> Column:
    """The low ``width`` bytes of a bigint."""
    digits = F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * width))
    return F.unhex(_turned(digits, width) if order == "little" else digits)


def ieee_bytes(value: Column, width: int, order: str) -> Column:
    """IEEE bytes of a finite normal value or zero that fits the width exactly."""
    bias, fraction = (1023, 52) if width == 8 else (127, 23)

    def of(size: Column) -> Column:
        return let(F.floor(F.log2(size)), lambda guess: let(guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when(size < F.pow(F.lit(2.0), guess), -1).otherwise(0), lambda e: packed(size, e)))

    def packed(size: Column, exponent: Column) -> Column:
        mantissa = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << fraction)).cast("bigint")
        return F.when(size == 0, F.lit(0).cast("bigint")).otherwise((exponent + bias) * (1 << fraction) + mantissa)

    top = F.lit(-(1 << 63)) if width == 8 else F.lit(1 << 31)
    bits = let(F.abs(value.cast("double")), of)
    return let(F.when(value < 0, bits.bitwiseOR(top)).otherwise(bits), lambda b: integer_bytes(b, width, order))
