"""Numeric arrays of bytes to values and back, a batch of rows at a time; the native decoders are for single fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrerylake.sources import ranges

_LETTERS = {"integer": "i", "unsigned": "u", "ieee": "f"}


def _dtype(kind: str, width: int, order: str) -> np.dtype:
    return np.dtype(f"{'<' if order == 'little' else '>'}{_LETTERS[kind]}{width}")


def array_of(raw: Column, kind: str, width: int, order: str) -> Column:
    """array<double> of all values in each row's bytes; bytes over at the end are left out, null stays null."""
    dtype = _dtype(kind, width, order)

    def decode(raws: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else np.frombuffer(r, dtype, len(r) // width).astype(float) for r in raws], dtype=object)

    return F.pandas_udf(decode, "array<double>")(raw)


def bytes_of(values: Column, kind: str, width: int, order: str) -> Column:
    dtype = _dtype(kind, width, order)

    def encode(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else np.asarray(a, float).astype(dtype).tobytes() for a in arrays], dtype=object)

    return F.pandas_udf(encode, "binary")(values)


def _number(text: bytes, kind: type) -> int | float | None:
    try:
        value = kind(text.strip(b" \t\r\n\",\0").decode("ascii"))
    except (ValueError, UnicodeDecodeError):
        return None
    return value if kind is float or -(2**63) <= value < 2**63 else None


def field_of(block: np.ndarray, kind: str, order: str, start: int, width: int, is_signed: bool) -> np.ndarray | list:
    """One field of equal records, which are the rows of a block of bytes."""
    raw = np.ascontiguousarray(block[:, start - 1 : start - 1 + width])
    if kind in ("integer", "ieee"):
        letter = "f" if kind == "ieee" else "i" if is_signed else "u"
        values = raw.view(np.dtype(f"{'<' if order == 'little' else '>'}{letter}{width}")).ravel()
        return values.astype(values.dtype.newbyteorder("="))
    if kind == "vax":  # words of two bytes, the higher first, each little-endian
        bits = raw.view("<u2").astype(np.int64)
        bits = bits[:, 0] << 16 | bits[:, 1]
        exponent, fraction = bits >> 23 & 0xFF, bits & 0x7FFFFF
        value = np.where(bits >> 31, -1.0, 1.0) * np.ldexp((fraction + (1 << 23)).astype(float), (exponent - 128 - 24).astype(int))
        return np.where(exponent == 0, 0.0, value).astype(np.float32)
    if kind == "ibm":
        high = raw[:, 0].astype(int)
        fraction = np.zeros(len(raw))
        for k in range(1, width):
            fraction = fraction * 256 + raw[:, k]
        return np.where(high >> 7, -1.0, 1.0) * np.ldexp(fraction, 4 * ((high & 0x7F) - 64) - 8 * (width - 1))
    if kind == "bits":
        swapped = raw[:, ::-1] if order == "little" else raw
        return [bytes(r).decode() for r in np.unpackbits(np.ascontiguousarray(swapped), axis=1) + 48]
    if kind == "ebcdic":
        return [bytes(r).decode("cp500") for r in raw]
    if kind == "text":
        return [bytes(r).decode("latin-1").rstrip(" ") for r in raw]
    if kind in ("ascii_integer", "ascii_real"):
        return [_number(bytes(r), int if kind == "ascii_integer" else float) for r in raw]
    if kind == "boolean":
        return raw.any(1)
    if kind == "logical":  # a letter, T for true
        return raw[:, 0] == ord("T")
    return [bytes(r) for r in raw]


#: Arrow types by the Spark types of fields.
_ARROW = {
    "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0), "binary": pa.binary(),
}


#: Arrow types of the fields that come as lists.
_LIST_TYPES = {"bits": pa.string(), "ebcdic": pa.string(), "text": pa.string(), "ascii_integer": pa.int64(), "ascii_real": pa.float64()}


def arrow_type(type_: str) -> pa.DataType:
    return _ARROW.get(type_, pa.binary())


def padded_block(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes of every record as rows of a block; shorter records are filled with zeros. ``data`` has ``width`` bytes over."""
    if not width or not len(starts):
        return np.zeros((len(starts), width), np.uint8)
    if (sizes == width).all() and (np.diff(starts) == width).all():
        return data[starts[0] : starts[0] + width * len(starts)].reshape(len(starts), width)
    block = np.ndarray((len(data) - width + 1, width), np.uint8, data, strides=(1, 1))[starts]
    if (sizes < width).any():
        block = block * (np.arange(width) < sizes[:, None])
    return block


def fields_of_block(block: np.ndarray, sizes: np.ndarray, fields: list[dict], types: list[str | None]) -> list[pa.Array]:
    """One array for each field, of its type if that is given; a record that does not hold all bytes of a field has a null there."""
    out = []
    for f, type_ in zip(fields, types, strict=True):
        there = sizes >= f["start"] - 1 + f["width"]
        values = field_of(block if there.all() else block[there], f["kind"], f["order"], f["start"], f["width"], f["is_signed"])
        held = pa.array(values, _LIST_TYPES.get(f["kind"], pa.binary())) if isinstance(values, list) else pa.array(values)
        if type_:
            held = held.cast(arrow_type(type_))
        out.append(held if there.all() else held.take(pa.array(np.where(there, np.cumsum(there) - 1, 0), mask=~there)))
    return out


def decoded_records(records: DataFrame, fields: list[dict], schema: StructType, record: str = "record") -> DataFrame:
    """A typed column for each field of a format, decoded from all records of a batch at once.

    A field is decoded from each record that holds all its bytes, whatever the length of this or any other record; else, and
    for null records, it is null. An empty table stays empty. No other column of ``records`` is kept.
    """
    types = [f.dataType.simpleString() for f in schema.fields]
    end = max((f["start"] - 1 + f["width"] for f in fields), default=0)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).cast(pa.large_binary())
            held = cells.fill_null(b"") if cells.null_count else cells
            offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
            data = np.frombuffer(held.buffers()[2], np.uint8) if len(held) and held.buffers()[2] is not None else np.zeros(0, np.uint8)
            sizes = np.diff(offsets)
            if cells.null_count:
                sizes = np.where(cells.is_valid().to_numpy(zero_copy_only=False), sizes, -1)
            block = padded_block(np.concatenate([data, np.zeros(end, np.uint8)]), offsets[:-1], sizes, end)
            yield pa.RecordBatch.from_arrays(fields_of_block(block, sizes, fields, types), names=[f["name"] for f in fields])

    return records.select(record).mapInArrow(decode, schema)


def _converted(values: pa.Array, type_: str, scale: float | None, offset: float | None) -> pa.Array:
    if (scale is not None or offset is not None) and not pa.types.is_string(values.type) and not pa.types.is_binary(values.type) and not pa.types.is_boolean(values.type):
        values = pc.add(pc.multiply(values.cast(pa.float64()), 1.0 if scale is None else scale), 0.0 if offset is None else offset)
    to = arrow_type(type_)
    if values.type == to:
        return values
    if pa.types.is_string(to) and pa.types.is_binary(values.type):
        return pa.array([None if v is None else v.hex() for v in values.to_pylist()], pa.string())
    return values.cast(to)


def range_decoder(keys: list[str], columns: dict[str, str], file: str, at_once: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's part of ``formats.decoded_by_format``: read a range, cut it into records, decode each field of all of them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = {c: batch.column(c).to_pylist() for c in ("first_row", "record_bytes", "skip_bytes", "fields")}
            for row, content in ranges.slices(batch, file):
                if not content:
                    continue
                record, skip, fields = info["record_bytes"][row], info["skip_bytes"][row] or 0, info["fields"][row] or []
                end = max((f["start"] - 1 + f["width"] for f in fields), default=0)
                data = np.frombuffer(content + bytes(end), np.uint8)
                n = -(-len(content) // record)
                for k in range(0, n, at_once):
                    starts = np.arange(k, min(k + at_once, n), dtype=np.int64) * record
                    sizes = np.minimum(record, len(content) - starts) - skip
                    held = dict.fromkeys(columns)
                    block = padded_block(data, np.minimum(starts + skip, len(content)), sizes, end)
                    for f, values in zip(fields, fields_of_block(block, sizes, fields, [None] * len(fields)), strict=True):
                        held[f["name"]] = _converted(values, columns[f["name"]], f["scale"], f["offset"])
                    size = len(starts)
                    arrays = [pa.nulls(size, arrow_type(columns[c])) if a is None else a for c, a in held.items()]
                    of = pa.array(np.full(size, row, np.int64))
                    rows = pa.array(np.arange(size, dtype=np.int64) + k + info["first_row"][row])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in keys], rows, *arrays], names=[*keys, "row", *held])

    return decode


def image_decoder(keys: list[str], file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's part of ``archive.image_lines``: a range of an image's line records to rows (keys, band, line, samples)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = {c: batch.column(c).to_pylist() for c in ("first_row", "record_bytes", "lines", "line_samples", "bands", "order", "prefix", "kind", "byte_order", "pixel_bytes", "is_signed")}
            for row, content in ranges.slices(batch, file):
                i = {c: v[row] for c, v in info.items()}
                n = len(content or b"") // i["record_bytes"]
                if not n:
                    continue
                per_record = i["line_samples"] * (i["bands"] if i["order"] == "SAMPLE_INTERLEAVED" else 1)
                raw = np.frombuffer(content, np.uint8)[: n * i["record_bytes"]].reshape(n, i["record_bytes"])
                raw = np.ascontiguousarray(raw[:, i["prefix"] : i["prefix"] + per_record * i["pixel_bytes"]]).reshape(-1, i["pixel_bytes"])
                values = np.asarray(field_of(raw, i["kind"], i["byte_order"], 1, i["pixel_bytes"], i["is_signed"]), float)
                at = np.arange(n) + i["first_row"]
                if i["order"] == "SAMPLE_INTERLEAVED":
                    values = values.reshape(n, i["line_samples"], i["bands"]).transpose(0, 2, 1).reshape(-1)
                    band, line = np.tile(np.arange(i["bands"]), n), np.repeat(at, i["bands"])
                elif i["order"] == "LINE_INTERLEAVED":
                    band, line = at % i["bands"], at // i["bands"]
                else:
                    band, line = at // i["lines"], at % i["lines"]
                offsets = np.arange(0, len(values) + 1, i["line_samples"], dtype=np.int32)
                samples = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                of = pa.array(np.full(len(band), row, np.int64))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in keys], pa.array(band.astype(np.int32)), pa.array(line.astype(np.int32)), samples], names=[*keys, "band", "line", "samples"])

    return decode
