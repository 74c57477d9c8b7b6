"""Images as rows of lines or pixels: properties, de-interleaving, cuts, stretches, colours, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import quantiles

ORDERS = ("BAND_SEQUENTIAL", "LINE_INTERLEAVED", "SAMPLE_INTERLEAVED")


def properties(lines: Column, samples: Column, bands: Column, bits: Column, order: Column) -> Column:
    """struct<rows, columns, bands, bytes_per_pixel, pixels, order, error> of an image block."""
    n = F.coalesce(bands, F.lit(1))
    error = F.when((n > 1) & order.isNull(), "several bands without a storage order")
    return F.struct(lines.alias("rows"), samples.alias("columns"), n.alias("bands"), (bits / 8).cast("int").alias("bytes_per_pixel"), (lines * samples * n).alias("pixels"), order.alias("order"), error.alias("error"))


def cube_properties(axes: Column, items: Column) -> Column:
    """struct<rows, columns, bands, order> of a cube by its axes' names; the order is told by which axis is fastest."""
    size = F.map_from_arrays(axes, items)
    order = F.when(axes[2] == "BAND", ORDERS[0]).when(axes[0] == "BAND", ORDERS[2]).otherwise(ORDERS[1])
    return F.struct(size["LINE"].alias("rows"), size["SAMPLE"].alias("columns"), size["BAND"].alias("bands"), order.alias("order"))


def line_pads(prefix_bytes: Column, suffix_bytes: Column, pixel_bytes: Column) -> Column:
    """struct<prefix, suffix, error>: bytes beside each line as pixels; parts of a pixel are an error."""
    p, s = F.coalesce(prefix_bytes, F.lit(0)), F.coalesce(suffix_bytes, F.lit(0))
    return F.struct((p / pixel_bytes).cast("int").alias("prefix"), (s / pixel_bytes).cast("int").alias("suffix"), F.when((p % pixel_bytes != 0) | (s % pixel_bytes != 0), "line padding is no whole number of pixels").alias("error"))


AXES = ("SAMPLE", "LINE", "BAND")


def plane_pads(axes: Column, items: dict[str, Column], item_bytes: Column, pixel_bytes: Column) -> Column:
    """struct<before, after, error> of a cube with planes beside its axes; before and after are struct<samples, lines, bands> in pixels.

    ``axes``: the axes' names, fastest first. ``items``: under PREFIX and SUFFIX the numbers of items of the axes, in their order.
    ``item_bytes``: map of AXIS_SIDE, as BAND_SUFFIX, to an array of bytes an item: one value holds for all items, several are an item
    each. What the map does not name has no planes; a null map has none at all. Where planes are named without items or
    axes, differ in width, or are no whole number of pixels, error says so and that number is null.
    """
    numbers, errors = {}, []
    for side in ("PREFIX", "SUFFIX"):
        for axis in AXES:
            width = F.try_element_at(item_bytes, F.lit(f"{axis}_{side}"))
            count = F.get(items[side], (F.array_position(axes, axis) - 1).cast("int"))
            total = F.when(F.size(width) > 1, F.aggregate(width, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(count * F.get(width, F.lit(0)))
            error = (
                F.when(width.isNull(), None).when(items[side].isNull(), "planes without a number of items").when(count.isNull(), "planes without an order of axes")
                .when(F.size(F.array_distinct(width)) > 1, "planes of different widths").when(total % pixel_bytes != 0, "planes are no whole number of pixels")
            )
            errors.append(error)
            numbers[axis, side] = F.when(width.isNull(), 0).when(error.isNull(), (total / pixel_bytes).cast("int"))

    def beside(side: str) -> Column:
        return F.struct(*[numbers[axis, side].alias(f"{axis.lower()}s") for axis in AXES])

    several = F.aggregate(F.array(*[((numbers[a, "PREFIX"] + numbers[a, "SUFFIX"]) > 0).cast("int") for a in AXES]), F.lit(0), lambda n, x: n + x) > 1
    return F.struct(beside("PREFIX").alias("before"), beside("SUFFIX").alias("after"), F.coalesce(*errors, F.when(several, "planes along several axes")).alias("error"))


def pads_error(line: Column, planes: Column, bands: Column, order: Column) -> Column:
    """What is wrong with an image's pads, given those of its lines (``line_pads``) and of its axes (``plane_pads``); null if they can be read.

    Their own errors come first. Pads of lines go neither with planes nor with several bands unless the bands are interleaved by line.
    """
    padded = (line["prefix"] + line["suffix"]) > 0
    flat = F.greatest(*[planes[part][f"{axis.lower()}s"] for part in ("before", "after") for axis in AXES]) == 0
    stored = (F.coalesce(bands, F.lit(1)) > 1) & order.isNotNull() & (order != ORDERS[1])
    return F.coalesce(line["error"], planes["error"], F.when(padded & ~flat, "pads of lines and planes together"), F.when(padded & stored, "pads of lines in bands that are not interleaved by line"))


def place(index: Column, lines: int, samples: int, bands: int, order: str) -> tuple[Column, Column, Column]:
    """(band, line, sample) of a pixel by its place in the file."""
    if order == ORDERS[2]:
        return index % bands, F.floor(index / (samples * bands)), F.floor(index / bands) % samples
    if order == ORDERS[1]:
        return F.floor(index / samples) % bands, F.floor(index / (samples * bands)), index % samples
    return F.floor(index / (lines * samples)), F.floor(index / samples) % lines, index % samples


def pixels(frame: DataFrame, values: str, lines: int, samples: int, bands: int, order: str) -> DataFrame:
    """One row for each pixel of arrays in file order; no shuffle."""
    flat = frame.select(*[c for c in frame.columns if c != values], F.posexplode(values).alias("_i", "value"))
    band, line, sample = place(F.col("_i"), lines, samples, bands, order)
    return flat.withColumns({"band": band.cast("int"), "line": line.cast("int"), "sample": sample.cast("int")}).drop("_i")


def line_part(values: Column, prefix: int, suffix: int, part: str = "image") -> Column:
    """The image, prefix or suffix part of a line held as an array."""
    n = F.size(values)
    if part == "prefix":
        return F.slice(values, 1, prefix)
    if part == "suffix":
        return F.slice(values, n - suffix + 1, F.lit(suffix))
    return F.slice(values, F.lit(prefix + 1), n - prefix - suffix)


def without_planes(cells: DataFrame, samples: int, lines: int, bands: int) -> DataFrame:
    """The core of a cube whose side, bottom and back planes follow its samples, lines and bands."""
    return cells.where((F.col("sample") < samples) & (F.col("line") < lines) & (F.col("band") < bands))


def plane_of(samples: int, lines: int, bands: int, before: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """Which part of a cube with planes a pixel lies in: side (beside the samples), bottom (lines), back (bands) or core.

    ``before``: planes in front of the samples, lines and bands; what lies behind them is a plane, too. A pixel in several is in the first of them.
    """
    out = F.lit("core")
    for name, axis, first, n in (("back", "band", before[2], bands), ("bottom", "line", before[1], lines), ("side", "sample", before[0], samples)):
        out = F.when((F.col(axis) < first) | (F.col(axis) >= first + n), name).otherwise(out)
    return out


def cube_section(cells: DataFrame, bands: tuple[int, int] | None = None, lines: tuple[int, int] | None = None, samples: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of a section of a cube, counted anew from 0 along each axis; an axis without bounds stays whole. Bounds are from, to (left out)."""
    out = cells
    for axis, bound in (("band", bands), ("line", lines), ("sample", samples)):
        if bound is not None:
            out = out.where((F.col(axis) >= bound[0]) & (F.col(axis) < bound[1])).withColumn(axis, F.col(axis) - bound[0])
    return out


def browse_bands(cells: DataFrame, n_bands: int, chosen: tuple[int, ...] | None = None, burst: bool = False) -> DataFrame:
    """The pixels of a browse image, with the column channel: every band with ``burst``; red, green and blue of three ``chosen`` bands, or of the first three where there
    are three or four; one chosen band; else the middle one. channel: the band's number as text, or r, g, b.
    """
    if burst:
        return cells.withColumn("channel", F.col("band").cast("string"))
    if chosen is None:
        chosen = (0, 1, 2) if n_bands in (3, 4) else (middle_band(n_bands) if n_bands > 1 else 0,)
    if len(chosen) not in (1, 3) or not all(0 <= b < n_bands for b in chosen):
        raise ValueError(f"{chosen} is neither one nor three of {n_bands} bands")
    if len(chosen) == 1:
        return cells.where(F.col("band") == chosen[0]).withColumn("channel", F.col("band").cast("string"))
    places = F.array(*[F.when(F.lit(b) == F.col("band"), F.lit(c)) for b, c in zip(chosen, "rgb", strict=True)])
    return cells.where(F.col("band").isin(list(chosen))).withColumn("channel", F.explode(F.array_compact(places)))


def middle_band(bands: int) -> int:
    return round(bands / 2)


def rgb(cells: DataFrame, by: list[str], chosen: tuple[int, int, int]) -> DataFrame:
    """One row for each pixel with the three chosen bands as r, g, b."""
    some = cells.where(F.col("band").isin(list(chosen)))
    return some.groupBy(*by).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(n) for b, n in zip(chosen, "rgb", strict=True)])


def bounds(cells: DataFrame, by: list[str], clip: tuple[float, float], value: str = "value") -> DataFrame:
    """(by, low, high): exact percentiles of the values that are not null, with linear interpolation; 0 means minimum and maximum.

    Where the pixels are whole numbers the bounds are cut to whole numbers, towards zero. No task holds the values of an image (see ``quantiles``). An
    image without values has no row.
    """
    found = quantiles.quantiles(cells, by, value, {"low": clip[0] / 100, "high": 1 - clip[1] / 100})
    if isinstance(cells.schema[value].dataType, IntegralType):
        found = found.withColumns({c: F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double") for c in ("low", "high")})
    return found


def normalized(value: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Values cut to low and high and stretched to ``to``; where those are equal nothing changes; null stays null."""
    cut = F.greatest(F.least(value, high), low)
    return F.when(value.isNull(), F.lit(None).cast("double")).when(high > low, (cut - low) / (high - low) * (to[1] - to[0]) + to[0]).otherwise(value)


def eight_bit(cells: DataFrame, by: list[str], clip: tuple[float, float] = (1.0, 1.0), value: str = "value") -> DataFrame:
    """``cells`` with the column byte: 0 to 255 between the bounds of each image, ties to the even number.

    Null values have a null byte; images without any value have no row.
    """
    limits = bounds(cells, by, clip, value)
    return cells.join(limits, by).withColumn("byte", F.rint(normalized(F.col(value), F.col("low"), F.col("high"), (0.0, 255.0))).cast("smallint")).drop("low", "high")


def filled_colour(byte: Column, colour: tuple[int, int, int] = (0, 255, 255)) -> Column:
    """struct<r, g, b>: grey, or the colour where there is no value."""
    return F.struct(*[F.coalesce(byte, F.lit(c).cast("smallint")).alias(n) for n, c in zip("rgb", colour, strict=True)])


def shrink_factor(longest: Column, limit: int) -> Column:
    """The smallest whole factor that brings the longest axis within the limit."""
    return F.ceil(longest / limit)


def shrunk(cells: DataFrame, by: list[str], factor: int, value: str = "value") -> DataFrame:
    """Means of squares of ``factor`` pixels."""
    squares = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("line", "sample")]
    return cells.groupBy(*by, *squares).agg(F.avg(value).alias(value))


def section(values: Column, start: int, stop: int) -> Column:
    """Elements start to stop of an array, before anything is decoded or scaled."""
    return F.slice(values, start + 1, stop - start)


def rows_of(cells: DataFrame, by: list[str], byte: str = "byte") -> DataFrame:
    """Lines as arrays again, samples in order."""
    return cells.groupBy(*by, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", byte))), lambda s: s[byte]).alias("samples"))
