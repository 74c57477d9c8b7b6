"""Queries over images: embeddings are lines, their labels bands, positions samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.functions import vectorized
from orrerylake.operators import raster as R
from orrerylake.sources import files

from .register import query, table
from .scratch import new_folder
from .sinks import grey_map_lines, write_grey_maps


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("band"), F.col("vec_id").alias("line"), F.posexplode("embedding").alias("sample", "v")).select("band", "line", "sample", F.col("v").cast("double").alias("value"))


_CELLS = "(SELECT label AS band, vec_id AS line, i AS sample, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i))"


@query(sql="SELECT p_partkey, p_size AS rows, p_size + 1 AS columns, p_size % 3 + 1 AS bands, 4 AS bytes_per_pixel, CASE WHEN p_size % 3 > 0 AND p_size % 2 = 0 THEN 'several bands without a storage order' END AS error FROM part")
def i1_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    p = R.properties(n, n + 1, n % 3 + 1, F.lit(32), F.when(n % 2 == 1, R.ORDERS[0]))
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.rows", "p.columns", "p.bands", "p.bytes_per_pixel", "p.error")


@query(sql="SELECT p_partkey, p_size AS rows, 7 AS columns, 3 AS bands, CASE p_partkey % 3 WHEN 0 THEN 'BAND_SEQUENTIAL' WHEN 1 THEN 'LINE_INTERLEAVED' ELSE 'SAMPLE_INTERLEAVED' END AS \"order\", p_size // 4 AS prefix, p_size % 4 > 0 AS bad FROM part")
def i2_i3_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    names = F.when(k == 0, F.array(*map(F.lit, ("SAMPLE", "LINE", "BAND")))).when(k == 1, F.array(*map(F.lit, ("SAMPLE", "BAND", "LINE")))).otherwise(F.array(*map(F.lit, ("BAND", "SAMPLE", "LINE"))))
    size = {"SAMPLE": F.lit(7), "LINE": F.col("p_size"), "BAND": F.lit(3)}
    items = F.transform(names, lambda a: F.when(a == "SAMPLE", size["SAMPLE"]).when(a == "LINE", size["LINE"]).otherwise(size["BAND"]))
    pads = R.line_pads(F.col("p_size"), F.lit(8), F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", R.cube_properties(names, items).alias("c"), pads.alias("q")).select("p_partkey", "c.*", F.col("q.prefix").alias("prefix"), F.col("q.error").isNotNull().alias("bad"))


@query(
    sql="""
    SELECT l_orderkey, l_linenumber AS n, CASE WHEN n IN (1, 2, 3) THEN CAST(l_quantity AS INT) WHEN n = 7 THEN NULL ELSE 0 END AS back, CASE n WHEN 3 THEN NULL WHEN 4 THEN 2 ELSE 0 END AS side,
    CASE n WHEN 2 THEN 'pads of lines and planes together' WHEN 3 THEN 'planes are no whole number of pixels' WHEN 6 THEN 'pads of lines in bands that are not interleaved by line' WHEN 7 THEN 'planes without an order of axes' END AS error FROM lineitem
    """
)
def i3_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line stands for a cube: back planes, side planes, pads of lines, and what cannot be read of them."""
    n, none = F.col("l_linenumber"), F.array().cast("array<int>")
    axes = F.when(n < 7, F.array(*map(F.lit, R.AXES)))
    items = {"PREFIX": F.array(n.cast("int"), F.lit(0), F.lit(0)), "SUFFIX": F.array(F.lit(0), F.lit(0), F.col("l_quantity").cast("int"))}
    widths = F.map_from_arrays(F.concat(F.when(n.isin(1, 2, 3, 7), F.array(F.lit("BAND_SUFFIX"))).otherwise(none.cast("array<string>")), F.when(n.isin(3, 4), F.array(F.lit("SAMPLE_PREFIX"))).otherwise(none.cast("array<string>"))),
                               F.concat(F.when(n.isin(1, 2, 3, 7), F.array(F.array(F.lit(4)))).otherwise(F.array().cast("array<array<int>>")), F.when(n.isin(3, 4), F.array(F.array(F.lit(2)))).otherwise(F.array().cast("array<array<int>>"))))
    line = R.line_pads(F.when(n.isin(2, 5, 6), 8), F.lit(None).cast("int"), F.lit(4))
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), R.plane_pads(axes, items, widths, F.lit(4)).alias("p"), line.alias("q"))
    order = F.when(F.col("n") == 6, R.ORDERS[0]).otherwise(R.ORDERS[1])
    return held.select("l_orderkey", "n", F.col("p.after.bands").alias("back"), F.col("p.before.samples").alias("side"), R.pads_error(F.col("q"), F.col("p"), F.lit(3), order).alias("error"))


_PLACES = " UNION ALL ".join(
    f"SELECT '{o}' AS storage, vec_id, {b} AS band, {ln} AS line, {s} AS sample, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)"
    for o, b, ln, s in (("BSQ", "i // 16", "(i // 8) % 2", "i % 8"), ("BIL", "(i // 8) % 4", "i // 32", "i % 8"), ("BIP", "i % 4", "i // 32", "(i // 4) % 8"))
)


@query(sql=_PLACES)
def s15_i4_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as an image of 4 bands, 2 lines and 8 samples in each storage order, from its bytes."""
    raw = table(spark, sf_dir, "embeddings").select("vec_id", vectorized.bytes_of(F.col("embedding"), "ieee", 4, "big").alias("raw"))
    decoded = raw.select("vec_id", vectorized.array_of(F.col("raw"), "ieee", 4, "big").alias("values"))
    out = [R.pixels(decoded, "values", 2, 8, 4, o).withColumn("storage", F.lit(n)) for n, o in zip(("BSQ", "BIL", "BIP"), R.ORDERS, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("storage", "vec_id", "band", "line", "sample", "value")


@query(sql="SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[4:62]]), 6) AS image, CAST(embedding[1] AS DOUBLE) AS prefix, CAST(embedding[64] AS DOUBLE) AS suffix, CAST(embedding[11] AS DOUBLE) AS eleventh FROM embeddings")
def i5_i13_line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(R.line_part(v, 3, 2), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("image"), R.line_part(v, 3, 2, "prefix")[0].alias("prefix"), R.line_part(v, 3, 2, "suffix")[1].alias("suffix"), R.section(v, 10, 12)[0].alias("eleventh"))


@query(sql=f"SELECT band, count(*) AS n FROM {_CELLS} WHERE sample < 60 AND line < 100 AND band < 5 GROUP BY 1")
def i6_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_planes(_cells(spark, sf_dir), 60, 100, 5).groupBy("band").agg(F.count("*").alias("n"))


@query(sql=f"SELECT line % 50 AS row, sample, max(value) FILTER (band = 0) AS r, max(value) FILTER (band = 1) AS g, max(value) FILTER (band = 2) AS b FROM {_CELLS} WHERE band IN (0, 1, 2) GROUP BY ALL")
def i7_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("row", F.col("line") % 50)
    return R.rgb(cells, ["row", "sample"], (0, 1, 2))


_BOUNDS = f"(SELECT band, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM {_CELLS} GROUP BY 1)"


@query(sql=f"SELECT band, round(low, 9) AS low, round(high, 9) AS high FROM {_BOUNDS}")
def i8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bounds(_cells(spark, sf_dir), ["band"], (1.0, 1.0)).select("band", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(sql="SELECT l_returnflag, trunc(quantile_cont(CAST(l_partkey - 500 AS DOUBLE), 0.07)) AS low, trunc(quantile_cont(CAST(l_partkey - 500 AS DOUBLE), 0.93)) AS high FROM lineitem GROUP BY 1")
def i8_whole_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of whole pixels are whole."""
    cells = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_partkey") - 500).alias("value"))
    return R.bounds(cells, ["l_returnflag"], (7.0, 7.0))


@query(sql=f"SELECT band, line, sample, CAST(round_even((greatest(least(value, high), low) - low) / (high - low) * 255, 0) AS SMALLINT) AS byte FROM {_CELLS} JOIN {_BOUNDS} USING (band)")
def i9_i10_eight_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.eight_bit(_cells(spark, sf_dir), ["band"]).select("band", "line", "sample", "byte")


@query(sql=f"SELECT line, sample, CASE WHEN value < 0 THEN 0 ELSE 100 END AS r, CASE WHEN value < 0 THEN 255 ELSE 100 END AS g, CASE WHEN value < 0 THEN 255 ELSE 100 END AS b FROM {_CELLS}")
def i11_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.when(F.col("value") >= 0, F.lit(100).cast("smallint"))
    return _cells(spark, sf_dir).select("line", "sample", R.filled_colour(byte).alias("c")).select("line", "sample", "c.*")


@query(sql=f"SELECT band, line // 3 AS line, sample // 3 AS sample, round(avg(value), 9) AS value, 3 AS factor FROM {_CELLS} GROUP BY ALL")
def i12_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = R.shrunk(_cells(spark, sf_dir), ["band"], 3)
    return small.select("band", F.col("line").cast("bigint").alias("line"), F.col("sample").cast("bigint").alias("sample"), F.round("value", 9).alias("value"), R.shrink_factor(F.lit(64), 25).cast("int").alias("factor"))


_BYTES = """
    SELECT label, vec_id, i, CASE WHEN hi > lo THEN CAST(round_even((greatest(least(v, hi), lo) - lo) / (hi - lo) * 255.0 + 0.0, 0) AS BIGINT) ELSE CAST(round_even(v, 0) AS BIGINT) END AS byte
    FROM (SELECT *, quantile_cont(v, 0.01) OVER (PARTITION BY label) AS lo, quantile_cont(v, 0.99) OVER (PARTITION BY label) AS hi FROM (SELECT label, vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)))
"""


@query(
    sql=f"""
    SELECT label AS band, -1 AS line, 'P5' || chr(10) || '64 ' || count(*) || chr(10) || '255' || chr(10) AS head, NULL AS pixels FROM embeddings GROUP BY 1
    UNION ALL SELECT label, CAST(vec_id AS INTEGER), NULL, string_agg(printf('%02X', byte), '' ORDER BY i) FROM ({_BYTES}) GROUP BY 1, 2
    """
)
def k3_grey_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.rows_of(R.eight_bit(_cells(spark, sf_dir), ["band"]), ["band"])
    is_head = F.col("line") < 0
    return grey_map_lines(rows, ["band"]).select("band", "line", F.when(is_head, F.decode("content", "US-ASCII")).alias("head"), F.when(~is_head, F.hex("content")).alias("pixels"))


@query(
    sql=f"""
    SELECT 'image_scaled_' || label || '.pgm' AS file, count(DISTINCT vec_id) * 64 + length('P5' || chr(10) || '64 ' || count(DISTINCT vec_id) || chr(10) || '255' || chr(10)) AS bytes,
    sha256(unhex(hex('P5' || chr(10) || '64 ' || count(DISTINCT vec_id) || chr(10) || '255' || chr(10)) || string_agg(printf('%02X', byte), '' ORDER BY vec_id, i))) AS content FROM ({_BYTES}) GROUP BY label
    """
)
def k3_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every band of the image as a file of its own, written in two phases and read back byte for byte."""
    path = new_folder(spark, "grey-maps")
    write_grey_maps(R.eight_bit(_cells(spark, sf_dir), ["band"]).withColumn("name", F.lit("image")), path, ["name"], "band", scaled=True)
    back = files.scan(spark, path, "*.pgm", with_content=True)
    return back.select(files.file_name(F.col("path")).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content"))


@query(sql=f"SELECT CASE WHEN sample >= 60 THEN 'side' WHEN line % 50 < 2 THEN 'bottom' WHEN band >= 8 THEN 'back' ELSE 'core' END AS part, count(*) AS n, round(sum(value), 6) AS total FROM {_CELLS} GROUP BY ALL")
def i6_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a cube with planes beside its samples, in front of its lines and behind its bands."""
    cells = _cells(spark, sf_dir).withColumn("line", F.col("line") % 50)
    return cells.groupBy(R.plane_of(60, 48, 8, (0, 2, 0)).alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(sql=f"SELECT ['r', 'g', 'b'][band + 1] AS channel, line - 10 AS line, sample - 5 AS sample, value FROM {_CELLS} WHERE band < 3 AND line BETWEEN 10 AND 399 AND sample BETWEEN 5 AND 20")
def i7_i13_browse_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section along two axes of the bands that a browse image of four bands shows."""
    shown = R.browse_bands(_cells(spark, sf_dir).where("band < 4"), 4)
    return R.cube_section(shown, lines=(10, 400), samples=(5, 21)).select("channel", "line", "sample", "value")
