"""Queries over special constants and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.functions import values
from orrerylake.operators import calibrate as C
from orrerylake.operators import formats as FM
from orrerylake.operators import corpus as Q
from orrerylake.sources import made

from .register import query, table


@query(sql="SELECT l_orderkey, l_linenumber, l_quantity * CASE l_returnflag WHEN 'A' THEN 2.0 ELSE 1.0 END + CASE l_returnflag WHEN 'R' THEN 3.0 ELSE 0.0 END AS value FROM lineitem")
def c1_scaled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors and offsets in a format table, joined by column name."""
    fmt = spark.createDataFrame([("A", 2.0, None), ("N", 0.0, 0.0), ("R", None, 3.0)], "l_returnflag string, factor double, offset double")
    joined = table(spark, sf_dir, "lineitem").join(F.broadcast(fmt), "l_returnflag", "left")
    return joined.select("l_orderkey", "l_linenumber", C.scaled(F.col("l_quantity"), F.col("factor"), F.col("offset")).alias("value"))


@query(sql="SELECT p_partkey, 'INVALID_CONSTANT' AS name, CAST(p_size AS DOUBLE) AS constant FROM part UNION ALL SELECT p_partkey, 'CORE_NULL', -32768.0 FROM part WHERE p_size % 2 = 0")
def c2_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(F.lit("INVALID_CONSTANT").alias("key"), made.text("(", F.col("p_size"), ", 0)").alias("value_raw")), F.struct(F.lit("CORE_NULL").alias("key"), F.when(F.col("p_size") % 2 == 0, "-32768").otherwise('"N/A"').alias("value_raw")), F.struct(F.lit("OTHER").alias("key"), F.lit("1").alias("value_raw"))]
    meta = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*rows)).alias("r")).select("p_partkey", "r.*")
    return C.explicit_constants(meta.withColumn("v", values.typed(F.col("value_raw"))).select("p_partkey", "key", "value_raw", "v.*"), "p_partkey")


_PIXELS = """
    SELECT event_id, event_type, CASE WHEN user_id % 10 = 0 THEN -32768 WHEN user_id % 10 = 1 AND event_type = 'click' THEN 32767 ELSE CAST(value AS BIGINT) END AS v FROM events
"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 10
    v = F.when(u == 0, -32768).when((u == 1) & (F.col("event_type") == "click"), 32767).otherwise(F.rint("value").cast("bigint"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", v.alias("v"))


#: Which constant of its type a value is, by the user's last digit; a click of digit 1 is another one, all else is plain.
_HELD = {"int16": (("N/A", "-32768"), ("UNK", "32767")), "int64": (("N/A", "-214743648"), ("UNK", "2147483647")), "float32": (("ISIS_LOW_INST_SAT", "-3.4028230607370965e38"), ("UNK", "1e32"))}


def _held_sql(kind: str, name: str, value: str, where: str) -> str:
    number = f"CAST(CAST({value} AS FLOAT) AS DOUBLE)" if kind == "float32" else f"CAST({value} AS DOUBLE)"
    return f"SELECT DISTINCT '{kind}' AS kind, event_type, '{name}' AS name, {number} AS constant FROM events WHERE {where}"


@query(sql=" UNION ALL ".join(_held_sql(k, *c, w) for k, cs in _HELD.items() for c, w in zip(cs, ("user_id % 10 = 0", "user_id % 10 = 1 AND event_type = 'click'"), strict=True)))
def c3_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 10
    found = []
    for kind, ((_, first), (_, second)) in _HELD.items():
        to = {"int16": "smallint", "int64": "bigint", "float32": "float"}[kind]
        v = F.when(u == 0, F.lit(first).cast(to)).when((u == 1) & (F.col("event_type") == "click"), F.lit(second).cast(to)).otherwise((F.col("value") % 1000 + 7).cast(to))
        found.append(C.implicit_constants(table(spark, sf_dir, "events").select("event_type", v.alias("v")), "event_type", "v", kind).select(F.lit(kind).alias("kind"), "event_type", "name", "constant"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(sql=f"SELECT event_id, CASE WHEN v IN (-32768, 32767) THEN NULL ELSE v * 2.0 - 1.0 END AS scaled FROM ({_PIXELS})")
def c4_c5_c9_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    found = C.constants_by_object(C.implicit_constants(pixels, "event_type", "v", "int16"), object_="event_type")
    return C.scaled_table(pixels, found, "event_type", "v", C.scale_factor(F.lit("2"), 1.0), C.scale_factor(F.lit("-1.0"), 0.0)).select("event_id", "scaled")


@query(sql="SELECT l_returnflag, CASE WHEN max(l_orderkey * m) <= 127 AND min(l_orderkey * m) >= -128 THEN 'int8' WHEN max(l_orderkey * m) <= 32767 AND min(l_orderkey * m) >= -32768 THEN 'int16' WHEN max(l_orderkey * m) <= 65535 AND min(l_orderkey * m) >= 0 THEN 'uint16' WHEN max(l_orderkey * m) <= 2147483647 AND min(l_orderkey * m) >= -2147483648 THEN 'int32' ELSE 'int64' END AS kind FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN -1 ELSE 1000000 END AS m FROM lineitem) GROUP BY 1")
def c6_d14_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "N", -1).otherwise(1_000_000)
    ranges = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * m).alias("v")).groupBy("l_returnflag").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ranges.select("l_returnflag", C.smallest_type(F.col("low"), F.col("high")).alias("kind"))


@query(sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (50, 1) THEN l_quantity ELSE l_quantity * 0.5 + 10 END AS value, CASE WHEN l_quantity IN (50, 1) THEN NULL ELSE l_quantity END AS masked FROM lineitem")
def c7_c8_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    special = C.is_constant(q, {"missing_constant": 50, "error_constant": 1, "valid_maximum": 49})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.scaled_around(q, special, F.lit(0.5), F.lit(10.0)).alias("value"), F.when(~special, q).alias("masked"))


@query(sql="SELECT event_type, min(value) FILTER (user_id % 10 > 1) AS low, max(value) FILTER (user_id % 10 > 1) AS high FROM events GROUP BY 1")
def c10_finite_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 10
    v = F.when(u == 0, float("inf")).when(u == 1, float("nan")).otherwise(F.col("value"))
    kept = table(spark, sf_dir, "events").select("event_type", F.when(C.finite(v), v).alias("v"))
    return kept.groupBy("event_type").agg(F.min("v").alias("low"), F.max("v").alias("high"))


@query(
    sql="""
    SELECT l_orderkey, l_linenumber, round(2.5 + l_linenumber * 0.5, 9) AS linear, round(2.0 * power(1.5, l_linenumber), 9) AS logarithmic, round(log10(power(10.0, 0.5) + l_linenumber * 2.0) / log10(10.0), 9) AS exponential,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 = 1 END AS fits FROM lineitem
    """
)
def d13_sampled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber")
    linear = FM.sampled_field(i, F.lit(2.5), F.lit(0.5))
    logarithmic = FM.sampled_field(i, F.lit(2.0), F.lit(1.5), "logarithmic")
    exponential = FM.sampled_field(i, F.lit(0.5), F.lit(2.0), "exponential")
    given = F.when(i % 3 == 1, linear * 1.0009).when(i % 3 == 2, linear * 1.002)
    rounded = [F.round(c, 9).alias(n) for c, n in ((linear, "linear"), (logarithmic, "logarithmic"), (exponential, "exponential"))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *rounded, FM.sampling_fits(linear, given).alias("fits"))


@query(sql="SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events GROUP BY 1")
def q1_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.described(table(spark, sf_dir, "events"), ["event_type"], "value")
    return d.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "max")


@query(sql="SELECT p_partkey, p_size * 1000000 AS cells, p_size > 20 AS large, greatest(CAST(ceil(p_size * 8000000.0 / 134217728) AS BIGINT), 1) AS tasks FROM part")
def q2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", Q.size_check(F.col("p_size"), F.lit(1_000_000), "delimited").alias("s")).select("p_partkey", "s.*")


@query(sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q3_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return Q.missing(table(spark, sf_dir, "customer").select("c_custkey"), loaded, ["c_custkey"])


@query(sql="SELECT 'o_custkey' AS \"column\", count(*) AS cells, count(*) FILTER (o_orderkey % 7 = 0) AS different FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (o_orderkey % 7 = 0 OR o_orderstatus = 'F') FROM orders")
def q4_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    other = orders.where("o_orderkey % 7 != 0").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    return Q.differences(orders, other, ["o_orderkey"], ["o_custkey", "o_orderpriority"])


@query(sql="SELECT 't' || p.p_partkey AS \"table\", 'i' || q.p_partkey AS image FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_size = q.p_size AND q.p_type = 'PROMO' AND p.p_type = 'SMALL'")
def q5_prefix_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "file", "p_size": "start_byte"})
    return Q.prefix_tables(part.where("p_type = 'SMALL'").select("file", "start_byte", made.text("t", F.col("p_partkey")).alias("table")), part.where("p_type = 'PROMO'").select("file", "start_byte", made.text("i", F.col("p_partkey")).alias("image")))


@query(sql="SELECT p_brand, p_type, sum(p_size) AS total FROM part GROUP BY ALL")
def k1_one_row_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row tables turned to (name, value), then summed back."""
    from .sinks import output_name, turned

    wide = table(spark, sf_dir, "part").select(output_name(F.col("p_brand"), F.col("p_type")).alias("file"), "p_size")
    rows = turned(wide.select(F.concat_ws("=", "file", F.col("p_size").cast("string")).alias("row")), ["row"])
    parts = F.split("value", "=")
    names = F.split(parts[0], "_")
    return rows.groupBy(names[0].alias("p_brand"), names[1].alias("p_type")).agg(F.sum(parts[1].cast("bigint")).alias("total"))


@query(sql="SELECT 'h' || p.p_partkey AS header, 'u' || q.p_partkey AS unit FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey * 10 + p.p_size = q.p_partkey * 10 + 5 AND p.p_size = 5")
def q6_unit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "file")
    headers = part.where("p_size = 5").select("file", made.text("h", F.col("p_partkey")).alias("header"), (F.col("p_partkey") * 10).alias("offset"), F.col("p_size").alias("length"))
    units = part.select("file", made.text("u", F.col("p_partkey")).alias("unit"), (F.col("p_partkey") * 10 + 5).alias("data_start"))
    return Q.unit_headers(headers, units)
