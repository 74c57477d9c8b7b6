"""Queries that write outputs from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.functions import binary
from orrerylake.sources import files, made, records

from . import ingest, sinks
from .register import query, table
from .scratch import new_folder


@query(sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def k1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV output for each nation, all of them read again as one table."""
    path = new_folder(spark, "csv")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    sinks.write_csv(customer.withColumn("output", sinks.output_name(F.lit("customer"), F.col("c_nationkey").cast("string"))), path, ["output"])
    return spark.read.schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, output string").option("header", "true").csv(path).drop("output")


@query(sql="SELECT p_brand, count(*) AS labels, 'label' AS kind, sum(length('PRODUCT_ID = \"P' || p_partkey || '\"') + 1 + length('NAME = ' || p_name) + 1 + length('END') + 1)::BIGINT AS bytes FROM part GROUP BY 1")
def s1_k2_texts_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as texts, a folder for each brand; a scan lists the files with their sizes, and their lines are counted."""
    path = new_folder(spark, "texts")
    label = made.text('PRODUCT_ID = "P', F.col("p_partkey"), '"\nNAME = ', F.col("p_name"), "\nEND")
    sinks.write_text(table(spark, sf_dir, "part").select("p_brand", label.alias("label")), path, "label", ["p_brand"])
    found = files.scan(spark, path, "*.txt").select(F.col("path"), F.col("length"))
    brand = F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)/", 1)))
    sizes = found.groupBy(brand.alias("p_brand")).agg(F.sum("length").alias("bytes"), F.first(files.file_kind(F.regexp_replace("path", "txt$", "lbl"))).alias("kind"))
    ends = spark.read.text(path).where("value = 'END'").groupBy("p_brand").agg(F.count("*").alias("labels"))
    return sizes.join(ends, "p_brand").select("p_brand", "labels", "kind", "bytes")


@query(sql="SELECT l_orderkey AS orderkey, CAST(l_linenumber AS SMALLINT) AS linenumber, 'lineitem' AS data_set, 'TABLE' AS object FROM lineitem")
def k4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files of records are ingested to the columnar store and read from it."""
    path, out = new_folder(spark, "records"), new_folder(spark, "store")
    record = F.concat(binary.integer_bytes(F.col("l_orderkey"), 8, "big"), binary.integer_bytes(F.col("l_linenumber"), 2, "little"))
    # Any bytes may be written as a text in an encoding of one byte each, here as lines of digits.
    table(spark, sf_dir, "lineitem").select(F.hex(record).alias("value")).write.text(path)
    lines = records.read_fixed_records(spark, path, 21).select(F.unhex(F.substring(F.decode("record", "US-ASCII"), 1, 20)).alias("record"))
    fields = [{"name": "orderkey", "kind": "integer", "order": "big", "start": 1, "width": 8, "is_signed": True}, {"name": "linenumber", "kind": "integer", "order": "little", "start": 9, "width": 2, "is_signed": True}]
    ingest.store_records(lines, fields, out, "lineitem", "TABLE")
    return spark.read.parquet(out)
