"""Work on rows of small tables is dealt to tasks by the number of rows, not by the table's files."""

import pytest
from pyspark.sql import functions as F

from orrerylake.jobs import archive_queries, format_queries, label_queries, registry
from orrerylake.jobs.register import SORT_ROWS, TASK_ROWS, spread
from orrerylake.sources import made

from .conftest import SF_MID

LARGER = "/root/testdata/sf0.1"


def test_labels_go_to_as_many_tasks_as_they_need(spark):
    for labels in (label_queries._labels(spark, LARGER), format_queries._table_labels(spark, LARGER)):
        sizes = labels.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) == 4 and sum(sizes) == 20_000 and max(sizes) < 1.1 * TASK_ROWS


def test_metadata_needs_no_other_shuffle(spark):
    for name in ("m2_blocks", "m3_metadata", "m6_key_counts", "m8_metablock", "m10_identifiers"):
        plan = registry.QUERIES[name](spark, LARGER)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == (2 if name == "m8_metablock" else 1), name


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "k int")
    assert spread(empty, "k").collect() == []
    assert sorted(map(repr, spread(spark.createDataFrame([(None,), (1,), (1,)], "k int"), "k", 1).collect())) == ["Row(k=1)", "Row(k=1)", "Row(k=None)"]


def test_orders_of_a_product_go_to_one_of_many_tasks(spark):
    parts = archive_queries._orders(spark, LARGER).select(F.floor(F.col("o_orderkey") / made.ORDERS_EACH).alias("p"), F.spark_partition_id().alias("at")).groupBy("p").agg(F.count_distinct("at").alias("n"), F.max("at").alias("at")).collect()
    assert {r.n for r in parts} == {1} and len({r["at"] for r in parts}) == 8


@pytest.fixture
def one_shuffle_partition(spark):
    """As where the tables have outgrown the session's number of partitions."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def rows_of_tasks(frame):
    return [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("at")).count().collect()]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_names_are_sorted_once_by_tasks_of_bounded_size(spark, one_shuffle_partition, monkeypatch):
    for most, tasks in ((SORT_ROWS, 4), (100_000, 6)):
        monkeypatch.setattr(format_queries, "SORT_ROWS", most)
        named = registry.QUERIES["f3_names"](spark, LARGER)
        sizes = rows_of_tasks(named)
        assert len(sizes) == tasks and sum(sizes) == 600_000 and max(sizes) < 1.1 * 600_000 / tasks
        plan = plan_of(named)
        assert (plan.count("Sort ["), plan.count("Exchange hashpartitioning")) == (1, 1)


def test_nested_names_are_dealt_by_their_number_in_one_shuffle(spark, one_shuffle_partition, monkeypatch):
    monkeypatch.setattr(format_queries, "SORT_ROWS", 40_000)
    named = registry.QUERIES["f13_nested_names"](spark, SF_MID)
    sizes = rows_of_tasks(named)
    assert len(sizes) == 14 and sum(sizes) == 60_000 and max(sizes) < 1.5 * 60_000 / 14
    # Orders and lines to meet, then customers' rows; no table is made twice.
    plan = plan_of(named)
    assert (plan.count("Exchange hashpartitioning"), plan.count("FileScan"), plan.count("Join [")) == (3, 2, 1)


def test_blocks_of_labels_meet_without_joins(spark):
    """Spark takes what is made of a narrow row for no larger than the row, so that a join would send the blocks of all labels through the driver."""
    plan = plan_of(registry.QUERIES["f1_label_blocks"](spark, LARGER))
    assert (plan.count("Join"), plan.count("Exchange"), plan.count("FileScan")) == (0, 1, 1)
