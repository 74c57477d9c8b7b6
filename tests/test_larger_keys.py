"""Queries over tables whose keys are larger than those of the given ones, held against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrerylake.jobs import registry


def held(spark, folder, name, **tables):
    """Whether a query gives its SQL's rows over small tables of one's own."""
    db = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        db.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    wanted = db.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(folder)).select(*wanted.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted.fetchall()))
    return got


@pytest.mark.parametrize("least", [0, 65_530, 1 << 20, (1 << 40) - 3])
def test_bits_of_keys_of_any_size(spark, tmp_path, least):
    keys = list(range(least, least + 12))
    assert len(held(spark, tmp_path, "d7_bits", orders={"o_orderkey": list(range(13)), "o_custkey": [*keys, None]})) == 13
