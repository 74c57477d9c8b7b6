import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from orrerylake.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def verify(rows, texts, n_shards, balance):
    shards, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.tokens) == (len(raw) + 8, zlib.crc32(raw), len(raw.split()))
        shards[r.shard].append(r)
        homes[texts[r.doc_id] or ""].add(r.shard)
    assert set(shards) <= set(range(n_shards))
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for measure in (lambda r: r.size, lambda r: r.tokens, lambda r: 1):
        loads = [sum(map(measure, shards[s])) for s in range(n_shards)]
        assert max(loads) <= balance * sum(loads) / n_shards, loads
    return homes


def plain_packing(loads, left):
    """Largest group first, each to the bin of the highest dot product with what is left of it."""
    left, out = [list(x) for x in left], [None] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-max(loads[i]), i)):
        worth = [sum(a * b for a, b in zip(x, loads[i], strict=True)) for x in left]
        out[i] = worth.index(max(worth))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], loads[i], strict=True)]
    return out


def test_packing_equals_the_definition():
    rng = random.Random(1)
    for _ in range(60):
        # Sixteenths are exact in binary, so both ways add up to the same numbers.
        loads = [[rng.randrange(9) / 16 for _ in range(3)] for _ in range(rng.randrange(40))]
        left = [[rng.randrange(1, 65) / 16 for _ in range(3)] for _ in range(rng.randrange(1, 7))]
        assert sharding.pack(np.array(loads).reshape(-1, 3), np.array(left)).tolist() == plain_packing(loads, left)


def test_one_task_of_light_groups_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVY", 2.0)  # no group is placed before the others
    docs = spark.range(400).select("id", F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), (F.col("id") % 11 + 1).cast("int")).alias("text")).where("id != 7")
    rows = sharding.shard(docs, keep=["id", "text"], n_shards=4).collect()
    groups = sorted((hashlib.md5(r.text.encode()).digest(), r.size, r.tokens, r.shard) for r in rows)
    total = [sum(g[1] for g in groups), sum(g[2] for g in groups), len(groups)]
    turn = int.from_bytes(groups[0][0][:4], "big") % 4
    order = [(i - turn) % 4 for i in range(4)]
    loads = np.array([[g[1], g[2], 1] for g in groups]) / total
    at = sharding.pack(loads, np.full((4, 3), 0.25))
    assert [order[b] for b in at] == [g[3] for g in groups]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    homes = verify(rows, texts, 24, 1.15)
    assert all(len(s) == 1 for s in homes.values())


def test_many_tasks_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_GROUPS", 500)
    monkeypatch.setattr(sharding, "TASK_ROWS", 700)
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text again").otherwise(F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), (F.col("id") % 37 + 1).cast("int"))).alias("text"), F.lit("x").alias("_rid"), F.lit(5).alias("shard"), F.lit(6).alias("_key"), F.lit(7).alias("tokens")
    )
    got = sharding.shard(docs, keep=["doc_id", "_rid", "shard", "_key", "tokens"], n_shards=8)
    rows = got.collect()
    assert got.columns == ["doc_id", "_rid", "shard", "_key", "tokens", "size", "text_crc32", "tokens_", "shard_", "slot"]
    assert got.select("_rid", "shard", "_key", "tokens").distinct().count() == 1
    rows = got.drop("shard", "tokens").withColumnsRenamed({"shard_": "shard", "tokens_": "tokens"}).collect()
    homes = verify(rows, {r.doc_id: r.text for r in docs.collect()}, 8, 1.03)
    assert [t for t, s in homes.items() if len(s) > 1] == ["the same text again"]


def test_edge_cases(spark):
    long = "word " * 80_000
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a"), (4, long), (5, " \t\n ")], "doc_id bigint, text string")
    rows = sharding.shard(docs, keep=["doc_id"], n_shards=3).collect()
    assert sorted((r.size, r.tokens) for r in rows) == [(8, 0), (8, 0), (9, 1), (9, 1), (9, 1), (12, 0), (400_008, 80_000)]
    assert len({(r.shard, r.slot) for r in rows}) == 7
    assert sharding.shard(docs.limit(0), keep=["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    placed = sharding.shard(spark.range(50).select("id", F.col("id").cast("string").alias("text")), keep=["id", "text"], n_shards=4)
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.text) for r in back.collect()) == [(i, str(i)) for i in range(50)]
