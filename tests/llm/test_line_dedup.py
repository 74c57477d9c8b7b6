"""Line dedup against plain Python, before and after documents come and go; cuckoo filters against sets."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerylake.llm import line_dedup
from orrerylake.llm.line_dedup import CuckooFilter

WHITE = " \t\n\x0b\f\r"


def key(line):
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    return line if len(line) >= 20 else None


def plain(docs, least=3, against=None):
    """docs: {id: text}; (id, n_lines, n_dropped, text)."""
    held = defaultdict(set)
    for i, text in (docs if against is None else against).items():
        for line in (text or "").split("\n"):
            if key(line):
                held[key(line)].add(i)
    out = []
    for i, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def random_docs(n, seed, start=0):
    rng = random.Random(seed)
    shared = [f"This line number {k} stands in many documents" for k in range(12)] + ["x" * 19, "y" * 20, "é" * 19, "é" * 20, "short", ""]
    out = {}
    for i in range(start, start + n):
        lines = [rng.choice([rng.choice(shared), rng.choice(shared).upper(), f"\t{rng.choice(shared)} \r", f"own line of document {i} {rng.random()}"]) for _ in range(rng.randrange(0, 12))]
        out[i] = rng.choice(["\n".join(lines), "\n".join(lines * 2), "\n".join(lines), None if rng.random() < 0.2 else "z"])
    return out


def made(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def got(frame):
    return sorted((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.text) for r in frame.collect())


def filters_hold(index, docs):
    """Each shard's filter holds the repeated keys of its shard, and nothing else is counted in it."""
    repeated = index.references.where(F.col("n") >= index.least_docs).select(line_dedup._shard(index.shards), "k1").collect()
    by_shard = defaultdict(list)
    for r in repeated:
        by_shard[r.shard].append(r.k1)
    held = {r.shard: CuckooFilter(r.buckets, np.frombuffer(bytes(r.cells), np.uint16), r.n) for r in index.filters.collect()}
    for s, keys in by_shard.items():
        assert held[s].n == len(keys) and held[s].holds(np.array(keys, np.int64).view(np.uint64)).all()
        assert np.count_nonzero(held[s].cells) == len(keys)
    assert all(f.n == 0 for s, f in held.items() if s not in by_shard)


def test_build_insert_delete(spark):
    docs = random_docs(60, 1)
    index = line_dedup.build(made(spark, docs).repartition(3), shard_keys=4)
    assert index.shards > 1
    assert got(line_dedup.without_repeated(made(spark, docs), index)) == plain(docs)
    filters_hold(index, docs)

    more = docs | random_docs(40, 2, 60) | {500: "\n".join(f"A line that only now becomes frequent, number {i}" for i in range(50))}
    more |= {501: more[500], 502: more[500].lower()}
    index = line_dedup.insert(index, made(spark, {i: t for i, t in more.items() if i not in docs}))
    assert got(line_dedup.without_repeated(made(spark, more), index)) == plain(more)
    filters_hold(index, more)

    # The keepers of many lines go, and counts fall below the threshold.
    left = {i: t for i, t in more.items() if i % 3 and i != 502}
    index = line_dedup.delete(index, made(spark, {i: "" for i in more if i not in left} | {9999: ""}))
    assert got(line_dedup.without_repeated(made(spark, left), index)) == plain(left)
    filters_hold(index, left)

    # What is taken back leaves the index as if it had never been there.
    extra = random_docs(30, 3, 1000)
    undone = line_dedup.compacted(line_dedup.delete(line_dedup.insert(index, made(spark, extra)), made(spark, extra)))
    assert sorted(map(tuple, undone.references.collect())) == sorted(map(tuple, index.references.collect()))
    assert got(line_dedup.without_repeated(made(spark, left), undone)) == plain(left)
    filters_hold(undone, left)

    # New documents are held against the index without entering it.
    assert got(line_dedup.without_repeated(made(spark, extra), index, indexed=False)) == plain(extra, against=left)


def test_edges(spark):
    empty = made(spark, {})
    index = line_dedup.build(empty)
    assert got(line_dedup.without_repeated(empty, index)) == []
    line = "the same line in all documents"
    docs = {1: None, 2: "", 3: line, 4: line, 5: f"{line}\n" * 30_000, 6: "\n\n"}
    own = made(spark, docs).select("*", *[F.lit(1).alias(c) for c in ("doc", "keys", "lines", "n_lines", "k1", "shard", "cells")])
    kept = line_dedup.without_repeated(own, line_dedup.build(own))
    assert kept.columns == [*own.columns, "lines_"]
    assert sorted((r.doc_id, *r.lines_) for r in kept.collect()) == plain(docs)
    # Repeated rows count and lose alike; a null document is the smallest.
    rows = spark.createDataFrame([(7, line), (7, line), (None, line)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.lines.n_dropped) for r in line_dedup.without_repeated(rows, line_dedup.build(rows)).collect()) == [(0, 1), (7, 0), (7, 0)]
    nulls = spark.createDataFrame([(None, line)] * 3, "doc_id long, text string")
    assert [r.lines.n_dropped for r in line_dedup.without_repeated(nulls, line_dedup.build(nulls)).collect()] == [0, 0, 0]


def test_one_line_of_all_documents(spark):
    """A line in all documents is dealt to several parts, and one document keeps it."""
    docs = {i: f"All documents hold this very line\nand this one is document {i} only" for i in range(3000)}
    index = line_dedup.build(made(spark, docs))
    assert Counter(n for _, _, n, _ in got(line_dedup.without_repeated(made(spark, docs), index))) == {1: 2999, 0: 1}


@pytest.mark.parametrize("n", [1, 50, 5_000, 100_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, 100_000, np.uint64)
    held = CuckooFilter(CuckooFilter.buckets_for(n))
    half = n // 2
    assert held.insert(keys[:half]) and held.insert(keys[half:])
    assert held.holds(keys).all() and held.holds(others).mean() < 0.001
    held.delete(keys[:half])
    assert held.holds(keys[half:]).all() and held.n == n - half == np.count_nonzero(held.cells)
    assert held.holds(keys[:half]).sum() <= 2 + n // 500
    assert held.insert(keys[:half]) and held.holds(keys).all()


def test_cuckoo_filter_repeats_and_limits():
    held = CuckooFilter(16)
    key = np.array([12345], np.uint64)
    for _ in range(3):
        assert held.insert(key)
    held.delete(np.repeat(key, 2))
    assert held.holds(key).all() and held.n == 1
    held.delete(key)
    assert not held.cells.any()
    with pytest.raises(ValueError):
        held.delete(key)
    assert not CuckooFilter(4).insert(np.arange(1, 40, dtype=np.uint64) << np.uint64(50))  # too many
    assert not CuckooFilter(1 << 10).insert(np.repeat(key, 20))  # eight cells for one fingerprint
    with pytest.raises(ValueError):
        CuckooFilter(12)
