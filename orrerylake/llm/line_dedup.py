"""Line dedup that can be taken back: exact reference counts of lines, and cuckoo filters of the repeated ones in front of them.

A line's key is its text without white space at its ends and with A to Z lower-cased, as a hash of 128 bits (BLAKE2b). The
index holds one row for each key and document (``holders``), the count of documents and the largest of them for each key
(``references``) and, for each shard of the keys, a cuckoo filter of those found in enough documents (``filters``). A line
that its filter does not know stays without a look at the exact table; the others are looked up there, so what a filter says
by mistake changes nothing. Documents can be added and deleted: counts are exact at any time, and filters lose a key again
when too few documents hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

BLANKS = b" \t\n\x0b\f\r"
#: Keys of at least so many code points, found in at least so many documents.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a shard, about, and the parts that a shard's lines are dealt to, so that no line of all documents fills one task.
SHARD_KEYS = 200_000
SALTS = 16
#: Cells of a bucket, fingerprints' bits, load at which a filter is made anew with twice the buckets, and rounds of moving on.
CELLS, BITS, MOST_LOAD, MOST_MOVES = 4, 16, 0.85, 500

_FILTER = "shard int, buckets long, n long, cells binary"


# --- cuckoo filters -----------------------------------------------------------------------------------------------


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, all operations on arrays of keys (uint64) at once.

    A key's fingerprint lies in one of two buckets, each of which follows from the other and the fingerprint. ``insert`` gives
    False where the filter is too full: then it must be made anew, from the exact table. Inserting a key twice needs two deletes.
    """

    def __init__(self, buckets: int, cells: np.ndarray | None = None, n: int = 0) -> None:
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.buckets, self.n = buckets, n
        self.cells = np.zeros((buckets, CELLS), np.uint16) if cells is None else cells.reshape(buckets, CELLS).copy()

    @staticmethod
    def buckets_for(n: int) -> int:
        return 1 << max(2, int(np.ceil(np.log2(max(n, 1) / CELLS / MOST_LOAD))))

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (keys >> np.uint64(64 - BITS)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark), (_spread(keys) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_spread(mark.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, one = self._marks(keys)
        two = self._other(one, mark)
        return (self.cells[one] == mark[:, None]).any(1) | (self.cells[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        if self.n + len(keys) > self.buckets * CELLS * MOST_LOAD and len(keys):
            return False
        mark, at = self._marks(keys)
        for turn in range(MOST_MOVES):
            if not len(mark):
                self.n += len(keys)
                return True
            # The first of a bucket's waiting marks, as many as it has room for, go in.
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            free = self.cells[at] == 0
            fits = rank < free.sum(1)
            place = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, CELLS - 1)]
            self.cells[at[fits], place[fits]] = mark[fits]
            mark, at, rank = mark[~fits], at[~fits], rank[~fits]
            if turn:
                # One that waits at each full bucket takes a cell, another one each turn, and who was there moves on to its other bucket.
                pushes = np.zeros(len(at), bool)
                pushes[np.unique(at, return_index=True)[1]] = True
                cell = (turn + at[pushes]) % CELLS
                out = self.cells[at[pushes], cell]
                self.cells[at[pushes], cell] = mark[pushes]
                mark[pushes] = out
            at = self._other(at, mark)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """One fingerprint of each key goes. Keys must have been inserted."""
        mark, one = self._marks(keys)
        two = self._other(one, mark)
        while len(mark):
            # Equal marks of the same buckets are many of one key, or keys that cannot be told apart: one of them a turn.
            pair = np.minimum(one, two) << BITS | mark.astype(np.int64)
            first = np.zeros(len(pair), bool)
            first[np.unique(pair, return_index=True)[1]] = True
            m, a, b = mark[first], one[first], two[first]
            in_a = (self.cells[a] == m[:, None]).any(1)
            bucket = np.where(in_a, a, b)
            hit = self.cells[bucket] == m[:, None]
            if not hit.any(1).all():
                raise ValueError("a key to delete is not in the filter")
            self.cells[bucket, hit.argmax(1)] = 0
            self.n -= int(first.sum())
            mark, one, two = mark[~first], one[~first], two[~first]


def _changed_filter(key: tuple, held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes; one that gets too full comes without cells."""
    filter_ = CuckooFilter(4) if held.empty else CuckooFilter(int(held["buckets"][0]), np.frombuffer(held["cells"][0], np.uint16), int(held["n"][0]))
    keys = changes["k1"].to_numpy(np.int64).view(np.uint64)
    up = changes["up"].to_numpy(bool)
    filter_.delete(keys[~up])
    fits = filter_.insert(keys[up])
    return pd.DataFrame({"shard": [key[0]], "buckets": [filter_.buckets], "n": [filter_.n], "cells": [filter_.cells.tobytes() if fits else None]})


def _new_filter(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["k1"].to_numpy(np.int64).view(np.uint64)
    buckets = CuckooFilter.buckets_for(len(keys))
    while not (filter_ := CuckooFilter(buckets)).insert(keys):
        buckets *= 2
    return pd.DataFrame({"shard": [key[0]], "buckets": [filter_.buckets], "n": [filter_.n], "cells": [filter_.cells.tobytes()]})


# --- lines and the index ------------------------------------------------------------------------------------------


def key_of(line: bytes) -> bytes | None:
    """The line's key of 16 bytes; None if it has too few code points."""
    line = line.strip(BLANKS).lower()  # of bytes: A to Z only
    if len(line) < LEAST_CHARS or len(line) < 4 * LEAST_CHARS and len(line.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, of = [], []
        for row, text in enumerate(batch.column(1).cast(pa.binary())):
            if text.is_valid:
                own = dict.fromkeys(map(key_of, text.as_py().split(b"\n")))
                own.pop(None, None)
                found += own
                of += [row] * len(own)
        words = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(words[:, 0])), pa.array(np.ascontiguousarray(words[:, 1])), batch.column(0).take(pa.array(of, pa.int64()))], names=["k1", "k2", "doc"])


def holders_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc): one row for each key of each row of ``docs``."""
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_keys, "k1 long, k2 long, doc long")


def _shard(shards: int) -> Column:
    # Not from the bits that choose a fingerprint or a bucket.
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """``holders``: k1, k2, doc; ``references``: k1, k2, n, keeper; ``filters``: shard, buckets, n, cells.

    All three rest on tables in the shared folder. A change writes new ones and harms no old one, so a job that is lost half-way
    leaves the index as it was. Holders are not copied: a change adds a table of added rows, or of documents gone, until ``compacted``.
    """

    holders: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index of all ``docs``. Each row counts as a document; null texts have no keys; an empty table gives an empty index."""
    holders = staged(holders_of(docs, key, text), "holders")
    references = staged(_counted(holders), "references")
    repeated = references.where(F.col("n") >= least_docs)
    shards = 1 + repeated.count() // shard_keys
    filters = staged(repeated.select(_shard(shards), "k1").groupBy("shard").applyInPandas(_new_filter, _FILTER), "filters")
    return LineIndex(holders, references, filters, shards, least_docs)


def _replaced(index: LineIndex, holders: DataFrame, references: DataFrame) -> LineIndex:
    """The index with other counts: filters learn what crossed the threshold, those that get too full are made anew."""
    least = index.least_docs
    before, after = (r.where(F.col("n") >= least).select("k1", "k2") for r in (index.references, references))
    up, down = after.join(before, ["k1", "k2"], "left_anti"), before.join(after, ["k1", "k2"], "left_anti")
    changes = up.withColumn("up", F.lit(True)).unionByName(down.withColumn("up", F.lit(False))).select(_shard(index.shards), "k1", "up")
    touched = changes.groupBy("shard").cogroup(index.filters.groupBy("shard"))
    changed = staged(touched.applyInPandas(lambda key, c, f: _changed_filter(key, f, c), _FILTER), "filters")
    full = changed.where("cells IS NULL").select("shard")
    anew = references.where(F.col("n") >= least).select(_shard(index.shards), "k1").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_new_filter, _FILTER)
    filters = staged(changed.where("cells IS NOT NULL").unionByName(anew), "filters")
    return LineIndex(holders, references, filters, index.shards, least)


def insert(index: LineIndex, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with more documents; a document that it holds counts again."""
    more = staged(holders_of(docs, key, text), "holders")
    sums = index.references.unionByName(_counted(more)).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return _replaced(index, index.holders.unionByName(more), staged(sums, "references"))


def delete(index: LineIndex, docs: DataFrame, key: str = "doc_id") -> LineIndex:
    """The index without the documents named; names that it does not hold change nothing. Only lines that these hold are counted anew."""
    gone = staged(docs.select(F.col(key).cast("long").alias("gone")).distinct(), "gone")
    is_gone = F.col("doc").eqNullSafe(F.col("gone"))
    left = index.holders.join(gone, is_gone, "left_anti")
    touched = staged(index.holders.join(gone, is_gone, "left_semi").select("k1", "k2").distinct(), "touched")
    anew = _counted(left.join(touched, ["k1", "k2"], "left_semi"))
    return _replaced(index, left, staged(index.references.join(touched, ["k1", "k2"], "left_anti").unionByName(anew), "references"))


def compacted(index: LineIndex) -> LineIndex:
    """The same index with its holders written as one table."""
    return replace(index, holders=staged(index.holders, "holders"))


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, k1, k2, doc, buckets, cells), those of lines that their shard's filter, which comes first, holds."""
    filters: dict[int, CuckooFilter] = {}
    for batch in batches:
        shard, cells = batch.column("shard").to_numpy(), batch.column("cells")
        for row in np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False)):
            buckets = batch.column("buckets")[int(row)].as_py()
            filters[int(shard[row])] = CuckooFilter(buckets, np.frombuffer(cells[int(row)].as_py(), np.uint16))
        keys = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
        hit = np.zeros(len(shard), bool)
        lines = cells.is_null().to_numpy(zero_copy_only=False)
        for s in np.unique(shard[lines]):
            mine = np.flatnonzero(lines & (shard == s))
            if int(s) in filters:
                hit[mine] = filters[int(s)].holds(keys[mine])
        yield batch.select(["k1", "k2", "doc"]).filter(pa.array(hit))


def repeated_lines(index: LineIndex, holders: DataFrame | None = None) -> DataFrame:
    """(doc, keys): the keys (binary) that each document loses: found in enough documents, of which it is not the largest.

    ``holders``: of the documents asked for (default: all in the index). Lines go to their shard in ``SALTS`` parts, each of which gets
    the shard's filter first; what it knows is looked up in the exact table. A null document counts as the smallest.
    """
    lines = (index.holders if holders is None else holders).select(_shard(index.shards), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"), "k1", "k2", "doc")
    dealt = index.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "buckets", "cells")
    both = lines.unionByName(dealt, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions(F.col("cells").isNull())
    known = both.select("shard", "k1", "k2", "doc", "buckets", "cells").mapInArrow(_probed, "k1 long, k2 long, doc long")
    exact = index.references.where(F.col("n") >= index.least_docs).select("k1", "k2", "keeper")
    lost = known.join(exact, ["k1", "k2"]).where(~F.col("keeper").eqNullSafe(F.col("doc")))
    return lost.groupBy("doc").agg(F.collect_set(F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("k1", "k2")])).alias("keys"))


def _kept(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, keys in texts:
        out = []
        for t, k in zip(text, keys, strict=True):
            lines = (t or "").encode().split(b"\n")
            if k is None or not len(k):
                out.append((len(lines), 0, t or ""))
                continue
            # Spark's numbers are printed from the high byte on, the key's were read from the low one.
            gone = {np.frombuffer(bytes(x), ">i8").astype("<i8").tobytes() for x in k}
            kept = [line for line in lines if key_of(line) not in gone]
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
        yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])


def without_repeated(docs: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text", indexed: bool = True) -> DataFrame:
    """``docs`` and struct ``lines`` (n_lines, n_dropped, text): the text without the lines that other documents keep.

    Lines end at line feeds. A line goes if its key of at least 20 code points is in at least ``least_docs`` documents of the index and
    this is not the largest that holds it; all its lines of the document go. A null or empty text is one empty line. A repeated
    row of a document keeps or loses the same lines. ``indexed``: whether ``docs`` are all in the index; if not, they are held against it
    as they are, and lines that others keep go. Columns of any name stay; ``lines`` takes a free name. Texts are shuffled once,
    by document.
    """
    name, doc = free_name(docs, "lines"), free_name(docs, "doc")
    lost = repeated_lines(index, None if indexed else holders_of(docs, key, text)).withColumnsRenamed({"doc": doc, "keys": free_name(docs, "keys")})
    joined = docs.join(lost, F.col(key).cast("long").eqNullSafe(F.col(doc)), "left")
    kept = F.pandas_udf(_kept, "n_lines long, n_dropped long, text string")
    return joined.withColumn(name, kept(F.col(text), F.col(free_name(docs, "keys")))).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def oracle_sql() -> str:
    return r"""
    WITH l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
    k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
    """
