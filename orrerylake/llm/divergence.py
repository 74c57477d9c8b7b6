"""Source divergence: how far the use of words of each source lies from the others of its language.

Terms are counted inside tasks without making a string of each: a term of up to eight bytes becomes one word of 64 bits,
one of up to sixteen two, and a radix sort brings equal ones together so that runs can be counted. Longer terms are sorted
as bytes, in buckets of about equal length. Spark sums the counts of all tasks and does the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bytes of text that a task sorts at once, and packed terms that it keeps before it hands them on.
CHUNK_BYTES = 8 << 20
MOST_KEPT = 1 << 20
#: Cells (terms by sources) that a task compares at once.
CELLS = 1 << 20

_IS_TERM = np.ones(256, bool)
_IS_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_SCHEMA = "lang string, source string, term string, n long, docs long"


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by unsigned integer keys, the last of them first in rank: one counting pass for each 16 bits that differ."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each term as one big-endian word, zeros behind its end. ``data`` has 16 bytes over."""
    every = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    held = np.clip(lengths - 8 * k, 0, 8)
    shift = np.minimum(64 - 8 * held, 63).astype(np.uint64)
    word = every[np.minimum(starts + 8 * k, len(data) - 8)].astype(np.uint64)
    return np.where(held > 0, word >> shift << shift, np.uint64(0))


def _sums(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, edges) if len(edges) else values[:0]


def _counted(group: np.ndarray, words: list[np.ndarray], doc: np.ndarray) -> list[np.ndarray]:
    """[group, words..., n, docs] of equal terms of a group; documents come in ascending order."""
    order = radix_order([*words[::-1], group])
    group, doc, *words = (a[order] for a in (group, doc, *words))
    new = np.ones(len(group), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in (group, *words)])
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    edges = np.flatnonzero(new)
    return [group[edges], *(w[edges] for w in words), np.diff(edges, append=len(group)), _sums(edges, new_doc.astype(np.int64))]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Several counts as one."""
    group, *words, n, docs = (np.concatenate(a) for a in zip(*parts, strict=True))
    order = radix_order([*words[::-1], group])
    group, n, docs, *words = (a[order] for a in (group, n, docs, *words))
    new = np.ones(len(group), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in (group, *words)])
    edges = np.flatnonzero(new)
    return [group[edges], *(w[edges] for w in words), _sums(edges, n), _sums(edges, docs)]


def _strings(raw: np.ndarray) -> pa.Array:
    """Rows of bytes, filled with zeros behind their ends, as texts. No term holds a zero."""
    held = raw != 0
    offsets = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(held.sum(1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets), pa.py_buffer(raw[held].tobytes()))


def _long_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, n, docs) of terms of over 16 bytes: buckets of lengths to the next multiple of 8, above 64 to the next power of 2."""
    room = np.where(lengths <= 64, -(-lengths // 8) * 8, 2 ** np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(room):
        width = int(width)
        mine = np.flatnonzero(room == width)
        wide = np.concatenate([data, np.zeros(width, np.uint8)])
        rows = np.ndarray((len(data),), f"S{width}", wide, strides=(1,))[starts[mine]]
        raw = rows.view(np.uint8).reshape(len(mine), width)
        raw *= np.arange(width) < lengths[mine, None]
        order = np.argsort(rows, kind="stable")
        order = order[radix_order([group[mine][order]])]
        rows, g, d = rows[order], group[mine][order], doc[mine][order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])
        new_doc = new.copy()
        new_doc[1:] |= d[1:] != d[:-1]
        edges = np.flatnonzero(new)
        yield g[edges], _strings(raw[order][edges]), np.diff(edges, append=len(rows)), _sums(edges, new_doc.astype(np.int64))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents; a term may come several times, each document counts in one of them."""
    names: dict[tuple[str, str], int] = {}
    kept: dict[int, list[list[np.ndarray]]] = {1: [], 2: []}

    def rows(group: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
        for at in range(0, len(group), 20_000):
            part = slice(at, at + 20_000)
            which = pa.array(group[part].astype(np.int64))
            yield pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), term[part], pa.array(n[part], pa.int64()), pa.array(docs[part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def handed_on(least: int) -> Iterator[pa.RecordBatch]:
        for k, parts in kept.items():
            if parts and sum(len(p[0]) for p in parts) > least:
                held = _merged(parts)
                kept[k] = [held]
                if len(held[0]) > least:
                    group, *words, n, docs = held
                    yield from rows(group, _strings(np.stack(words, 1).astype(">u8").view(np.uint8).reshape(len(group), 8 * k)), n, docs)
                    kept[k] = []

    def chunk(texts: list[bytes], groups: list[int]) -> Iterator[pa.RecordBatch]:
        joined = b"\n".join(texts).lower()  # of bytes: A to Z only
        data = np.frombuffer(joined + b"\n" * 16, np.uint8)
        edges = np.flatnonzero(np.diff(_IS_TERM[data].view(np.int8), prepend=np.int8(0)))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        doc = np.searchsorted(begins, starts, "right") - 1
        group = np.asarray(groups, np.uint32)[doc]
        for k in (1, 2):
            mine = np.flatnonzero((lengths > 8 * (k - 1)) & (lengths <= 8 * k))
            if len(mine):
                kept[k].append(_counted(group[mine], [_packed(data, starts[mine], lengths[mine], i) for i in range(k)], doc[mine]))
        longer = np.flatnonzero(lengths > 16)
        for found in _long_terms(data, starts[longer], lengths[longer], group[longer], doc[longer]) if len(longer) else ():
            yield from rows(*found)
        yield from handed_on(MOST_KEPT)

    texts: list[bytes] = []
    groups: list[int] = []
    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            texts.append(text.as_py())
            groups.append(names.setdefault((lang, source), len(names)))
            held += len(texts[-1])
            if held >= CHUNK_BYTES:
                yield from chunk(texts, groups)
                texts, groups, held = [], [], 0
    if texts:
        yield from chunk(texts, groups)
    yield from handed_on(0)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; null texts, languages and sources count as empty."""
    asked = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return asked.mapInArrow(_count_terms, _SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


#: p = 1 + floor(SCALE * (n + 2) / (total + 2 * terms)).
SCALE = 1_000_000_000


def share(n: Column, total: Column, terms: Column) -> Column:
    """A term's smoothed share of all occurrences, in billionths; exact, as 38 digits hold the product."""
    whole = [c.cast("decimal(19,0)") for c in (n + 2, total + 2 * terms)]
    return (1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole[0], whole[1])).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most a billion and one, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, i, j, value) for i < j: the gaps of a task's terms, summed for each two sources of a language."""
    sums: dict[str, np.ndarray] = {}

    def add(lang: str, at: list[list[int]], n: list[list[int]], totals: np.ndarray, terms: int) -> None:
        size = len(totals)
        cells = np.zeros((len(at), size), np.int64)
        cells[np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at).astype(np.int64)] = np.concatenate(n)
        if int(cells.max()) + 2 > (2**63 - 1) // SCALE:
            cells = cells.astype(object)  # Python's integers: exact at any size
        p = (1 + SCALE * (cells + 2) // (totals + 2 * terms)).astype(np.int64)
        held = sums.setdefault(lang, np.zeros((size, size), np.int64))
        for i in range(size - 1):
            one, others = p[:, i : i + 1], p[:, i + 1 :]
            held[i, i + 1 :] += ((one - others) ** 2 // (one + others)).sum(0)

    for batch in batches:
        held = batch.to_pydict()
        by_lang: dict[str, list[int]] = {}
        for row, lang in enumerate(held["lang"]):
            by_lang.setdefault(lang, []).append(row)
        for lang, mine in by_lang.items():
            totals = np.asarray(held["totals"][mine[0]], np.int64)
            step = max(1, CELLS // len(totals))
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                add(lang, [held["at"][r] for r in part], [held["n"][r] for r in part], totals, held["terms"][mine[0]])
    for lang, held in sums.items():
        for i in range(len(held) - 1):
            j = np.arange(i + 1, len(held))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(j), pa.string()), pa.array(np.full(len(j), i), pa.int32()), pa.array(j, pa.int32()), pa.array(held[i, i + 1 :])], names=["lang", "i", "j", "value"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance to every other one (part ``pair``),
    and the terms by which it stands out of the language (part ``term``, the first ``top`` only).

    Kept terms are those in at least ``least_docs`` documents of the language; p is a term's smoothed share, and the distance of two
    shares is floor((p - q)^2 / (p + q)). Ties go by item, in the order of its UTF-8 bytes. Null texts, languages and sources count as
    empty texts; a repeated row is a document of its own; a source without terms has every pair, too; an empty table gives an empty
    one. Other columns of ``docs`` play no part. A language with one source has no pair. Rows of part ``pair`` are as many as the
    ordered pairs of a language's sources; nothing else that is made grows faster than terms by sources.
    """
    groups = docs.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).agg(F.count("*").alias("docs"))
    groups = staged(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")
    counts = term_counts(docs, text, lang, source).join(groups.select("lang", "source", "at"), ["lang", "source"])
    cell = F.struct("at", "n")
    every = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(cell).alias("cells")).where(F.col("docs") >= least_docs)
    kept = staged(every.select("lang", "term", "cells"), "terms")

    totals = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.at").alias("at")).agg(F.sum("c.n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    whole = groups.join(totals, ["lang", "at"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    in_order = F.array_sort(F.collect_list(F.struct("at", "source", "total")))
    langs = staged(whole.groupBy("lang").agg(in_order.alias("s"), F.max("terms").alias("terms")).select("lang", "terms", F.col("s.source").alias("sources"), F.col("s.total").alias("totals")), "languages")

    # Each two sources: sums by task, then of all tasks.
    rows = kept.join(langs.select("lang", "terms", "totals"), "lang").select("lang", F.col("cells.at").alias("at"), F.col("cells.n").alias("n"), "totals", "terms")
    sums = rows.mapInArrow(_pair_sums, "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "value").select("lang", "p.*", "value")
    one = groups.select("lang", F.col("at").alias("i"), "source")
    other = groups.select("lang", F.col("at").alias("j"), F.col("source").alias("item"))
    pairs = one.join(other, "lang").where("i != j").join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    # Terms: a source's share beside the language's.
    in_lang = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    total = F.aggregate("totals", F.lit(0).cast("long"), lambda s, n: s + n)
    each = kept.join(langs, "lang").select("lang", "term", "terms", "sources", "totals", share(in_lang, total, F.col("terms")).alias("q"), F.explode("cells").alias("c"))
    p = share(F.col("c.n"), F.get("totals", F.col("c.at")), F.col("terms"))
    out = each.withColumn("p", p).where("p > q").select("lang", F.get("sources", F.col("c.at")).alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(ranked)


def oracle_sql() -> str:
    return r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
    p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // CAST(total + 2 * v AS HUGEINT) AS BIGINT) AS p
          FROM kept JOIN g USING (lang) LEFT JOIN c USING (lang, source, term)),
    q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // CAST(any_value(total) + 2 * any_value(v) AS HUGEINT) AS BIGINT) AS q
          FROM p JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY ALL) USING (lang) GROUP BY ALL),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
    """
