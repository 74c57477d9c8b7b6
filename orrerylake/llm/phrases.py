"""Phrase collocations by Toivonen's method: a sample proposes, a full pass counts the proposals and their negative border.

Proposals live in a bitmap of fixed size. A pass counts a phrase where both its parts, without its last and without its first
word, are in the bitmap: these are the proposed phrases and those just outside. False hits of the bitmap only make a pass
count more. A frequent phrase outside the bitmap is a border failure: it joins, and a further pass counts what it opens. That pass
takes what it opens for proposed, too, up to the longest phrases, so it leaves nothing to be opened: all parts of a frequent
phrase are frequent, so each frequent phrase has been counted then.

Most of the border is rare, so it is counted by hashes first: tasks hand on packed arrays of hashes and counts, and a hash
whose sum is too small holds no frequent phrase. The next pass counts the others by their words, so no count rests on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bytes of text of one language that a task counts at once.
CHUNK_BYTES = 8 << 20
LONGEST = 5
#: Bits of the bitmap: 8 MiB, which is what a pass broadcasts, at any size of the corpus.
FILTER_BITS = 1 << 26
_PAGE = 1 << 15

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_SCHEMA = "shard int, hashes binary, phrases string, counts binary, lang string, n long"
_ARROW = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("phrases", pa.string()), ("counts", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])
#: Bytes of text whose hashes, about, one task sums up.
SHARD_BYTES = 16 << 20


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A hash's bits spread over all 64, the number of words in the lowest three."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) & np.uint64(0xFFFFFFFFFFFFFFF8) | np.uint64(k)


class Bitmap:
    """Two bits for each phrase, at places that its hash names; without bits it holds everything."""

    def __init__(self, bits: np.ndarray | None) -> None:
        self.bits = bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(hashes), bool)
        size = np.uint64(8 * len(self.bits))
        out = np.ones(len(hashes), bool)
        for half in (hashes >> np.uint64(3), hashes >> np.uint64(34)):
            at = (half & np.uint64(0x3FFFFFFF)) % size
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _chunk(lang: str, texts: list[bytes], now: Bitmap, before: Bitmap | None, wanted: Bitmap | None, levels: range, shards: int, by_hash: bool, totals: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one language's texts, packed: a row for each shard of the hashes.

    ``by_hash``: hashes and counts of those of the ``levels`` that ``now`` lets count and ``before`` did not. ``wanted``: phrases in it, a line each,
    and counts. ``totals``: the number of all words.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)  # lower() of bytes: A to Z only
    is_word = ~(_BLANK | _BREAK)[data]
    edges = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[is_word].tobytes())).dictionary_encode()
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    del data, is_word, edges, ends, starts

    word, names = words.indices.to_numpy(), words.dictionary
    seed = xxhash.xxh64_intdigest(lang.encode())
    word_hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
    hashed: list[tuple[np.ndarray, np.ndarray]] = []

    def row(**cells: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([cells], _ARROW)

    def by_shard(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield int(shard[one[0]]), one

    # Of each place where a phrase of k words begins: which one. Of each phrase: its hash, whether it is in the bitmaps, and the phrase of one word
    # less and the word that make it.
    at, ids, n = np.arange(len(word)), word.astype(np.int64), np.bincount(word, minlength=len(names))
    hashes, told = _mixed(word_hash, 1), np.full(len(names), before is None)
    made: list[tuple[np.ndarray, np.ndarray]] = []
    if totals:
        yield row(lang=lang, n=len(word))
    for k in range(1, levels[-1] + 1):
        if k > 1:
            # ``at`` ascends: a place's suffix is the phrase that begins one word later, if that was counted.
            follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (piece[at[1:]] == piece[at[:-1]]))
            left, right = ids[follows], ids[follows + 1]
            both = is_in[left] & is_in[right]
            follows, left, right = follows[both], left[both], right[both]
            if not len(follows):
                break
            last = word[at[follows] + k - 1].astype(np.int64)
            ids, pair = pd.factorize(left * len(names) + last)
            n = np.bincount(ids)
            told = np.ones(len(pair), bool)
            if before is not None:  # not counted before: that both parts were counted and in the old bitmap is the same at every place of a phrase
                told[ids] = ~(was_in[left] & was_in[right])
            made.append((pair // len(names), pair % len(names)))
            hashes = _mixed(hashes[made[-1][0]] * np.uint64(0x9E3779B97F4A7C15) + word_hash[made[-1][1]], k)
            at = at[follows]
        is_in = now.holds(hashes)
        if before is not None:
            was_in = before.holds(hashes) & ~told
            is_in |= told
        if by_hash and k in levels:
            which = np.flatnonzero(told)
            hashed.append((hashes[which], n[which]))
        if wanted is not None and len(which := np.flatnonzero(wanted.holds(hashes))):
            phrase, parts = which, []
            for lefts, lasts in reversed(made):
                parts.append(names.take(pa.array(lasts[phrase])))
                phrase = lefts[phrase]
            texts_ = pc.binary_join_element_wise(names.take(pa.array(phrase)), *reversed(parts), " ")
            for shard, one in by_shard(hashes[which]):
                yield row(shard=shard, lang=lang, phrases="\n".join(texts_.take(pa.array(one)).to_pylist()), counts=n[which][one].astype(np.uint32).tobytes())
    if hashed and sum(len(h) for h, _ in hashed):
        found, n = (np.concatenate([p[i] for p in hashed]) for i in (0, 1))
        for shard, one in by_shard(found):
            yield row(shard=shard, hashes=found[one].tobytes(), counts=n[one].astype(np.uint32).tobytes())


def _sent(of: DataFrame, value: object, sent: list[Broadcast] | None) -> Broadcast:
    """``value`` on all executors; ``sent`` takes note of it, for its owner to take it back."""
    out = of.sparkSession.sparkContext.broadcast(value)
    if sent is not None:
        sent.append(out)
    return out


def _counted(docs: DataFrame, now: np.ndarray | None, before: np.ndarray | None, wanted: np.ndarray | None, levels: range, shards: int, by_hash: bool = True, totals: bool = False, sent: list[Broadcast] | None = None) -> DataFrame:
    """What ``_chunk`` gives, of all tasks of (lang, text)."""
    held = _sent(docs, (now, before, wanted), sent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = held.value
        asked = (Bitmap(maps[0]), *[None if m is None else Bitmap(m) for m in maps[1:]], levels, shards, by_hash, totals)
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        held_bytes = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                texts.setdefault(lang, []).append(text.as_py())
                size = len(texts[lang][-1]) + 1
                sizes[lang] = sizes.get(lang, 0) + size
                held_bytes += size
                if held_bytes >= CHUNK_BYTES:
                    largest = max(sizes, key=sizes.get)
                    held_bytes -= sizes.pop(largest)
                    yield from _chunk(largest, texts.pop(largest), *asked)
        for lang, own in texts.items():
            yield from _chunk(lang, own, *asked)

    return docs.mapInArrow(count, _SCHEMA)


def _summed_phrases(counted: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, n) of the phrases that reach ``least``: each shard's packed rows are unpacked and summed in one task."""

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        n: dict[tuple[str, str], int] = {}
        for lang, phrases, counts in zip(group["lang"], group["phrases"], group["counts"], strict=True):
            for phrase, c in zip(phrases.split("\n"), np.frombuffer(counts, np.uint32).tolist(), strict=True):
                n[lang, phrase] = n.get((lang, phrase), 0) + c
        held = [(lang, phrase.count(" ") + 1, phrase, c) for (lang, phrase), c in n.items() if c >= least]
        return pd.DataFrame(held, columns=["lang", "k", "phrase", "n"])

    return counted.where("phrases IS NOT NULL").select("shard", "lang", "phrases", "counts").groupBy("shard").applyInPandas(summed, "lang string, k int, phrase string, n long")


def _frequent_hashes(counted: DataFrame, least: int, now: np.ndarray | None, sent: list[Broadcast] | None = None) -> DataFrame:
    """(h, failed): hashes whose counts reach ``least``, and whether the bitmap lacks one that could open longer phrases."""
    held = _sent(counted, now, sent)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(group["hashes"]), np.uint64)
        n = np.frombuffer(b"".join(group["counts"]), np.uint32)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        many = np.add.reduceat(n[order].astype(np.int64), first) >= least
        h = h[first][many]
        failed = np.zeros(len(h), bool) if held.value is None else ~Bitmap(held.value).holds(h) & ((h & np.uint64(7)) < LONGEST)
        return pd.DataFrame({"h": h.view(np.int64), "failed": failed})

    return counted.where("hashes IS NOT NULL").select("shard", "hashes", "counts").groupBy("shard").applyInPandas(summed, "h long, failed boolean")


def _with(bits: np.ndarray | None, phrases: DataFrame, size: int) -> np.ndarray:
    """The bitmap with the places of all ``phrases`` (h) set. Spark makes its pages; their number is bounded by the bitmap's size."""
    mask = F.lit(0x3FFFFFFF).cast("long")
    places = F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(mask) % size for s in (3, 34)])
    at = phrases.select(F.explode(places).alias("at"))
    pages = at.groupBy(F.floor(F.col("at") / _PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("at") % _PAGE).cast("long")).alias("bits"))
    out = np.zeros(size // 8, np.uint8) if bits is None else bits.copy()
    for r in pages.collect():
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        part = out[int(r["page"]) * _PAGE // 8 : (int(r["page"]) + 1) * _PAGE // 8]
        part |= page[: len(part)]
    return out


def frequent_phrases(docs: DataFrame, least: int = 100, one_in: int = 4, lowered: float = 0.35, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of up to five words that occur ``least`` times in their language, and k = 0: all its words.

    ``docs``: lang, text, without nulls. One row in ``one_in`` is in the sample, drawn by a hash of the row's place;
    ``lowered``: the share of the expected count that makes a phrase of the sample a proposal. Neither the sample nor the size
    of the bitmap changes the result, only the number of passes and of phrases counted.
    """
    picked = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(one_in)) == 0
    sample = staged(docs.where(picked), "sample", "zstd")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    enough = max(1, int(least / one_in * lowered))
    sent: list[Broadcast] = []
    now = None
    for k in range(1, LONGEST):
        found = _frequent_hashes(_counted(sample, now, None, None, range(k, k + 1), 1 + size // SHARD_BYTES, sent=sent), enough, None, sent)
        now = _with(now, found, filter_bits)
    shards = 1 + one_in * size // SHARD_BYTES
    every = range(1, LONGEST + 1)
    found = staged(_frequent_hashes(_counted(docs, now, None, None, every, shards, sent=sent), least, now, sent), "hashes")
    failed = found.where("failed")
    closed = failed.isEmpty()
    opened = now if closed else _with(now, failed, filter_bits)
    counted = staged(_counted(docs, opened, now, _with(None, found, filter_bits), every, shards, by_hash=not closed, totals=True, sent=sent), "phrases")
    parts = [_summed_phrases(counted, least)]
    more = None if closed else staged(_frequent_hashes(counted, least, None, sent), "hashes")
    if more is not None and not more.isEmpty():
        parts.append(_summed_phrases(_counted(docs, opened, now, _with(None, more, filter_bits), every, shards, by_hash=False, sent=sent), least))
    totals = counted.where("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("k"), F.lit("").alias("phrase"), "n")
    # A phrase that a bitmap let through by mistake may have been counted twice, each time in full.
    frequent = reduce(DataFrame.unionByName, parts).groupBy("lang", "k", "phrase").agg(F.max("n").alias("n"))
    out = staged(frequent.unionByName(totals), "frequent")
    for held in sent:  # all that needed them is written
        held.unpersist()
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, one_in: int = 4, lowered: float = 0.35, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two to five words that hold together best.

    Pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs; A to Z are lower-cased. A phrase counts ``a`` times in
    pieces, overlaps included, and must reach ``least``; a cut gives floor(1000 a n / (l r)) with n words in the language and its
    parts' counts l and r, and the lowest cut is the score, of equal ones the first. A phrase inside a longer frequent one with
    the same count goes. The first ``top`` by score, count and phrase (UTF-8) stay. A null language is ``und``, a null text empty; a
    repeated row counts again; an empty table gives none; other columns play no part.
    """
    asked = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = frequent_phrases(asked, least, one_in, lowered, filter_bits)
    words = found.where("k = 0").select("lang", F.col("n"))
    counts = found.where("k > 0").select("lang", "k", "phrase", F.col("n").alias("a"))
    held = counts.where("k >= 2")

    cuts = held.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    joined = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(words, "lang")

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")).cast("long")
    cut = F.struct(score.alias("score"), "cut", "l", "r", "n")
    scored = joined.groupBy("lang", "k", "phrase", "a").agg(F.min(cut).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")

    # A longer phrase around this one that is as frequent has one of one word more inside it that is, too.
    parts = held.where("k >= 3").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    around = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    return r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
              FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
    n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY ALL),
    c AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
    cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS rest
             FROM (SELECT *, unnest(range(1, CAST(k AS BIGINT))) AS cut FROM c)),
    scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cut, h.a AS l, t.a AS r, CAST(n AS BIGINT) AS n, CAST(CAST(1000 AS HUGEINT) * cuts.a * n // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
               FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.rest JOIN n ON n.lang = cuts.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    whole AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM whole QUALIFY rank <= 2000
    """
