"""Phrase collocations against plain counting, with samples and bitmaps that fail on purpose."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerylake.llm import phrases


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return n, f


def plain(rows, least, top):
    n, f = counted(rows)
    held = {p: a for p, a in f.items() if a >= least and len(p[1]) >= 2}
    out = {}
    for (lang, p), a in held.items():
        if any(b >= a and lang == other and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in held.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["Of", "the", "state", "new", "york\t", "Été", "x\x00y", "z" * 30]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(0, 40)):
            text += rng.choice([rng.choice(words), "in new york city hall", rng.choice("abcdefgh")]) + rng.choice([" ", "  ", " ", "\t", ". ", "\n", "\x0b", ", "])
        out.append((rng.choice(["en", "de", None]), rng.choice([text, text, None, ""])))
    return out


def made(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("one_in", "lowered", "bits"), [(4, 0.5, phrases.FILTER_BITS), (3, 50.0, 1 << 16), (2, 0.1, 1 << 16), (10_000, 1.0, 1 << 15)])
def test_equals_plain_counting(spark, one_in, lowered, bits):
    """A sample that proposes too much, hardly anything, or nothing at all gives the same phrases."""
    rows = random_rows(250, 5)
    wanted = plain(rows, 12, 40)
    assert len({r[0] for r in wanted}) == 3
    assert got(phrases.collocations(made(spark, rows).repartition(3), least=12, top=40, one_in=one_in, lowered=lowered, filter_bits=bits)) == wanted


def test_each_frequent_phrase_is_counted_once(spark):
    rows = [("en" if a is None else a, b or "") for a, b in random_rows(200, 6)]
    n, f = counted(rows)
    found = phrases.frequent_phrases(made(spark, rows), 10, 4, 3.0, 1 << 15).where("k > 0").collect()
    assert len(found) == len({(r.lang, r.phrase) for r in found})
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in found} == {p: a for p, a in f.items() if a >= 10}


def test_bitmap_of_spark_and_numpy_agree(spark):
    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 500)
    bits = phrases._with(None, spark.createDataFrame([(int(h),) for h in hashes], "h long"), 1 << 17)
    held = phrases.Bitmap(bits)
    assert held.holds(hashes.view(np.uint64)).all()
    assert np.unpackbits(bits).sum() <= 1000
    others = np.random.default_rng(3).integers(0, 2**63 - 1, 500).view(np.uint64)
    assert held.holds(others).sum() < 10


def test_small_chunks(spark, monkeypatch):
    """By words and by hash, in many chunks of a task."""
    import pyarrow as pa

    rows = [("en", b or "") for _, b in random_rows(60, 8)]
    n, f = counted(rows)
    every = phrases.Bitmap(None)
    for texts in ([b.encode() for _, b in rows], [b.encode() for _, b in rows[:9]], [b""]):
        own, mine = counted([("en", t.decode()) for t in texts])
        out = pa.Table.from_batches(phrases._chunk("en", texts, every, None, every, range(1, 6), 3, True, True)).to_pylist()
        assert [r["n"] for r in out if r["n"] is not None] == [own["en"]]
        by_words, hashed = {}, {}
        for r in out:
            if r["phrases"] is not None:
                by_words |= dict(zip(r["phrases"].split("\n"), np.frombuffer(r["counts"], np.uint32).tolist(), strict=True))
            if r["hashes"] is not None:
                hashed |= dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), np.frombuffer(r["counts"], np.uint32).tolist(), strict=True))
        assert by_words == {" ".join(p): a for (_, p), a in mine.items()}
        assert sorted(hashed.values()) == sorted(mine.values())


def test_edges(spark):
    assert got(phrases.collocations(made(spark, []))) == []
    assert got(phrases.collocations(made(spark, [(None, None), ("en", ""), ("en", "a b")]))) == []
    # One long text, repeated rows, and columns named like the operator's own.
    rows = [("en", "to be or " * 20_000)] + [("en", "to be.")] * 50
    own = made(spark, rows).select("lang", "text", *[F.lit(1).alias(c) for c in ("k", "n", "phrase", "a", "h", "rank")])
    assert got(phrases.collocations(own)) == plain(rows, 100, 2000)
