"""Source divergence against plain Python, and the packed counting against a counter."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrerylake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    rows = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        held = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in held.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if held[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, rank + 1) for rank, (v, _, item) in enumerate(items)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["a", "The", "ÉTÉ", "straße", "eightchr", "ninechars", "sixteencharacter", "seventeencharsxxx", "語" * 5, "語" * 6, "x" * 70, "don't", "Z9z"]
    return [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "é", None]), rng.choice(["", None, " ".join(rng.choices(words, k=rng.randrange(1, 30)))])) for _ in range(n)]


def test_equals_plain_counting(spark, monkeypatch):
    rows = random_rows(150, 7) + [("en", "s1", "the " * 50_000)]
    wanted = plain(rows)
    assert {r[2] for r in wanted} == {"pair", "term"}
    assert got(divergence.audit(made(spark, rows).repartition(3))) == wanted


def test_chunks_give_the_same(monkeypatch):
    """In one process: small chunks and small memory, so that counts are merged and handed on many times."""
    import pyarrow as pa

    rows = [(a or "", b or "", c or "") for a, b, c in random_rows(200, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = TERM.findall(lowered(text))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, source, t) for t in set(terms))
    for chunk, kept in ((1, 1), (300, 5), (1 << 20, 1 << 20)):
        monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(divergence, "MOST_KEPT", kept)
        seen_n, seen_docs = Counter(), Counter()
        for out in divergence._count_terms(iter([batch.slice(0, 90), batch.slice(90)])):
            for r in out.to_pylist():
                seen_n[r["lang"], r["source"], r["term"]] += r["n"]
                seen_docs[r["lang"], r["source"], r["term"]] += r["docs"]
        assert seen_n == n and seen_docs == docs


def test_counts_beyond_64_bits():
    """Shares of counts whose product with a billion exceeds 64 bits are exact."""
    import pyarrow as pa

    n = [10**12 + 7, 3]
    totals = [10**12 + 7, 3, 0]
    row = pa.RecordBatch.from_pylist([{"lang": "en", "at": [0, 1], "n": n, "totals": totals, "terms": 1}])
    p = [1 + 10**9 * (c + 2) // (t + 2) for c, t in zip([*n, 0], totals, strict=True)]
    found = {(r["i"], r["j"]): r["value"] for b in divergence._pair_sums(iter([row])) for r in b.to_pylist()}
    assert found == {(i, j): (p[i] - p[j]) ** 2 // (p[i] + p[j]) for i in range(3) for j in range(i + 1, 3)}


def test_radix_order():
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 9, 5000).astype(np.uint32)
    low[::3] = low[0]
    assert (divergence.radix_order([low, high]) == np.lexsort((low, high))).all()


def test_edges(spark):
    assert got(divergence.audit(made(spark, []))) == []
    rows = [(None, None, None), ("", "x", "")]
    assert got(divergence.audit(made(spark, rows))) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]
    # Ties go by the bytes of the item; columns of other names, and of the operator's own, change nothing.
    rows = [("en", s, "same words") for s in ("b", "a", "é", "Z") for _ in range(4)]
    own = made(spark, rows).selectExpr("doc_id", "lang", "source", "text", "1 as at", "2 as n", "3 as docs", "4 as term", "5 as terms", "6 as cells")
    assert got(divergence.audit(own)) == plain(rows)


@pytest.mark.parametrize("name", ["op12_source_divergence"])
def test_registered(name):
    from orrerylake.llm import queries

    assert name in queries.QUERIES and name in queries.ORACLE_SQL
