import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from orrerylake.llm import decontaminate as D
from orrerylake.llm import queries

SF = "/root/testdata/sf0.001"


def plain_search(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abcd", max_size=120))
def test_myers_equals_table(pattern, text):
    want = plain_search(pattern, text)
    got, _ = D.myers(D.masks(pattern), len(pattern), text, len(pattern) - 1)
    assert got == min(want, len(pattern))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=20, max_size=90), min_size=1, max_size=3), st.text("ab ", max_size=150), st.data())
def test_matcher_finds_all(items, text, data):
    # An edited copy of the first item stands in the text, so that there is something to find.
    copy = list(items[0])
    for k in data.draw(st.lists(st.integers(0, len(copy) - 1), max_size=9)):
        copy[k] = data.draw(st.sampled_from(["", "c", "ab"]))
    text += "".join(copy)
    got = {i: d for i, d, *_ in D.Matcher(list(enumerate(items))).find(text)}
    for i, item in enumerate(items):
        flat = D.plain(item)
        least = plain_search(flat, D.plain(text))
        if len(flat) >= D.LEAST_CHARS and least <= int(len(flat) * D.ERROR_RATE):
            assert got.get(i) == least
        elif 0 < len(flat) < D.LEAST_CHARS and re.search(rf"(?<!\w){re.escape(flat)}(?!\w)", D.plain(text)):
            assert got.get(i) == 0
        else:
            assert i not in got


def test_edited_passages(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "lnrst"]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    docs = []
    for d in range(300):
        body = rng.choices(words, k=300)
        if d % 3 == 0:
            item = list(items[d % 30][1].upper() if d % 2 else items[d % 30][1])
            for _ in range(d % 12):
                k = rng.randrange(len(item))
                item[k : k + rng.randrange(2)] = rng.choice("xyz")
            body[100:100] = "".join(item).replace(" ", "\n ", 3).split(" ")
        docs.append((d, " ".join(body), d))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, matches int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_chars in (2_000_000, 500):
        got = D.mark(df, bench, block_chars=block_chars).select("doc_id", "matches").collect()
        assert {r.doc_id: [m.item_id for m in r.matches] for r in got} == {d: [d % 30] if d % 3 == 0 else [] for d in range(300)}
    for r in got:
        for m in r.matches:
            part, item = D.plain(docs[r.doc_id][1][m.start : m.stop]), D.plain(items[m.item_id][1])
            assert plain_search(part, item) <= m.distance <= int(len(item) * D.ERROR_RATE)
    clean = D.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == [d for d in range(300) if d % 3]


def test_edge_cases(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 40_000 + item), (4, item), (4, item), (5, item[:-12])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "short")], "item_id bigint, text string")
    got = sorted([(r.doc_id, [m.item_id for m in r.matches]) for r in D.mark(docs, bench).collect()], key=str)
    assert got == sorted([(1, []), (2, []), (None, [1, 2]), (4, [1, 2]), (4, [1, 2]), (5, [])], key=str)
    assert D.mark(docs.limit(0), bench).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_short_items_and_clashing_names(spark):
    rows = [(1, "the answer is Blue  Whale.", 7, "a"), (2, "blue whales", 7, "b"), (3, " Blue\nwhale ", 7, "c"), (4, "nothing", 7, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, matches int, _matches_ string")
    bench = spark.createDataFrame([(1, "blue whale")], "item_id bigint, text string")
    got = {r.doc_id: [(m.start, m.stop, m.telling) for m in r.matches] for r in D.mark(docs, bench).collect()}
    assert got == {1: [(14, 25, False)], 2: [], 3: [(1, 11, True)], 4: []}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] != 3]


def test_query_finds_all_verbatim_items(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, SF).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {(d.doc_id, i.item_id) for d in docs for i in items if D.plain(i.text) in D.plain(d.text)} <= got
    sample = {d.doc_id: d.text for d in docs}
    flat = {i.item_id: D.plain(i.text) for i in items}
    for doc, item in got:
        assert plain_search(flat[item], D.plain(sample[doc])) <= int(len(flat[item]) * D.ERROR_RATE)
