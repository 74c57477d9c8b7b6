from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orrerylake.llm import quality_rules as Q
from orrerylake.llm import queries

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def plain_counts(text):
    """The definitions, word by word."""
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in BLANKS:
            words += [word] if word else []
            word = ""
        else:
            word += ch
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_query_equals_definitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rules = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rules and all(r.precision >= 0.9 for r in rules)
    caught = false = 0
    for r in queries.op5_quality_rules(spark, SF).collect():
        counts = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        full = dict(zip(Q.COUNTS, Q.count_text(texts[r.doc_id]), strict=True))
        x = np.array([[full[f] if f not in Q.RATIOS else full[Q.RATIOS[f][0]] / full[Q.RATIOS[f][1]] if full[Q.RATIOS[f][1]] else 0.0 for f in Q.FEATURES]])
        first = next((k for k, rule in enumerate(rules, 1) if rule.holds(x)[0]), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
        if r.doc_id in labels and not r.base_failed:
            caught += labels[r.doc_id] == 0 and not r.kept
            false += labels[r.doc_id] == 1 and not r.kept
    assert caught > 10 and false <= 2


def test_repeated_words_by_hand():
    w = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"]
    assert Q.repeated_words(w) == 0
    assert Q.repeated_words(w + w) == 16
    assert Q.repeated_words(w + [b"x"] + w) == 16
    assert Q.repeated_words([b"a"] * 9) == 9
    assert Q.repeated_words(w[:7] + [b"x"] + w[:7]) == 0
    assert Q.repeated_words([]) == 0


def test_learning():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(Q.FEATURES)))
    bad = (x[:, 1] > 0.8) & (x[:, 3] > 0.5) | (x[:, 5] < 0.05)
    rules = Q.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= r.holds(x)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.05 * hit.sum()
    assert Q.learn(x, np.zeros(2000, bool)) == Q.learn(x, np.ones(2000, bool)) == Q.learn(x[:0], bad[:0]) == []


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "word " * 100_000, 9), (3, "one two " * 30, 9), (3, "one two " * 30, 9), (4, " ".join(f"w{i}" for i in range(40)), 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rule int")
    got = Q.judge(docs, [])
    assert got.columns[:3] == ["doc_id", "text", "rule"]
    assert sorted((str(r.doc_id), r.kept) for r in got.collect()) == [("1", False), ("2", False), ("3", False), ("3", False), ("4", True), ("None", False)]
    labels = spark.createDataFrame([(None, 0), (1, None), (4, 1), (4, 0)], "doc_id bigint, quality int")
    assert Q.fit(docs, labels) == [] and Q.fit(docs, labels.where(F.lit(False))) == []
    assert Q.judge(docs.limit(0), []).count() == 0
