import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orrerylake.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_print(text):
    """The definition, bit by bit."""
    words = []
    for ch in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if ch:
            words.append(ch)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    """Least id reachable, by repeated passes over all pairs."""
    p = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= simhash.RADIUS
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(p))])
        if (new == label).all():
            return label
        label = new


def test_query_equals_brute_force(spark):
    rows = queries.op10_simhash_near_dedup(spark, SF).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = [plain_print(texts[r.doc_id]) for r in rows]
    assert [f"{p:016x}" for p in prints] == [r.fingerprint for r in rows]
    assert plain_components([r.doc_id for r in rows], prints).tolist() == [r.component_id for r in rows]


@pytest.mark.parametrize("hot", [4, 128])
def test_links_keep_all_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12)
    prints = set()
    for b in base.tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            x = b
            for f in flips.tolist():
                x ^= 1 << f
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {}
    for r in simhash.components(simhash.links(df)).collect():
        got[r.node] = r.root
    want = plain_components(prints, [p % (1 << 64) for p in prints])
    assert [got.get(p, p) for p in prints] == want.tolist()


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(7, None, "x"), (3, "", "x"), (None, "a b c d", "x"), (5, "A b C d", "y"), (5, "a b c d", "y"), (9, long, None), (8, long, None), (None, "q r s t u", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 5), (5, 5), (5, 5), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 5, 8, None], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.where(F.lit(False))).count() == 0


def test_rows_of_one_id_are_judged_by_themselves(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, 5, None), (1, two, 5, "x"), (2, one, 6, "y"), (None, two, 7, None), (None, None, 8, "z"), (1, two, 9, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _mark int, _key string")
    for drop in (simhash.drop_near_duplicates, simhash.drop_similar_texts):
        kept = drop(df)
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, one), (1, two), (None, None)], key=str)


def test_similar_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(60):
        body = rng.choice(words, 300).tolist()
        for k in range(1 + g % 4):
            copy = list(body)
            for at in rng.choice(300, 4, replace=False).tolist()[: 4 * (k > 0)]:
                copy[at] = "edited"
            rows.append((len(rows), " ".join(copy)))
            group[len(rows) - 1] = g
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    right = sum(r.component_id == first[group[r.doc_id]] for r in got)
    assert right >= 0.97 * len(rows)
    assert all(group[r.component_id] == group[r.doc_id] for r in got)


@pytest.mark.parametrize("hot", [3, 128])
def test_similar_texts_in_hot_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)] + [(100 + i, " ".join(f"y{i}z{j}" for j in range(50))) for i in range(20)]
    rows += [(None, "only here"), (None, "only here"), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.drop_similar_texts(df)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, *range(100, 120), None, 500], key=str)
    assert simhash.drop_similar_texts(df.limit(0)).count() == 0


def plain_classes(n, alike):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i], *[label[j] for j in range(n) if alike[i][j]]])
            changed |= least != label[i]
            label[i] = least
    return label


@pytest.mark.parametrize("seed", range(30))
def test_connecting_keeps_every_component(seed):
    """Chains past a leader, strangers and dense parts: the forest joins what all links join."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    alike = rng.random((n, n)) < rng.choice([0.01, 0.05, 0.3])
    alike |= alike.T
    a, b = simhash.connecting(n, lambda x, others: alike[x][others])
    assert len(a) < n and all(alike[x][y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    forest = np.zeros((n, n), bool)
    forest[a, b] = forest[b, a] = True
    assert plain_classes(n, forest) == plain_classes(n, alike)


@pytest.mark.parametrize("block", [5, 1000])
def test_chain_of_edits_in_one_group(spark, monkeypatch, block):
    """Each text is like the next one only, and all share a passage; strangers share it too."""
    monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join([f"e{i}" if i < 30 * k else w for i, w in enumerate(words)])))
    rows += [(100 + k, " ".join([*[f"s{k}x{i}" for i in range(300)], *words[300:350]])) for k in range(10)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    alike = [[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets]
    want = plain_classes(len(rows), alike)
    assert want[:12] == [0] * 12 and want[12:] == list(range(12, 22))
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]


def test_keys_find_pairs_at_the_similarity():
    """Recall of the proposals by similarity: 0.8 and above; the similarity itself is counted afterwards."""
    rng = np.random.default_rng(9)
    met = {0.8: [], 0.85: [], 0.9: []}
    for s in met:
        for _ in range(400):
            n = int(rng.integers(60, 400))
            shared = round(n * 2 * s / (1 + s))
            x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = simhash.band_keys(x[:n]), simhash.band_keys(x[n - shared :])
            met[s].append(bool((a == b).any()))
    assert np.mean(met[0.8]) > 0.985 and np.mean(met[0.85]) > 0.99 and np.mean(met[0.9]) > 0.995
    far = [bool((simhash.band_keys(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) == simhash.band_keys(rng.integers(0, 1 << 63, 300, dtype=np.uint64))).any()) for _ in range(200)]
    assert not any(far)


@pytest.mark.parametrize("block", [3, 1000])
def test_similarity_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "TEXT_BLOCK", block, raising=False)
    rng = np.random.default_rng(4)
    rows, alike = [], {}
    for g in range(300):
        body = [f"g{g}w{i}" for i in range(300)]
        copy = list(body)
        for at in rng.choice(300, rng.integers(4, 11), replace=False).tolist():
            copy[at] = f"g{g}edited{at}"
        sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in (body, copy)]
        alike[g] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * g, " ".join(body)), (2 * g + 1, " ".join(copy))]
    # A hundred copies of one text with an edit each: more than a block.
    rows += [(1000 + i, " ".join(f"x{i}" if j == 2 * i else f"b{j}" for j in range(250))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    met = {g: got[2 * g + 1] == 2 * g for g in alike}
    assert not [g for g in alike if alike[g] < 0.8 and met[g]]
    due = [g for g in alike if 0.8 <= alike[g] < 0.87]
    assert len(due) > 40 and sum(met[g] for g in due) >= 0.97 * len(due)
    assert all(got[1000 + i] == 1000 for i in range(100))
