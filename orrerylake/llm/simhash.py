"""SimHash near-duplicates: pivot distance tables over blocked fingerprints.

Every distinct fingerprint gets its Hamming distances to a fixed table of pivots. Fingerprints which
agree on enough blocks of bits (pigeonhole: all pairs within the radius do) meet in a bucket; a pair is
discarded if any pivot distance differs by more than the radius (triangle inequality), and the rest is
verified bit by bit. A bucket only emits a spanning forest of its links, never all pairs.

``similar_texts`` goes further than two bits, to edited copies.

Buckets of more members than ``HOT_BUCKET`` take an exact way without pairs: fingerprints lie within a
radius of 2 exactly if they share a neighbour at distance 0 or 1, so each hot member names its 65 such
neighbours and all that name the same one are linked to the least of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged
from .components import components

SEED = 42
RADIUS = 2
#: Five blocks of bits; two differing bits leave three blocks equal at least.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
PIVOTS = 32
HOT_BUCKET = 128


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed integer; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; 0 for no words."""
    return majority(shingle_hashes(text, width))


def fingerprints(text: Column, width: int = 3) -> Column:
    """The fingerprint of each whole text, lower-cased for A-Z, as a long."""

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return F.pandas_udf(prints, "bigint")(text)


def pivots(n: int = PIVOTS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(seed + 1).integers(0, 2, n, dtype=np.uint64)


def pivot_distances(prints: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (n) to pivots (p), as an n x p table of bytes."""
    return np.bitwise_count(prints.view(np.uint64)[:, None] ^ table[None, :])


def bucket_links(keys: np.ndarray, prints: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: pairs of positions that form a forest of each bucket's links."""
    far = pivot_distances(prints, table).astype(np.int8)
    left, right = [], []
    ahead = 1
    at = np.flatnonzero(keys[1:] == keys[:-1])
    while len(at):
        close = at
        for half in (slice(0, 4), slice(4, None)):
            close = close[(np.abs(far[close, half] - far[close + ahead, half]) <= radius).all(axis=1)]
        real = close[np.bitwise_count((prints[close] ^ prints[close + ahead]).view(np.uint64)) <= radius]
        left.append(real)
        right.append(real + ahead)
        ahead += 1
        at = at[at + ahead < len(keys)]
        at = at[keys[at] == keys[at + ahead]]
    return spanning(np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)]))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that first join two parts: as connected as all of them, and fewer than there are members."""
    parent: dict[int, int] = {}
    keep = np.zeros(len(a), bool)

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return a[keep], b[keep]


def _block_keys(fp: Column) -> Column:
    """One key for each choice of blocks that must be equal, spread over 64 bits."""
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in chosen]) for k, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))])


def _neighbours(fp: Column) -> Column:
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)])


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp, long) at RADIUS or fewer differing bits.

    Not every link is emitted, but the links' connected components are those of all links.
    """
    table = pivots()
    keyed = staged(prints.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key")), "keys")
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > HOT_BUCKET).alias("hot")), "buckets")
    met = keyed.join(sizes, "key")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame({"key": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64)})
        for batch in chain(batches, [None]):
            now = rest if batch is None else pd.concat([rest, batch], ignore_index=True)
            keys, fps = now["key"].to_numpy(np.int64), now["fp"].to_numpy(np.int64)
            whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            rest = now.iloc[whole:]
            a, b = bucket_links(keys[:whole], fps[:whole], table, RADIUS)
            yield pd.DataFrame({"u": np.maximum(fps[a], fps[b]), "v": np.minimum(fps[a], fps[b])})

    cold = met.where("not hot").select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(forest, "u bigint, v bigint")
    hot = met.where("hot").select("fp").distinct().select("fp", F.explode(_neighbours(F.col("fp"))).alias("near"))
    star = hot.groupBy("near").agg(F.min("fp").alias("v"))
    return cold.unionByName(hot.join(star, "near").where("fp != v").select(F.col("fp").alias("u"), "v")).distinct()


def _fingerprint_classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_key, fp, root, component_id): one row per row of docs; root names the component among fingerprints."""
    rows = staged(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), fingerprints(F.col(text_col), width).alias("fp")), "prints")
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    linked = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    return _named(rows, distinct, linked, "fp")


def _named(rows: DataFrame, distinct: DataFrame, linked: DataFrame, node: str) -> DataFrame:
    """``rows`` with root and component_id: the least id (``distinct.first``) among the nodes of the component."""
    named = staged(linked.join(distinct, node).select(node, "root", "first"), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(node, "root", "component_id")
    whole = distinct.join(classes, node, "left").select(node, F.coalesce("root", node).alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(whole, node)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``docs``.

    fingerprint: long; component_id: the least id whose fingerprint is reachable by links of RADIUS or
    fewer bits. Null and empty texts have fingerprint 0 and are linked like any other; null ids keep
    their rows but never name a component (a component of null ids only has a null one); repeated rows
    and ids stay; an empty table gives an empty table. No other column of docs is read.
    """
    return _fingerprint_classes(docs, id_col, text_col, width).select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _one_of_each(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each component of ``classes`` (id, text_key, root).

    It is the one of the least id, null ids last; of rows with that id the one of the least hash of the text; of rows
    with equal ids and texts any one. Rows that share an id but belong to different components are all judged by themselves.
    """
    mark, key = free_name(docs, "_mark"), free_name(docs, "_key")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("text_key")))
    kept = classes.groupBy("root").agg(first.alias("k")).select(F.col("k.id").alias(mark), F.col("k.text_key").alias(key)).distinct()
    keyed = docs.withColumn(free_name(docs, "_text_key"), F.xxhash64(text_col))
    own = keyed.columns[-1]
    found = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(mark)) & (F.col(own) == F.col(key)), "left_semi")
    return found.dropDuplicates([id_col, own]).drop(own)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each component of fingerprints, chosen as in ``_one_of_each``. Null and empty texts are
    one component; an empty table stays empty; other columns may have any name.
    """
    return _one_of_each(docs, _fingerprint_classes(docs, id_col, text_col, width), id_col, text_col)


# ---------------------------------------------------------------- similar texts

SIMILARITY = 0.8
#: Keys of a text, and least hashes that make up each. Of two texts of similarity s, all LEASTS of a key agree with a chance
#: of s ** LEASTS; at 0.8 they share a key of BANDS with a chance of 0.998.
BANDS, LEASTS = 16, 5
#: Texts of one group that are compared at once; a group of more is compared block against block, in as many tasks.
TEXT_BLOCK = 1024
#: Keys that are sent to all tasks at most; more are joined by a shuffle.
SENT_KEYS = 2_000_000

_RNG = np.random.default_rng(5)
_TURNS = _RNG.integers(0, 1 << 62, BANDS * LEASTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * LEASTS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 62, (BANDS, LEASTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes, each made of LEASTS least values under other permutations; none for no hashes."""
    if not len(hashes):
        return np.zeros(0, "<i8")
    least = np.full(BANDS * LEASTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        least = np.minimum(least, (part[:, None] * _TURNS + _SHIFTS).min(axis=0))
    mixed = ((least.reshape(BANDS, LEASTS) ^ (least.reshape(BANDS, LEASTS) >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32)) ^ np.arange(BANDS, dtype=np.uint64)).view("<i8")


def sketch(text: str | None, width: int = 5) -> tuple[int, int, np.ndarray]:
    """(fingerprint, node, keys) of a text; texts with the same set of shingles have the same node."""
    hashes = shingle_hashes(text, width)
    distinct = np.unique(hashes)
    return majority(hashes), xxhash.xxh64_intdigest(distinct.tobytes(), SEED) - (1 << 63), band_keys(distinct)


def _sketch(text: Column, width: int) -> Column:
    def sketches(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t, width) for t in texts], columns=["fp", "node", "keys"])

    return F.pandas_udf(sketches, "fp bigint, node bigint, keys array<bigint>")(text)


def proposed_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between nodes (node, fp, keys) that may be similar texts, whatever the sizes of the groups.

    Nodes that share a key, or whose fingerprints link as in ``links``, are linked to the least of them; so a group makes a
    star for each key and no pairs.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").select("key", "v")
    by_key = keyed.join(least, "key").where("node != v").select(F.col("node").alias("u"), "v")
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "first")
    of_print = nodes.join(prints.where("first < last"), "fp").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(prints.select("fp"))
    ends = near.join(prints.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    by_print = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return by_key.unionByName(of_print).unionByName(by_print).distinct()


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, node, ...) with a key of more than ``block`` rows replaced by one for each two blocks of its rows.

    A row goes to all pairs of blocks that its own is in, so any two rows of a key still meet, and no key
    has many more than 2 x ``block`` rows.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    parts = staged(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")), "parts")
    if parts.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != own)
    pairs = F.transform(others, lambda q: F.xxhash64("key", F.least(own, q), F.greatest(own, q)))
    split = rows.join(parts, "key", "left").withColumn("key", F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)))
    return split.select(*rows.columns)


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, cut so that no key is in two pieces."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch["key"].to_numpy(np.int64)
        if held and held[-1]["key"].iloc[-1] == keys[-1] == keys[0]:
            held.append(batch)
            continue
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        whole = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
        held = [batch.iloc[last:]]
        if len(whole):
            yield whole
    if held:
        yield pd.concat(held, ignore_index=True)


def connecting(n: int, like: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions below ``n`` that form a forest of all that ``like(x, others)`` finds alike.

    Leaders take their likes out of what is left, so each two leaders were compared. Then every member outside
    the largest part is compared with all that it was not yet; no link within a part matters.
    """
    label, left, right = np.arange(n), [], []

    def meet(x: int, near: np.ndarray) -> None:
        parts, first = np.unique(label[near], return_index=True)
        new = parts != label[x]
        if new.any():
            left.extend([x] * int(new.sum()))
            right.extend(near[first[new]].tolist())
            label[np.isin(label, parts[new])] = label[x]

    free, leads = np.arange(n), np.zeros(n, bool)
    while len(free):
        x, free = int(free[0]), free[1:]
        leads[x] = True
        near = like(x, free)
        meet(x, free[near])
        free = free[~near]
    largest = int(np.bincount(label).argmax()) if n else 0
    largest = int(np.flatnonzero(label == largest)[0]) if n else 0
    followers = np.flatnonzero(~leads)
    for x in range(n):
        if label[x] != label[largest]:
            others = followers if leads[x] else np.arange(n)
            others = others[label[others] != label[x]]
            if len(others):
                meet(x, others[like(x, others)])
    return np.array(left, np.int64), np.array(right, np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of ``others`` have a Jaccard similarity of ``similarity`` or more with set x; sets hold no repeats."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    known, flat = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)

    def like(x: int, others: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(known), np.int64)
        mark[flat[starts[x] : ends[x]]] = 1
        upto = np.concatenate([[0], np.cumsum(mark[flat])])
        shared = (upto[ends] - upto[starts])[others]
        return (shared > 0) & (shared >= similarity * (sizes[x] + sizes[others] - shared) - 1e-9)

    return like


def _shingle_set(text: Column, width: int) -> Column:
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).view("<i8") for t in texts], dtype=object)

    return F.pandas_udf(sets, "array<bigint>")(text)


def exact_links(candidates: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between the candidates (node, root, text_key) of one root whose sets of shingles are alike.

    The Jaccard similarity is counted on the sets themselves, and between all texts of a root. Their components
    are those of all such links. ``text_key`` is the xxhash64 of a node's text, by which docs is read again.
    """
    keyed = _in_blocks(candidates.select(F.col("root").alias("key"), "node"), TEXT_BLOCK)
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    keys = candidates.select("text_key").distinct()
    if candidates.count() <= SENT_KEYS:  # 16 MB of keys at most; the texts of all others need not be shuffled
        texts = texts.join(F.broadcast(keys), "text_key", "left_semi")
    once = texts.dropDuplicates(["text_key"]).join(candidates, "text_key").select("node", "text")
    met = keyed.join(once.select("node", _shingle_set(F.col("text"), width).alias("shingles")), "node").select("key", "node", "shingles")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for now in _whole_keys(batches):
            keys, nodes, sets = now["key"].to_numpy(np.int64), now["node"].to_numpy(np.int64), now["shingles"].tolist()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
            left, right = [], []
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                a, b = connecting(end - start, alike(sets[start:end], similarity))
                left.append(nodes[a + start])
                right.append(nodes[b + start])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return met.repartition("key").sortWithinPartitions("key").mapInPandas(forest, "u bigint, v bigint").distinct()


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(id, node, component_id) for each row: classes of texts whose sets of shingles have ``similarity`` or more.

    Unlike ``near_duplicates``, which finds all pairs within two bits, this reaches the distances of edited copies. Fingerprints
    within two bits, by pivot tables, and shared least hashes propose groups, which hold a pair at a similarity of 0.8 with a
    chance of 0.998 and closer ones almost surely; the Jaccard similarity, counted exactly, decides. Nulls, ties and empty
    tables are treated as there.
    """
    return _similar_classes(docs, id_col, text_col, width, similarity).select(F.col("id").alias(id_col), "node", "component_id")


def _similar_classes(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, text_key, node, root, component_id): one row per row of docs."""
    held = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _sketch(F.col(text_col), width).alias("s"))
    rows = staged(held.select("id", "text_key", "s.*"), "sketches")
    distinct = staged(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("id").alias("first"), F.min("text_key").alias("text_key")), "distinct")
    proposed = components(proposed_links(distinct.select("node", "fp", "keys")))
    candidates = staged(proposed.join(distinct.select("node", "text_key"), "node"), "candidates")
    linked = components(exact_links(candidates, docs, text_col, width, similarity))
    return _named(rows.select("id", "text_key", "node"), distinct.select("node", "first"), linked, "node")


def drop_similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of similar texts, chosen as in ``_one_of_each``."""
    return _one_of_each(docs, _similar_classes(docs, id_col, text_col, width, similarity), id_col, text_col)
