"""Token-id files compressed by Re-Pair.

Documents are encoded in ascending order of their ids, each ends with an end id, and shards of them are
compressed: frequent pairs of neighbouring symbols are replaced by new symbols, again and again, until no
pair is frequent. A file holds the rules, the length that each new symbol expands to, and the
documents' places, so that any document or any stretch of ids is decoded without the rest. No pair spans
two documents.

Files travel as a column of bytes in Parquet, so they are written through Spark's committer and survive lost
tasks, wherever the folder is.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 2
#: Ids of a file, about: a file is closed once it has so many, so only a longer document makes a longer file.
FILE_IDS = 1_000_000
#: Bytes of text that one task encodes, about, as long as MOST_PARTS tasks are enough.
TASK_BYTES = 12_000_000
#: Ranges of ids at most; beyond MOST_PARTS * TASK_BYTES of text a task encodes more and writes more files.
MOST_PARTS = 20_000
#: A pair must stand so often in a file to get a rule.
LEAST_COUNT = 12
ROUND_RULES = 4_096
SLOTS = 1 << 18
#: Bytes of text that are cut and looked up at once; a longer text is taken whole.
BATCH_BYTES = 5_000_000
MAGIC = b"REPAIR02"

# ---------------------------------------------------------------- encoding

#: Distinct pieces that an encoder remembers before it starts anew.
MOST_PIECES = 1_000_000

LETTER, NUMBER, OTHER, SPACE = range(4)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def cuts_like_us(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that ``Encoder`` may cut into pieces by itself."""
    cutter = spec.get("pre_tokenizer") or {}
    plain = all(spec.get(k) is None for k in ("normalizer", "truncation", "padding"))
    return plain and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True and cutter.get("add_prefix_space") is False and spec["model"].get("type") == "BPE"


class Encoder:
    """Ids of whole texts from a tokenizers file.

    Of byte-level files without a normalizer, texts are cut where the library's own pre-tokenizer cuts them; the library's
    model encodes each distinct piece once, which is looked up afterwards. Texts with an added token's string,
    and all texts for files of other kinds, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_pieces = cuts_like_us(json.loads(Path(path).read_text(encoding="utf-8")))
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.kind = np.full(0x110000, -1, np.int8)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        lists = [[t.id for t in tokenize(p.decode("latin-1").translate(letters))] for p in pieces.cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.known = pa.concat_arrays([self.known, pieces])

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds < 0).any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kinds < 0]).tolist():
                ch = chr(p)
                self.kind[p] = next((k for k, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(beside + ch)) == 1), SPACE)
            kinds = self.kind[points]
        return kinds

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start; ``first`` marks the first character of each text."""
        kind = self._kinds(points)
        space = kind == SPACE
        last = np.append(first[1:], True)  # the last character of its text
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        before_word = space & ~last & np.append(~space[1:], False)  # the space that a word follows
        starts = change | before_word
        joined = np.append(False, (before_word & (points == 32))[:-1])
        starts &= ~joined
        mark = starts & (points == 39) & ~last
        for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
            at = np.flatnonzero(mark)
            for k, ch in enumerate(ending, 1):
                at = at[at + k < len(points)]
                at = at[(points[at + k] == ord(ch)) & ~first[at + k]]
            starts[at + 1] = False
            after = at + len(ending) + 1
            starts[after[after < len(points)]] = True
            mark[at] = False
        return starts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_pieces and not any(a in t for a in self.added) for t in texts]
        whole = [t for t, p in zip(texts, plain, strict=True) if p and t]
        pieces = iter(self._encode_plain(whole) if whole else ())
        none = np.zeros(0, np.int32)
        return [(next(pieces) if t else none) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t, p in zip(texts, plain, strict=True)]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(points), bool)
        first[bounds[:-1]] = True
        starts = np.flatnonzero(self._starts(points, first))
        raw = joined.encode()
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # the first byte of each character
        offsets = np.append(lead[starts], len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct, codes = pieces.dictionary, pieces.indices.to_numpy()
        held = pc.index_in(distinct, value_set=self.known)
        if held.null_count:
            fresh = distinct.filter(held.is_null())
            if len(self.known) + len(fresh) > MOST_PIECES:
                self._forget()
                fresh, held = distinct, pa.nulls(len(distinct), pa.int32())
            before = len(self.known)
            self._learn(fresh)
            held = held.to_numpy(zero_copy_only=False)
            lacks = np.isnan(held)
            held[lacks] = before + np.arange(len(fresh))
            held = held.astype(np.int64)
        else:
            held = held.to_numpy()
        begin = self.ends[held]
        sizes = self.ends[held + 1] - begin
        ids = gather(self.flat, begin[codes], sizes[codes])
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        cuts = ends[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that start at ``starts``, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- Re-Pair


def repair(symbols: np.ndarray, size: int, barrier: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): frequent pairs replaced until none is left; rule k (left, right) is for the symbol size + k.

    Each round takes the most frequent pairs of which no symbol is the left of one and the right of another, so
    that their places cannot overlap. No pair contains ``barrier``. A pair that was once too rare stays so, as replacing
    only takes places from it; so only places of frequent pairs and those beside new symbols are counted again. Places
    stay where they are, linked to those before and after, until the end.
    """
    least = LEAST_COUNT if least is None else least
    now, rules, top = symbols.astype(np.int32), [], size
    n_all = len(now)
    before, after = np.arange(-1, n_all - 1, dtype=np.int32), np.arange(1, n_all + 1, dtype=np.int32)
    gone = np.zeros(n_all, bool)
    at = np.arange(max(n_all - 1, 0))
    while True:
        at = at[(now[at] != barrier) & (now[after[at]] != barrier)]
        # Pairs are counted in slots first: only those in a slot with enough of them can be frequent.
        slots = ((now[at] * np.int32(40_503) + now[after[at]]) & np.int32(SLOTS - 1)).astype(np.intp)
        at = at[(np.bincount(slots, minlength=SLOTS) >= least)[slots]]
        own = now[at].astype(np.int64) << 32 | now[after[at]]
        order = np.argsort(own)
        own = own[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        pair, n = own[start], np.diff(np.append(start, len(own)))
        often = n >= least
        if not often.any():
            break
        where = np.empty(len(at), np.int64)
        where[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), n)
        pair, n = pair[often], n[often]
        at, where = at[where >= 0], where[where >= 0]
        left: set[int] = set()
        right: set[int] = set()
        number = np.full(len(pair), -1, np.int64)  # of the new symbol, for the pairs that are taken
        taken = 0
        order = np.lexsort((pair, -n))[: 4 * ROUND_RULES]
        for k, key in zip(order.tolist(), pair[order].tolist(), strict=True):
            a, b = key >> 32, key & 0xFFFFFFFF
            if (a not in left and a not in right) if a == b else (a not in right and b not in left):
                left.add(a)
                right.add(b)
                number[k] = top + taken
                taken += 1
                rules.append(key)
                if taken == ROUND_RULES:
                    break
        symbol = number[where]
        hit = symbol >= 0
        spot, symbol = at[hit], symbol[hit]
        twin = now[spot] == now[after[spot]]
        if twin.any():  # in a run of one symbol, every second place
            fresh = np.ones(len(spot), bool)
            fresh[1:] = (spot[1:] != after[spot[:-1]]) | ~twin[1:] | ~twin[:-1]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            keep = ~twin | ((np.arange(len(spot)) - run_start) % 2 == 0)
            spot, symbol = spot[keep], symbol[keep]
        now[spot] = symbol
        eaten = after[spot]
        gone[eaten] = True
        after[spot] = after[eaten]
        inner = after[spot] < n_all
        before[after[spot[inner]]] = spot[inner]
        look = np.zeros(n_all, bool)
        look[at] = True
        look[spot] = True
        look[before[spot[before[spot] >= 0]]] = True
        at = np.flatnonzero(look & ~gone)
        at = at[after[at] < n_all]
        top += taken
    pairs = np.array(rules, np.int64)
    return now[~gone].astype(np.uint32), np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1).astype(np.uint32) if len(pairs) else np.zeros((0, 2), np.uint32)


def packed(values: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits: their low 16 bits, then each higher bit of all of them, eight to a byte."""
    planes = [np.packbits((values >> b) & 1, bitorder="little").tobytes() for b in range(16, bits)]
    return (values & 0xFFFF).astype("<u2").tobytes() + b"".join(planes)


def unpacked(raw: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """(numbers, end): the ``n`` numbers that ``packed`` wrote at ``at``."""
    out = np.frombuffer(raw, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for b in range(16, bits):
        plane = np.frombuffer(raw, np.uint8, -(-n // 8), at)
        out |= np.unpackbits(plane, count=n, bitorder="little").astype(np.uint32) << np.uint32(b)
        at += len(plane)
    return out, at


@dataclass
class TokenFile:
    """Documents of one file, in order: symbols[places[i]:places[i + 1]] are those of document i."""

    size: int
    symbols: np.ndarray
    places: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray], size: int) -> TokenFile:
        """``size``: how many ids there are; the end of a document is the symbol of this number."""
        flat = np.concatenate([x for d in documents for x in (d, [size])]).astype(np.int64) if documents else np.zeros(0, np.int64)
        symbols, rules = repair(flat, size + 1, barrier=size)
        lengths = np.ones(size + 1 + len(rules), np.int64)
        for k, (a, b) in enumerate(rules.tolist(), size + 1):
            lengths[k] = lengths[a] + lengths[b]
        places = np.concatenate([[0], np.flatnonzero(symbols == size) + 1])
        return cls(size, symbols, places, rules, lengths[size + 1 :])

    def to_bytes(self) -> bytes:
        bits = max(16, (self.size + len(self.rules)).bit_length())
        head = struct.pack("<8sIIIII", MAGIC, self.size, len(self.places), len(self.symbols), len(self.rules), bits)
        return head + self.places.astype("<u4").tobytes() + self.lengths.astype("<u4").tobytes() + packed(self.rules.ravel(), bits) + packed(self.symbols, bits)

    @classmethod
    def from_bytes(cls, raw: bytes) -> TokenFile:
        magic, size, n_places, n_symbols, n_rules, bits = struct.unpack_from("<8sIIIII", raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize("<8sIIIII")
        places = np.frombuffer(raw, "<u4", n_places, at)
        lengths = np.frombuffer(raw, "<u4", n_rules, at + places.nbytes)
        rules, at = unpacked(raw, at + places.nbytes + lengths.nbytes, 2 * n_rules, bits)
        symbols, _ = unpacked(raw, at, n_symbols, bits)
        return cls(size, symbols, places, rules.reshape(-1, 2), lengths)

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expansions of all symbols: one flat array, each symbol's start in it, and its length."""
        if not hasattr(self, "_held"):
            sizes = np.concatenate([np.ones(self.size + 1, np.int64), self.lengths.astype(np.int64)])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.zeros(int(sizes.sum()), np.int32)
            flat[: self.size + 1] = np.arange(self.size + 1)
            flat[self.size] = END_ID
            for k, (a, b) in enumerate(self.rules.tolist(), self.size + 1):
                s, m = starts[k], sizes[a]
                flat[s : s + m] = flat[starts[a] : starts[a] + m]
                flat[s + m : s + sizes[k]] = flat[starts[b] : starts[b] + sizes[b]]
            self._held = flat, starts, sizes
        return self._held

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts, sizes = self._tables()
        return gather(flat, starts[symbols], sizes[symbols])

    def counts(self) -> np.ndarray:
        """Ids of each document, with its end, from the lengths alone."""
        sizes = np.concatenate([np.ones(self.size + 1, np.int64), self.lengths.astype(np.int64)])
        ends = np.concatenate([[0], np.cumsum(sizes[self.symbols])])
        return np.diff(ends[self.places])

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.places[i] : self.places[i + 1]])

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the symbols that reach into the stretch are expanded."""
        sizes = np.concatenate([np.ones(self.size + 1, np.int64), self.lengths.astype(np.int64)])
        ends = np.cumsum(sizes[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]


# ---------------------------------------------------------------- Spark

FILES = "part int, file int, start bigint, n_ids bigint, doc_ids array<bigint>, content binary"


def encode_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """FILES of all documents, ascending by id over (part, file); null ids come first.

    part: number of the range of ids; start: ids in the part before the file. Null texts count as empty: their
    document has the end id only. Rows of equal ids stand side by side. An empty table gives no files. No
    other column of docs is read. Parts grow in number with the text up to MOST_PARTS, and beyond that in size; files
    keep theirs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, -(-total // task_bytes)), MOST_PARTS)
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal number, start, n
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([TokenFile.of(held, own.size).to_bytes()], pa.binary())],
                names=["part", "file", "start", "n_ids", "doc_ids", "content"],
            )
            number, start, n = number + 1, start + n, 0
            ids.clear()
            held.clear()
            return out

        for batch in batches:
            for some in of_bytes(batch, BATCH_BYTES):
                for i, tokens in zip(some.column(0).to_pylist(), own.encode(some.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    held.append(tokens)
                    n += len(tokens) + 1
                    if n >= file_ids:
                        yield close()
        if ids:
            yield close()

    return ordered.mapInArrow(write, FILES)


def of_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (column 1), of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_files(docs: DataFrame, path: str, tokenizer_path: str, **settings) -> None:
    encode_files(docs, tokenizer_path, **settings).write.parquet(path)


DIGESTS = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files.

    start: ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, doc_ids, content in zip(*[batch.column(c).to_pylist() for c in ("part", "start", "doc_ids", "content")], strict=True):
                file = TokenFile.from_bytes(content)
                ids, counts = file.expand(file.symbols).astype("<u4"), file.counts()
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[b - n : b].tobytes()) for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(counts), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILES).parquet(path)
    # One row for each range of ids: MOST_PARTS at most, whatever the input, so one task may order them.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = files.select("part", "start", "doc_ids", "content").mapInArrow(read, DIGESTS)
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
