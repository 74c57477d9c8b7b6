"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k errors, split into k + 1 pieces, has at least one piece
there without error. All pieces of all items are looked for in one pass over the text (Aho-Corasick);
around each hit the window in which the whole item would lie is verified with Myers' bit-parallel
edit distance, which keeps a column of the table in one whole number. Before that, the same principle is asked
of the pieces beside the hit: halve the pieces again and again, and in one half there are always
fewer errors than pieces. So some hit's two or three pieces lie there with one or two errors at
most; hits without that are left out, and no match is lost by it. Case and the amount of white space are
no errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

#: Errors allowed per character of an item.
ERROR_RATE = 0.1
#: Items of fewer characters are matched as whole words without errors, and say too little to make a text go.
LEAST_CHARS = 20
#: Items are matched in blocks of so many characters, which bounds what is sent to the executors.
BLOCK_CHARS = 2_000_000

MATCH = "struct<item_id:bigint,distance:int,start:int,stop:int,telling:boolean>"


def plain(text: str | None) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def places(text: str) -> list[int]:
    """For each character of ``plain(text)`` the place in ``text`` that it comes from."""
    out: list[int] = []
    gap = False
    for i, ch in enumerate(text):
        if ch.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(i - 1)
            gap = False
        out.extend([i] * len(ch.lower()))
    return out


def masks(pattern: str) -> dict[str, int]:
    """For each character the set of places in the pattern, as bits."""
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def myers(pattern: dict[str, int], m: int, text: str, most: int, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the least edit distance, if at most ``most``, between a pattern of m characters
    and a part of ``text`` that ends at ``end`` (exclusive, the first such end); (most + 1, -1) if none.

    The part may start anywhere, or with ``anchored`` only where the text starts.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = most + 1, -1
    get = pattern.get
    first = 1 if anchored else 0
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(h | up))
        minus = up & h
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, j
                if not score:
                    break
        plus = (plus << 1 | first) & full
        minus = minus << 1 & full
        up = minus | (full & ~(v | plus))
        down = plus & v
    return best, end


def families(n: int) -> list[tuple[int, int]]:
    """For each of n pieces the two or three (first, end) that halving leaves it with last; one alone has itself."""
    out = [(0, n)] * n

    def halve(a: int, b: int) -> None:
        if b - a > 3:
            halve(a, (a + b) // 2)
            halve((a + b) // 2, b)
        else:
            out[a:b] = [(a, b)] * (b - a)

    halve(0, n)
    return out


class Matcher:
    """The pieces of a block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS):
        by_text: dict[str, list[int | None]] = {}
        for item_id, text in items:
            if t := plain(text):
                by_text.setdefault(t, []).append(item_id)
        self.items = list(by_text.items())
        self.short = [len(t) < least_chars for t, _ in self.items]
        self.budget = [0 if s else int(len(t) * error_rate) for (t, _), s in zip(self.items, self.short, strict=True)]
        self.masks = [masks(t) for t, _ in self.items]
        pieces: dict[str, list[tuple]] = {}
        for n, (t, _) in enumerate(self.items):
            count = self.budget[n] + 1
            cuts = [len(t) * j // count for j in range(count + 1)]
            held: dict[tuple[int, int], tuple] = {}
            for (a, b), (first, end) in zip(zip(cuts, cuts[1:], strict=False), families(count), strict=True):
                if (first, end) not in held:
                    held[first, end] = (cuts[first], cuts[end] - cuts[first], masks(t[cuts[first] : cuts[end]]), end - first - 1)
                others = [(x, y) for x, y in zip(cuts[first:end], cuts[first + 1 : end + 1], strict=True) if (x, y) != (a, b)]
                halves = tuple(t[i:j] for x, y in others for i, j in ((x, (x + y) // 2), ((x + y) // 2, y)))
                pieces.setdefault(t[a:b], []).append((n, b, *held[first, end], halves))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, at)
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the stretches of text in which it may lie; overlapping ones are merged."""
        starts: dict[int, set[int]] = {}
        for last, at in self.automaton.iter(text):
            for n, stop, first, size, mask, errors, halves in at:
                s = last + 1 - stop
                if errors:
                    a = s + first
                    near = text[max(0, a - errors) : max(0, a + size + errors)]
                    # Each error breaks one half of a piece at most, and there are two for each error.
                    if sum([h in near for h in halves]) < errors or myers(mask, size, near, errors)[1] < 0:
                        continue
                elif self.short[n] and (text[s - 1 : s].isalnum() or text[last + 1 : last + 2].isalnum()):
                    continue
                starts.setdefault(n, set()).add(s)
        out = {}
        for n, found in starts.items():
            k, m = self.budget[n], len(self.items[n][0])
            merged: list[list[int]] = []
            for s in sorted(found):
                a, b = max(0, s - k), s + m + k
                if merged and a <= merged[-1][1] and not self.short[n]:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            out[n] = merged
        return out

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, bool]]:
        """(item, distance, start, stop, telling) of the best match of each item, the first of equally good ones.

        telling: whether the item is long enough to tell, or the text is nothing else.
        """
        if not text or not self.items:
            return []
        flat = plain(text)
        out, back = [], None
        for n, stretches in self.windows(flat).items():
            t, ids = self.items[n]
            best, place = self.budget[n] + 1, None
            for a, b in stretches:
                distance, end = myers(self.masks[n], len(t), flat[a:b], best - 1)
                if distance < best:
                    best, place = distance, (a, a + end)
            if place is None:
                continue
            a, end = place
            _, length = myers(masks(t[::-1]), len(t), flat[max(a, end - len(t) - best) : end][::-1], best, anchored=True)
            back = back or places(text)
            out += [(i, best, back[end - length], back[end - 1] + 1, not self.short[n] or len(flat) == length) for i in ids]
        return sorted(out, key=lambda r: (r[2], r[0] is None, r[0] or 0))


def matches(text: Column, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> Column:
    """An array of MATCH for each whole text."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, error_rate, least_chars)
        for texts in batches:
            yield pd.Series([matcher.find(t) for t in texts], dtype=object)

    # Declared so that Catalyst does not search a second time to filter before it explodes.
    return F.pandas_udf(search, f"array<{MATCH}>").asNondeterministic()(text)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, a block at a time; the driver never holds more than a block and a partition."""
    block, size = [], 0
    for item_id, text in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with the column ``matches``: the benchmark items found in each whole text.

    Each match has the item's id, the edit distance, the place in the text (code points, stop exclusive), and
    whether it tells: items under ``least_chars``, which are matched as whole words without errors, only do if the
    text is nothing else. Texts are judged row by row, so repeated rows get equal results and null ids do no harm.
    Null and empty texts have no matches, nor have null and blank items; an item that stands in the
    benchmark twice matches twice. A column of docs named matches is replaced.

    The benchmark is worked through in blocks of ``block_chars``. Each block after the first costs a pass over the
    texts, with what was found before written to the shared folder, so that one block at a time is held.
    """
    held = free_name(docs, "_found")
    out = docs.withColumn(held, F.array().cast(f"array<{MATCH}>"))
    for k, items in enumerate(blocks(benchmark, item_id, item_text, block_chars)):
        found = matches(F.col(text_col), items, error_rate, least_chars)
        out = out.withColumn(held, found) if k == 0 else staged(out, "matches").withColumn(held, F.concat(held, found))
    return out.withColumn("matches", F.col(held)).drop(held)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows in whose text a telling benchmark item is found; all their columns stay, of any names."""
    held = free_name(docs, "_own")
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held), F.col(text_col).alias("text"))
    kept = mark(renamed, benchmark, "text", **settings).where(~F.exists("matches", lambda m: m["telling"]))
    return kept.select(*[F.col(held)[c].alias(c) for c in docs.columns])
