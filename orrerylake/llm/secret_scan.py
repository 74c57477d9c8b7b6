"""Secret scan with DataFrame expressions only.

Base kinds are found by expressions of fixed shape. The method adds strings of high entropy: over each
candidate string a window slides, the counts of its characters are kept up to date as one character
enters and one leaves, and the sum of c * log2(c) with them, so each step costs the same whatever the
window's width. Sums are whole numbers (millionths of a bit), so results do not hang on the order of
floating additions. Windows over their class's threshold merge into spans; an allow list suppresses
candidates of known harmless shapes, and spans that hold a word which marks an example.

No step grows an array a piece at a time: places are sums over blocks, and long candidates are slid over in
stretches of STRETCH windows, whose spans are merged afterwards. So a text costs in proportion to its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerylake.functions.binding import let


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = ASSIGN.replace("/_.=-]+)", "/_.=-]{12,})")
#: Runs are matched to their end, so asking for the least length in the pattern drops the same matches.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"

WINDOW = 20
UNIT = 1_000_000
#: c * log2(c) in millionths, for c up to the window's width.
TERMS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
#: Windows that are slid over with one set of counts.
STRETCH = 256
#: Lengths that are summed up at once.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A class of candidates: runs of characters of ``alphabet`` of WINDOW characters or more.

    ``bits``: entropy that a window needs at least. ``needs``: patterns which the whole candidate must
    match, each of them, to look like a key and not like a long word.
    """

    name: str
    alphabet: str
    pattern: str
    bits: float
    needs: tuple[str, ...] = ()

    @property
    def most_terms(self) -> int:
        """Entropy is log2(W) - sum / W; this is the greatest sum at which a window still has ``bits``."""
        return math.floor((math.log2(WINDOW) - self.bits) * WINDOW * UNIT + 0.5)


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
KINDS = [
    Kind("entropy_hex", DIGITS + "ABCDEFabcdef", "[0-9A-Fa-f]{20,}", 3.0, ("[0-9]", "[A-Fa-f]")),
    Kind("entropy_key", UPPER + LOWER + DIGITS + "+/_=-", "[A-Za-z0-9+/_=-]{20,}", 3.6, ("[0-9]", "[A-Z]", "[a-z]")),
    Kind("entropy_upper", UPPER + DIGITS, "[A-Z0-9]{20,}", 3.6, ("[0-9]", "[G-Z]")),
    Kind("entropy_lower", LOWER + DIGITS, "[a-z0-9]{20,}", 3.6, ("[0-9]", "[g-z]")),
]
#: Candidates of these shapes are not secrets.
ALLOW = [
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^[A-Za-z]++(?:[/_-][A-Za-z]++)++(?:[/_-][0-9]++)?$",
    "^(sha256|sha384|sha512|md5)[-_=]",
]
#: Spans that hold one of these are examples.
ALLOW_WORDS = ["(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh"]

SPAN = "array<struct<start:int,kind:string,stop:int,text:string>>"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _by(n: Column, by: int) -> Column:
    return F.floor(n / by).cast("int")


def sums_before(numbers: Column) -> Column:
    """For each of an array's numbers the sum of those before it, by sums of blocks and of blocks of blocks."""

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), _by(F.size(x) - 1, BLOCK)), lambda b: _sum(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

    def upto(larger: Column) -> Column:
        return F.transform(larger, lambda _, i: _sum(F.slice(larger, F.lit(1), i)))

    def placed(x: Column, small: Column, large: Column) -> Column:
        def place(i: Column) -> Column:
            b, a = _by(i, BLOCK), _by(i, BLOCK * BLOCK)
            return F.get(large, a) + _sum(F.slice(small, a * BLOCK + 1, b - a * BLOCK)) + _sum(F.slice(x, b * BLOCK + 1, i - b * BLOCK))

        return F.transform(x, lambda _, i: place(i))

    def all_placed(x: Column) -> Column:
        return let(blocks(x), lambda small: let(let(blocks(small), upto), lambda large: placed(x, small, large)))

    return let(numbers, lambda x: F.when(F.size(x) > 0, all_placed(x)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places: the gaps and the matches add up to the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)

    def placed(pairs: Column) -> Column:
        def span(before: Column, pair: Column) -> Column:
            start = before + pair["gap"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(pair["text"])).alias("stop"), pair["text"].alias("text"))

        return F.zip_with(sums_before(F.transform(pairs, lambda p: p["gap"] + F.char_length(p["text"]))), pairs, span)

    # Zipped, both arrays are made once; the gap after the last match has no match.
    pairs = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("text")))
    return let(F.filter(pairs, lambda p: p["text"].isNotNull()), placed)


def _when_any(text: Column, pattern: str, spans: Column) -> Column:
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


RUNS = "array<struct<start:int,stop:int>>"


def _slide(codes: Column, base: Column, kind: Kind) -> Column:
    """Merged (start, stop) runs of windows with the kind's entropy or more; ``codes`` start at place ``base``."""
    terms = F.array(*map(F.lit, TERMS))
    first = F.struct(F.array_repeat(F.lit(0), len(kind.alphabet) + 1).alias("counts"), F.lit(0).alias("sum"), F.array().cast(RUNS).alias("runs"))

    def step(s: Column, pair: Column) -> Column:
        into, out, i = pair["into"], pair["out"], pair["i"]
        # One count goes up and one goes down; position 0 of the counts takes what is not counted.
        same = into == out
        up, down = F.get(s["counts"], into), F.get(s["counts"], out)
        total = F.when(same, s["sum"]).otherwise(
            s["sum"] + F.get(terms, up + 1) - F.get(terms, up) + F.when(out > 0, F.get(terms, down - 1) - F.get(terms, down)).otherwise(0)
        )
        counts = F.when(same, s["counts"]).otherwise(
            F.transform(s["counts"], lambda c, j: c + F.when((j == into) & (j > 0), 1).when((j == out) & (j > 0), -1).otherwise(0))
        )
        high = (i >= WINDOW - 1) & (total <= kind.most_terms)
        start, stop = base + i - (WINDOW - 1), base + i + 1
        last = F.try_element_at(s["runs"], F.lit(-1))
        joined = F.when(~high, s["runs"]).when(
            last.isNotNull() & (last["stop"] >= start),
            F.concat(F.slice(s["runs"], 1, F.greatest(F.size(s["runs"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), stop.alias("stop")))),
        ).otherwise(F.concat(s["runs"], F.array(F.struct(start.alias("start"), stop.alias("stop")))))
        return F.struct(counts.alias("counts"), total.alias("sum"), joined.alias("runs"))

    # The same codes, WINDOW places later, are those that leave.
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
    pairs = F.filter(F.zip_with(codes, leaving, lambda c, d: F.struct(c.alias("into"), d.alias("out"))), lambda p: p["into"].isNotNull())
    numbered = F.transform(pairs, lambda p, i: F.struct(p["into"].alias("into"), p["out"].alias("out"), i.alias("i")))
    return F.aggregate(numbered, first, step, lambda s: s["runs"])


def high_windows(text: Column, kind: Kind) -> Column:
    """Merged (start, stop) runs of windows of ``text`` with the kind's entropy or more. Texts have WINDOW characters or more."""
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(kind.alphabet), c))

    def stretches(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(codes) - WINDOW, F.lit(STRETCH))
        return F.flatten(F.transform(starts, lambda at: _slide(F.slice(codes, at + 1, F.lit(STRETCH + WINDOW - 1)), at, kind)))

    def merged(runs: Column) -> Column:
        fresh = F.filter(runs, lambda r, k: (k == 0) | (F.get(runs, k - 1)["stop"] < r["start"]))
        ended = F.filter(runs, lambda r, k: (k == F.size(runs) - 1) | (F.get(runs, k + 1)["start"] > r["stop"]))
        return F.zip_with(fresh, ended, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))

    return let(let(codes, stretches), merged)


def allowed(text: Column, allow: list[str]) -> Column:
    out = F.lit(False)
    for p in allow:
        out = out | text.rlike(p)
    return out


def _spans_of_kind(text: Column, kind: Kind, allow: list[str], words: list[str]) -> Column:
    def suspicious(m: Column) -> Column:
        out = ~allowed(m["text"], allow)
        for p in kind.needs:
            out = out & m["text"].rlike(p)
        return out

    def of_candidate(m: Column) -> Column:
        return F.transform(
            high_windows(m["text"], kind),
            lambda r: F.struct((m["start"] + r["start"]).alias("start"), m["kind"].alias("kind"), (m["start"] + r["stop"]).alias("stop"), F.substr(m["text"], r["start"] + 1, r["stop"] - r["start"]).alias("text")),
        )

    spans = F.flatten(F.transform(F.filter(matches(text, kind.pattern, kind.name), suspicious), of_candidate))
    return F.filter(spans, lambda s: ~allowed(s["text"], words))


def entropy_spans(text: Column, kinds: list[Kind] = KINDS, allow: list[str] = ALLOW, words: list[str] = ALLOW_WORDS) -> Column:
    """Spans of high entropy, kind by kind."""
    return F.concat(*[_when_any(text, kind.pattern, _spans_of_kind(text, kind, allow, words)) for kind in kinds])


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, "assign"), lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 12)
    return F.concat(
        _when_any(text, ASSIGN_LEAST, assign),
        _when_any(text, ACCESS, matches(text, ACCESS, "access")),
        _when_any(text, HEX, matches(text, HEX, "hex")),
    )


#: Order of kinds among spans that start at the same place.
ORDER = ["assign", "access", "hex", *[k.name for k in KINDS]]


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, ORDER)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["text"].alias("text")))
    return F.array_sort(keyed)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    return F.concat_ws(",", F.transform(in_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def scan(docs: DataFrame, text_col: str = "text", kinds: list[Kind] = KINDS, allow: list[str] = ALLOW, words: list[str] = ALLOW_WORDS) -> DataFrame:
    """``docs`` with the column ``found``: struct of base and entropy spans (start, kind, stop, text).

    Places count code points, ends are exclusive. Null counts as the empty text, which has no spans.
    Every row is scanned by itself and whole: repeated rows get equal results, and very long texts cost
    in proportion to their length. A column of docs named found is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("found", F.struct(base_spans(text).alias("base"), entropy_spans(text, kinds, allow, words).alias("entropy")))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(kinds: list[Kind] = KINDS, allow: list[str] = ALLOW, words: list[str] = ALLOW_WORDS) -> str:
    """The same result in DuckDB SQL, with the counts of every window taken anew."""
    allow = [p.replace("++", "+") for p in allow]  # classes that follow each other are disjoint: possessive or not is the same
    shapes = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *[(k.name, k.pattern) for k in kinds]]
    parts = ["WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"]
    for name, pattern in shapes:
        p = _sql(pattern)
        parts.append(
            f"pairs_{name} AS (SELECT rid, unnest(regexp_extract_all(t, {p})) AS m, unnest(regexp_split_to_array(t, {p})[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, {p}), 1) AS i FROM docs WHERE regexp_matches(t, {p}))"
        )
        parts.append(
            f"found_{name} AS (SELECT rid, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) - length(m) AS a FROM pairs_{name})"
        )
    base = [f"SELECT rid, {k} AS k, '{n}' AS kind, a, a + length(m) AS b FROM found_{n}" for k, (n, _) in enumerate(shapes[:3])]
    base[0] += f" WHERE length(regexp_extract(m, {_sql(ASSIGN)}, 2)) >= 12"
    parts.append("base AS (" + " UNION ALL ".join(base) + ")")
    every = ["SELECT * FROM base"]
    for k, kind in enumerate(kinds, 3):
        n = kind.name
        looks = " AND ".join([f"NOT regexp_matches(m, {_sql(p)})" for p in allow] + [f"regexp_matches(m, {_sql(p)})" for p in kind.needs])
        terms = "[" + ", ".join(map(str, TERMS[1:])) + "]"
        parts.append(f"suspects_{n} AS (SELECT rid, a, m FROM found_{n} WHERE {looks})")
        parts.append(f"windows_{n} AS (SELECT rid, a, w, unnest(string_split(substr(m, w + 1, {WINDOW}), '')) AS ch FROM (SELECT rid, a, m, CAST(unnest(range(0, length(m) - {WINDOW - 1})) AS BIGINT) AS w FROM suspects_{n}))")
        parts.append(f"sums_{n} AS (SELECT rid, a, w FROM (SELECT rid, a, w, ch, count(*) AS c FROM windows_{n} GROUP BY ALL) GROUP BY rid, a, w HAVING sum(({terms})[c]) <= {kind.most_terms})")
        parts.append(f"marks_{n} AS (SELECT rid, a, w, CASE WHEN w - lag(w) OVER (PARTITION BY rid, a ORDER BY w) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM sums_{n})")
        parts.append(f"runs_{n} AS (SELECT rid, a, w, sum(fresh) OVER (PARTITION BY rid, a ORDER BY w) AS run FROM marks_{n})")
        parts.append(f"spans_{n} AS (SELECT rid, a, min(w) AS lo, max(w) + {WINDOW} AS hi FROM runs_{n} GROUP BY rid, a, run)")
        harmless = " AND ".join(f"NOT regexp_matches(substr(m, lo + 1, hi - lo), {_sql(p)})" for p in words) or "true"
        every.append(f"SELECT rid, {k} AS k, '{n}' AS kind, a + lo AS a, a + hi AS b FROM spans_{n} JOIN suspects_{n} USING (rid, a) WHERE {harmless}")
    parts.append("every_span AS (" + " UNION ALL ".join(every) + ")")
    text = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b)"
    parts.append(f"base_list AS (SELECT rid, {text} AS s, count(*) FILTER (kind = 'assign') AS n1, count(*) FILTER (kind = 'access') AS n2, count(*) FILTER (kind = 'hex') AS n3 FROM base GROUP BY rid)")
    parts.append(f"full_list AS (SELECT rid, {text} AS s FROM every_span GROUP BY rid)")
    return ", ".join(parts) + (
        " SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(f.s, '') AS spans"
        " FROM docs LEFT JOIN base_list b USING (rid) LEFT JOIN full_list f USING (rid)"
    )
