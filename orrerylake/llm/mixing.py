"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The table is raked: scaled to the target share of each
margin in turn until all hold; where they cannot all hold, a warning says by how much they miss. A cell's
weight is its fitted share over its own; documents are sampled with a probability in proportion to it,
scaled so that the expected tokens meet the budget. ``achieved`` tells what each margin came to.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged

OTHER = "other"
#: Raking stops when every margin is met to this relative error, or after so many sweeps.
TOLERANCE = 1e-12
SWEEPS = 200
#: Bits of the hash that decides on a document.
BITS = 52
#: The first topic of which a text contains a string is its topic.
TOPICS = {
    "legal": ["icensed under", "ll rights reserved", "opyright", "erms of use"],
    "tabular": [" | "],
    "symbols": ["***", "$$$", "%%%", "&&&", "###"],
    "contact": ["@"],
}
GENERAL = "general"


@dataclass(frozen=True)
class Plan:
    """Target shares of tokens for each margin. What a margin does not name counts as ``other``; shares
    are taken in proportion among those that occur. The table of cells has at most the product of the
    margins' sizes (each plus one) rows, whatever the input.
    """

    source: tuple[tuple[str, float], ...]
    lang: tuple[tuple[str, float], ...]
    topic: tuple[tuple[str, float], ...]
    keep: float = 0.5

    @property
    def margins(self) -> dict[str, dict[str, float]]:
        return {m: dict(getattr(self, m)) for m in ("source", "lang", "topic")}


PLAN = Plan(
    source=(*((f"src{i}", 0.048) for i in range(20)), (OTHER, 0.04)),
    lang=(("en", 0.48), ("de", 0.18), ("fr", 0.18), ("es", 0.12), (OTHER, 0.04)),
    topic=((GENERAL, 0.68), ("legal", 0.06), ("tabular", 0.1), ("symbols", 0.06), ("contact", 0.1)),
)


def topic_of(text: Column) -> Column:
    out = F.lit(GENERAL)
    for name, strings in reversed(TOPICS.items()):
        out = F.when(reduce(or_, [text.contains(s) for s in strings]), F.lit(name)).otherwise(out)
    return out


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \t-\r]+")).cast("long")


def folded(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin([k for k in targets if k != OTHER]), value).otherwise(F.lit(OTHER))


def rake(tokens: np.ndarray, codes: dict[str, np.ndarray], targets: dict[str, np.ndarray], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(fitted tokens of each cell, largest relative error of a margin). ``codes`` give each cell's place in each margin's ``targets``.

    The error is above ``tolerance`` only if ``sweeps`` did not reach it: slow tables, and targets that no
    weights of the cells there are can meet together.
    """

    def held(m: str) -> np.ndarray:
        return np.bincount(codes[m], fitted, len(targets[m]))

    fitted, error = tokens.astype(float), 0.0
    for _ in range(sweeps):
        for m, code in codes.items():
            have = held(m)
            fitted = fitted * np.where(have > 0, targets[m] / np.where(have > 0, have, 1), 0)[code]
        error = max((float(np.abs(held(m)[goal > 0] / goal[goal > 0] - 1).max()) for m, goal in targets.items()), default=0.0)
        if error <= tolerance:
            break
    return fitted, error


def probabilities(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * weight), with s such that the expected tokens are ``budget``, or all if that is too few."""
    order = np.lexsort((np.arange(len(weight)), -weight))
    t, w = tokens[order].astype(float), weight[order]
    sure = np.concatenate([[0], np.cumsum(t)])[:-1]
    rest = np.cumsum((t * w)[::-1])[::-1]
    for k in range(len(t)):
        s = (budget - sure[k]) / rest[k] if rest[k] > 0 else 0.0
        if s * w[k] <= 1:
            return np.minimum(1.0, s * weight) if s >= 0 else np.zeros(len(weight))
    return np.ones(len(weight))


def weigh(docs: DataFrame, plan: Plan = PLAN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the column ``mix``: topic, tokens, weight, probability, sampled.

    With ``keep``, only these columns of docs stay, and the texts are read once: what is kept and measured is
    written to the shared folder.

    Null sources and languages count as other, null texts as empty: those have no tokens, and the
    probability of their cell. A cell without any tokens has weight 1. Targets that cannot all be met give a
    warning and the weights of the last sweep. The draw hangs on the id alone:
    repeated rows are sampled together, rows with null ids too. An empty table stays empty. A column of docs
    named mix is replaced.
    """
    margins = plan.margins
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = docs.columns if keep is None else keep
    keys = {"_source": folded(F.col(source_col), margins["source"]), "_lang": folded(F.col(lang_col), margins["lang"]), "_topic": topic_of(text)}
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), *[v.alias(k) for k, v in keys.items()], words_in(text).alias("_tokens"), draw.alias("_draw"))
    if keep is not None:
        held = staged(held, "mix")
    cells = held.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")).toPandas().rename(columns=lambda c: c.lstrip("_")).sort_values([k[1:] for k in keys], ignore_index=True)
    tokens = cells["tokens"].to_numpy(float)
    full = tokens > 0
    weight = np.ones(len(cells))
    if full.any():
        codes, targets = {}, {}
        for m, shares in margins.items():
            names = sorted(set(cells[m][full]))
            share = np.array([shares.get(x, 0.0) for x in names])
            if share.sum() <= 0:
                continue
            codes[m] = np.array([names.index(x) for x in cells[m][full]])
            targets[m] = share / share.sum() * tokens.sum()
        fitted, error = rake(tokens[full], codes, targets)
        if error > TOLERANCE:
            warnings.warn(f"the margins do not all hold after {SWEEPS} sweeps: one misses its target by {error:.2g} of it", stacklevel=2)
        weight[full] = fitted / tokens[full]
    cells["weight"] = weight
    cells["probability"] = probabilities(tokens, weight, plan.keep * tokens.sum())
    # As many rows as there are combinations of the plan's categories, at most.
    table = F.broadcast(docs.sparkSession.createDataFrame([(r.source, r.lang, r.topic, float(r.weight), float(r.probability)) for r in cells.itertuples()], "_source string, _lang string, _topic string, _weight double, _probability double"))
    out = held.join(table, ["_source", "_lang", "_topic"])
    mix = F.struct(F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), (F.col("_draw") < F.col("_probability")).alias("sampled"))
    return out.select(*[F.col("_doc")[c].alias(c) for c in columns if c.lower() != "mix"], mix.alias("mix"))


def sample(docs: DataFrame, plan: Plan = PLAN, **settings) -> DataFrame:
    """The rows of docs that the draw takes, with their columns only."""
    if "mix" not in [c.lower() for c in docs.columns]:
        return weigh(docs, plan, **settings).where("mix.sampled").drop("mix")
    own = next(c for c in docs.columns if c.lower() == "mix")
    held = free_name(docs, "_own_mix")
    sampled = weigh(docs.withColumnRenamed(own, held), plan, **settings).where("mix.sampled").drop("mix")
    return sampled.withColumnRenamed(held, own)


def achieved(weighed: DataFrame, plan: Plan = PLAN, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(margin, category, tokens, target, weighted, expected, cut) of the rows of ``weigh``: what the plan asked and what came of it.

    target: its share among the categories that occur with tokens; null where none of a margin's is asked for.
    weighted: the share by weights, which equals the target unless ``weigh`` warned. expected: the share of the tokens that the
    draw takes on average, which falls short where a cell is taken whole (probability 1); cut: the tokens in such cells.
    Null sources and languages are other, as in ``weigh``. An empty table gives none. Sums are partial before the shuffle.
    """
    margins = plan.margins
    mix = F.col("mix")
    named = {"source": folded(F.col(source_col), margins["source"]), "lang": folded(F.col(lang_col), margins["lang"]), "topic": mix["topic"]}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), c.alias("category")) for m, c in named.items()]))
    tokens = mix["tokens"]
    cut = F.when(mix["probability"] >= 1, tokens).otherwise(0)
    sums = weighed.select(each.alias("at"), tokens.alias("t"), (tokens * mix["weight"]).alias("w"), (tokens * mix["probability"]).alias("p"), cut.alias("c")).groupBy("at.margin", "at.category").agg(*[F.sum(c).alias(c) for c in "twpc"])
    # At most one row for each category of the plan, so the windows are small.
    asked = weighed.sparkSession.createDataFrame([(m, k, float(v)) for m, shares in margins.items() for k, v in shares.items()], "margin string, category string, share double")
    of = Window.partitionBy("margin")
    share = F.coalesce("share", F.lit(0.0))
    found = sums.where("t > 0").join(asked, ["margin", "category"], "left")
    return found.select("margin", "category", F.col("t").alias("tokens"), F.try_divide(share, F.sum(share).over(of)).alias("target"), F.try_divide("w", F.sum("w").over(of)).alias("weighted"), F.try_divide("p", F.sum("p").over(of)).alias("expected"), F.col("c").alias("cut"))


def oracle_sql(plan: Plan = PLAN, seed: str = "mix") -> str:
    """The same in DuckDB SQL: the sweeps are a recursion, the budget is met by a running sum."""

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    m = plan.margins
    fold = lambda c: f"CASE WHEN {c} IN ({', '.join(lit(k) for k in m[c] if k != OTHER)}) THEN {c} ELSE '{OTHER}' END"
    topic = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(text, {lit(x)})' for x in strings)} THEN '{n}'" for n, strings in TOPICS.items()) + f" ELSE '{GENERAL}' END"
    parts = [
        f"WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {fold('source')} AS source, {fold('lang')} AS lang, {topic} AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, shares in m.items():
        rows = ", ".join(f"({lit(k)}, CAST({v!r} AS DOUBLE))" for k, v in shares.items())
        parts.append(f"t_{dim} AS MATERIALIZED (SELECT n, share / sum(share) OVER () * (SELECT sum(tokens) FROM cells) AS goal FROM (VALUES {rows}) t(n, share) WHERE n IN (SELECT {dim} FROM cells WHERE tokens > 0))")
    goals = "".join(f" LEFT JOIN t_{dim} ON t_{dim}.n = c.{dim}" for dim in m)
    parts.append(f"f0 AS MATERIALIZED (SELECT source, lang, topic, tokens AS f, {', '.join(f'coalesce(t_{dim}.goal, 0) AS g_{dim}' for dim in m)} FROM cells c{goals} WHERE tokens > 0)")
    inner = "f WHERE k < " + str(SWEEPS)
    for dim in m:
        inner = f"(SELECT * REPLACE (coalesce(f * g_{dim} / nullif(sum(f) OVER (PARTITION BY {dim}), 0), 0) AS f) FROM {inner})"
    parts.append(f"f AS (SELECT *, 0 AS k FROM f0 UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {inner})")
    parts.append(f"w AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, coalesce(f / c.tokens, 1.0) AS weight FROM cells c LEFT JOIN (SELECT * FROM f WHERE k = {SWEEPS}) f USING (source, lang, topic))")
    parts.append("o AS MATERIALIZED (SELECT *, coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure, sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY weight DESC, source, lang, topic) AS i FROM w)")
    parts.append(f"s AS MATERIALIZED (SELECT arg_min(s, i) AS s FROM (SELECT i, weight, ({plan.keep!r} * (SELECT sum(tokens) FROM w) - sure) / nullif(rest, 0) AS s FROM o) WHERE s * weight <= 1)")
    parts.append("p AS (SELECT w.*, coalesce(least(1.0, greatest(s, 0) * weight), 1.0) AS probability FROM w, s)")
    draw = f"CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS DOUBLE) / {float(1 << BITS)!r}"
    return ", ".join(parts) + f" SELECT doc_id, topic, d.tokens AS tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, {draw} < probability AS sampled FROM d JOIN p USING (source, lang, topic)"
