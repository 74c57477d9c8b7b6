"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

What is placed are groups of equal texts. Each group is a vector of shares of a shard's capacity and goes
where the dot product with the residual capacities is highest, largest groups first. Groups that are a
notable part of a shard are few, whatever the input's size, and are placed first, with all of them in view;
one that exceeds a shard is placed in pieces. The others are packed by many tasks at once, each of
which shares out its own groups over what the large ones left of every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import free_name, staged

N_SHARDS = 24
#: A group of more than this part of a shard, in any measure, is placed before all others. By the
#: pigeonhole principle there are at most 3 * shards / HEAVY of them.
HEAVY = 1 / 64
#: Groups that one task packs, about.
TASK_GROUPS = 20_000
#: Tasks that pack at most; beyond MOST_TASKS * TASK_GROUPS groups each packs more.
MOST_TASKS = 20_000
#: Rows that one task numbers, about.
TASK_ROWS = 100_000
MEASURES = ["bytes", "tokens", "rows"]


def pack(loads: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The bin of each load (n x 3); ``residual`` (bins x 3) is what is left of the bins, and shrinks.

    Largest loads first; ties go to the first of the loads, and to the bin of the lowest number.
    """
    out = np.zeros(len(loads), np.int32)
    for i in np.argsort(-loads.max(axis=1, initial=0), kind="stable"):
        out[i] = b = int(np.argmax(residual @ loads[i]))
        residual[b] -= loads[i]
    return out


def _place_heavy(slim: DataFrame, groups: DataFrame, capacity: np.ndarray, n_shards: int) -> tuple[list[tuple[bytes, list[int]]], np.ndarray]:
    """For each heavy group the shards of its pieces, and what all of them leave of the shards."""
    share = F.greatest(*[F.col(m) / float(c) for m, c in zip(MEASURES, capacity, strict=True)])
    heavy = {bytes(r.key): np.array([r[m] for m in MEASURES], float) for r in groups.where(share > HEAVY).select("key", *MEASURES).collect()}
    pieces = {k: 4 * math.ceil((v / capacity).max()) if (v / capacity).max() > 1 else 1 for k, v in heavy.items()}
    units = [(k, 0, v) for k, v in heavy.items() if pieces[k] == 1]
    if large := [(k, n) for k, n in pieces.items() if n > 1]:
        cut = slim.sparkSession.createDataFrame(large, "key binary, n int")
        part = slim.join(F.broadcast(cut), "key").groupBy("key", F.pmod("salt", "n").alias("piece")).agg(*[F.sum(m).alias(m) for m in MEASURES])
        units += [(bytes(r.key), r.piece, np.array([r[m] for m in MEASURES], float)) for r in part.collect()]
    units.sort(key=lambda u: (u[0], u[1]))
    residual = np.ones((n_shards, len(MEASURES)))
    at = pack(np.array([u[2] for u in units]).reshape(-1, len(MEASURES)) / capacity, residual)
    shards = {k: [0] * n for k, n in pieces.items()}
    for (k, piece, _), b in zip(units, at.tolist(), strict=True):
        shards[k][piece] = b
    return sorted(shards.items()), np.maximum(residual, 0)


def _pack_light(groups: DataFrame, residual: np.ndarray, tasks: int) -> DataFrame:
    """(key, shard) of the light groups: each task fills all shards in proportion to ``residual``."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [b for b in batches if len(b)]
        if not own:
            return
        mine = pd.concat(own, ignore_index=True).sort_values("key", ignore_index=True)
        loads = mine[MEASURES].to_numpy(float)
        total = loads.sum(axis=0)
        scale = np.where(total > 0, total, 1)
        left = residual / np.maximum(residual.sum(axis=0), 1e-12)
        turn = int.from_bytes(mine["key"][0][:4], "big") % len(left)  # so that ties do not always favour the same shards
        order = np.roll(np.arange(len(left)), turn)
        yield pd.DataFrame({"key": mine["key"], "shard": order[pack(loads / scale, left[order].copy())].astype(np.int32)})

    return groups.select("key", *MEASURES).repartition(tasks, "key").mapInPandas(fill, "key binary, shard int")


def shard(docs: DataFrame, keep: list[str], text_col: str = "text", n_shards: int = N_SHARDS) -> DataFrame:
    """The columns ``keep`` of docs and size, text_crc32, tokens (long), shard (int), slot (long).

    size: UTF-8 bytes of the text plus 8; text_crc32: unsigned; tokens: words between white space; slot:
    the row's number in its shard, from 0 without gaps. Rows of equal texts share a shard unless they
    exceed one in bytes, tokens or rows. Null texts count as empty ones; repeated rows and null ids are
    rows like any other; an empty table gives an empty table. Columns kept stay as they are: a new column
    whose name one of them bears gets underscores behind it.
    """
    names = {n: free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), n) for n in ("size", "text_crc32", "tokens", "shard", "slot")}
    held = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rid, key = free_name(docs, "_rid"), free_name(docs, "_key")
    # The numbers are written with the rows, so that every later step sees the same ones.
    full = staged(
        docs.select(
            *held,
            F.monotonically_increasing_id().alias(rid),
            (F.octet_length(text) + 8).cast("long").alias(names["size"]),
            F.crc32(text.cast("binary")).alias(names["text_crc32"]),
            F.regexp_count(text, F.lit("[^ \t-\r]+")).cast("long").alias(names["tokens"]),
            F.unhex(F.md5(text.cast("binary"))).alias(key),
        ),
        "shard-rows",
    )
    slim = full.select(F.col(rid).alias("rid"), F.xxhash64(rid).alias("salt"), F.col(key).alias("key"), F.col(names["size"]).alias("bytes"), F.col(names["tokens"]).alias("tokens"), F.lit(1).cast("long").alias("rows"))
    groups = staged(slim.groupBy("key").agg(*[F.sum(m).alias(m) for m in MEASURES]), "groups")
    total = groups.agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in MEASURES]).first()
    capacity = np.array([max(total[m] or 0, 1) for m in MEASURES], float) / n_shards
    heavy, residual = _place_heavy(slim, groups, capacity, n_shards)
    # At most 3 * n_shards / HEAVY groups: a bound that does not grow with the input.
    placed_heavy = F.broadcast(docs.sparkSession.createDataFrame(heavy, "key binary, shards array<int>"))
    light = groups.join(placed_heavy, "key", "left_anti")
    placed_light = staged(_pack_light(light, residual, min(math.ceil(max(total["n"], 1) / TASK_GROUPS), MOST_TASKS)), "placed")
    # A light group has under HEAVY of a shard's rows, so no key of this join is hot.
    chunk = F.pmod("salt", F.lit(math.ceil(max(total["rows"] or 0, 1) / TASK_ROWS))).alias("chunk")
    of_heavy = slim.join(placed_heavy, "key").select("rid", chunk, F.get("shards", F.pmod("salt", F.size("shards")).cast("int")).alias("shard"))
    of_light = slim.join(placed_heavy, "key", "left_anti").join(placed_light, "key").select("rid", chunk, "shard")
    placed = staged(of_heavy.unionByName(of_light), "shards")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(_upto("shard", "chunk")) - F.col("n")).alias("before"))
    local = placed.select("rid", "shard", "chunk", (F.row_number().over(_upto(["shard", "chunk"], "rid")) - 1).alias("local"))
    slots = local.join(before, ["shard", "chunk"]).select(F.col("rid").alias(rid), F.col("shard").alias(names["shard"]), (F.col("before") + F.col("local")).cast("long").alias(names["slot"]))
    return full.join(slots, rid).select(*held, *names.values())


def _upto(by: str | list[str], order: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows by slot; a shard's rows may take several files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
