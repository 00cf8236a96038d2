"""Filling containers of fixed capacity with texts, by sum-of-squares packing.

A container that is partly filled has a level. The next text goes to the level (or into
a new container) which makes the sum of the squared numbers of containers at each level
smallest; that keeps all levels in use and so finds a fit for what comes. The state is
one array of counts by level. Texts are spread over blocks by hash; each block is packed
on its own, and wastes at most what its last few containers leave open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions_for

#: Texts of a block, about.
BLOCK = 20_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0 in the order of opening. Items are at most capacity large; an item of size 0 goes into container 0."""
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(sizes), np.int64)
    opened = 0
    never = np.int64(1) << 40
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        new = 2 * count[s] + 1 if s < capacity else 0
        best, level = new, 0
        if s < capacity:
            here = count[1 : capacity - s + 1]
            change = count[1 + s : capacity + 1] - here
            change *= 2
            change += 2
            change[-1] -= 1 + 2 * count[capacity]
            change[here == 0] = never
            k = len(change) - 1 - int(change[::-1].argmin())
            if change[k] <= best:
                level = k + 1
        if level:
            c = open_at[level].pop()
            count[level] -= 1
        else:
            c = opened
            opened += 1
        out[i] = c
        if level + s < capacity:
            count[level + s] += 1
            open_at[level + s].append(c)
    return out


def containers(sized: DataFrame, sizes: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", name: str = "size_name", capacity: str = "capacity_tokens", block: int = BLOCK) -> DataFrame:
    """name, key, piece, first_token, n_tokens, container: the container of each text or piece, for each capacity.

    A text larger than the capacity is cut into pieces that fill a container each, and
    the rest is packed like a text. Container numbers are unique for a capacity. Texts
    without tokens share a container of their block. sizes is a small table of
    parameters (one row a capacity); capacities that are null or below 1 give no rows.
    Rows with a null key are packed too. The result depends on the texts only, not on
    how they are spread or on a task that is repeated.
    """
    caps = [(r[0], int(r[1])) for r in sizes.select(name, capacity).distinct().orderBy(name, capacity).collect() if r[1] and r[1] > 0]
    blocks = max(1, -(-sized.count() // block))
    items = sized.select(F.col(key).alias("key"), F.col(tokens).cast("long").alias("n"))
    items = items.withColumn("block", F.pmod(F.xxhash64("key", F.when(F.col("key").isNull(), F.col("n"))), F.lit(blocks)).cast("int"))
    kind = dict(sized.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        # a fixed order that is none of the sizes: online packing gains from a mix
        pdf = pdf.assign(h=pd.util.hash_array(pdf["key"].to_numpy()) if len(pdf) else []).sort_values(["h", "key", "n"], kind="stable")
        n = pdf["n"].to_numpy(np.int64)
        keys = pdf["key"].to_numpy()
        out = []
        for label, cap in caps:
            whole, rest = n // cap, n % cap
            whole, rest = np.where((rest == 0) & (whole > 0), whole - 1, whole), np.where((rest == 0) & (n > 0), cap, rest)
            packed = pack(rest, cap)
            used = int(packed.max()) + 1 if len(packed) else 0
            pieces = whole + 1
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            last = piece == whole[row]
            where = np.where(last, packed[row], used + np.cumsum(~last) - 1)
            out.append(pd.DataFrame({"name": label, "key": keys[row], "piece": piece, "first_token": piece * cap, "n": np.where(last, rest[row], cap), "container": (np.int64(block) << 32) + where}))
        return pd.concat(out) if out else pd.DataFrame(columns=["name", "key", "piece", "first_token", "n", "container"])

    items = items.repartition(partitions_for(sized.sparkSession, blocks), "block")
    got = items.groupBy("block").applyInPandas(run, f"name string, key {kind}, piece long, first_token long, n long, container long")
    return got.select(F.col("name").alias(name), F.col("key").alias(key), "piece", "first_token", F.col("n").alias(tokens), "container")


def fill(packed: DataFrame, sizes: DataFrame, name: str = "size_name", capacity: str = "capacity_tokens", tokens: str = "n_tokens") -> DataFrame:
    """name, capacity, containers, tokens, fill: how full the containers are (fill: share of the room used)."""
    per = packed.groupBy(name, "container").agg(F.sum(tokens).alias("t"))
    total = per.groupBy(name).agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return total.join(F.broadcast(sizes.select(name, capacity).distinct()), name).select(name, capacity, "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col(capacity)), 6).alias("fill"))
