"""Filling containers of fixed capacity by sum-of-squares packing.

An item goes where the sum over all gaps of the squared number of open containers with that gap becomes smallest. The
items are dealt by a hash of their key into blocks of bounded size and each block is packed by itself, so no task
holds more than a block; what that costs is the few containers a block leaves partly empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import token_counts

#: Items in a block, on average.
BLOCK_ITEMS = 60_000
#: The kinds of container are a short list of parameters, each of which every item is packed for.
MOST_KINDS = 100


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item (sizes from 1 to capacity, taken in the given order) and how many were opened.

    With c(g) open containers of gap g, putting size s into gap g changes the sum of squares by 2 (c(g-s) - c(g)) + 2,
    or by 1 - 2 c(g) where it fills the container (full ones aren't counted), a new container by 2 c(capacity-s) + 1.
    Ties go to the smaller gap, and to an open container before a new one.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    home = np.empty(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        there = count[s:]
        change = 2 * (count[: capacity + 1 - s] - there) + 2
        change[0] = 1 - 2 * there[0]
        change[there == 0] = np.iinfo(np.int64).max
        k = int(change.argmin())
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if there[k] and change[k] <= fresh:
            gap = s + k
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        home[i] = b
        if left := gap - s:
            open_at[left].append(b)
            count[left] += 1
    return home, made


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Sum-of-squares packing of the items as they come and from the largest down; the better of the two."""
    best = sum_of_squares(sizes, capacity)
    order = np.argsort(-sizes, kind="stable")
    home, made = sum_of_squares(sizes[order], capacity)
    if made < best[1]:
        back = np.empty(len(sizes), np.int64)
        back[order] = home
        best = back, made
    return best


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", block_items: int = BLOCK_ITEMS, count: int | None = None) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, first_token, n_tokens) for every item and kind of container.

    An item larger than the capacity is cut into full pieces and a rest; no other is cut. Items of size 0 or null need
    no room: they come out with a null container_id, piece 0 and 0 tokens. Kinds with a null or non-positive capacity
    are left out. Repeated rows are items of their own. Empty tables give an empty result.
    """
    n = items.count() if count is None else count
    blocks = max(1, -(-n // block_items))
    kinds = containers.where(F.col("capacity") > 0).select("container_kind", F.col("capacity").cast("long")).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    kind = items.schema[key].dataType.simpleString()
    schema = f"container_kind string, container_id string, doc_id {kind}, piece bigint, first_token bigint, n_tokens bigint"
    if not kinds:
        return items.sparkSession.createDataFrame([], schema)
    sized = items.select(F.col(key).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    choices = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds])
    each = sized.select("doc_id", "size", F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).alias("block"), F.inline(choices))

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name, block = group[0], int(group[1])
        capacity = int(frame["capacity"].iloc[0])
        frame = frame.sort_values(["doc_id", "size"], kind="stable").reset_index(drop=True)
        sizes = frame["size"].to_numpy()
        pieces = np.maximum(1, -(-sizes // capacity))
        row = np.repeat(np.arange(len(frame)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = piece * capacity
        part = np.minimum(sizes[row] - first, capacity)
        home = np.full(len(row), -1, np.int64)
        some = part > 0
        home[some], _ = pack_block(part[some], capacity)
        ids = pd.Series([f"{name}-{block}-{h}" if h >= 0 else None for h in home], dtype=object)
        return pd.DataFrame({"container_kind": name, "container_id": ids, "doc_id": frame["doc_id"].to_numpy()[row], "piece": piece, "first_token": first, "n_tokens": part})

    # As many partitions as groups, by number, so that small groups are not gathered into one long task.
    return each.repartition(2 * blocks * len(kinds), "container_kind", "block").groupBy("container_kind", "block").applyInPandas(run, schema)


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``pack`` of the documents, sized in tokens of a public tokenizer."""
    return pack(token_counts(documents, vocabulary=vocabulary), containers, block_items=block_items, count=documents.count())


def report(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, fill): how many containers are used and how full they are, per kind."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    return per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
