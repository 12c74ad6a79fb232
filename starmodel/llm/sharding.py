"""Sharding: indivisible groups of equal texts packed best-fit-decreasing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import materialize, numbered


@dataclass
class _Node:
    key: tuple
    left: _Node | None = None
    right: _Node | None = None
    level: int = 1


class BinTree:
    """Bins by (room, bin) in a balanced (AA) tree."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, room: int, bin_: int) -> None:
        self.root = self._add(self.root, (room, bin_))

    def take(self, size: int) -> tuple | None:
        """Removes and returns the bin with the least room of at least `size`."""
        best, node = None, self.root
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self.root = self._remove(self.root, best)
        return best

    def take_roomiest(self) -> tuple | None:
        node = self.root
        while node and node.right:
            node = node.right
        if node is None:
            return None
        self.root = self._remove(self.root, node.key)
        return node.key

    def _add(self, t: _Node | None, key: tuple) -> _Node:
        if t is None:
            return _Node(key)
        if key < t.key:
            t.left = self._add(t.left, key)
        else:
            t.right = self._add(t.right, key)
        return _split(_skew(t))

    def _remove(self, t: _Node | None, key: tuple) -> _Node | None:
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None or t.right is None:
            return t.left or t.right
        else:
            low = t.right
            while low.left:
                low = low.left
            t.key = low.key
            t.right = self._remove(t.right, low.key)
        least = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
        if least < t.level:
            t.level = least
            if t.right and t.right.level > least:
                t.right.level = least
        t = _skew(t)
        if t.right:
            t.right = _skew(t.right)
            if t.right.right:
                t.right.right = _skew(t.right.right)
        t = _split(t)
        if t.right:
            t.right = _split(t.right)
        return t


def _skew(t: _Node) -> _Node:
    if t.left and t.left.level == t.level:
        low = t.left
        t.left, low.right = low.right, t
        return low
    return t


def _split(t: _Node) -> _Node:
    if t.right and t.right.right and t.right.right.level == t.level:
        mid = t.right
        t.right, mid.left = mid.left, t
        mid.level += 1
        return mid
    return t


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, bins: int | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Best-fit-decreasing of `runs` (size, number), largest first: the bins of
    the items in their order as (number, bin), and the room left in each bin. The
    tightest bin that an item fits into stays the tightest for the next of the
    same size, so it takes as many as it has room for in one step. With `bins`
    None a size that fits nowhere opens a bin (one that is larger than the
    capacity has a bin for itself); else there are that many bins, and it enters
    the roomiest, which may then hold more than its share."""
    tree, rooms = BinTree(), []
    placed: list[tuple[int, int]] = []
    for _ in range(bins or 0):
        tree.add(capacity, len(rooms))
        rooms.append(capacity)
    for size, n in runs:
        while n:
            found = tree.take(size)
            if found is None and bins is not None:
                found = tree.take_roomiest()
            if found is None:
                rooms.append(capacity)
                found = (capacity, len(rooms) - 1)
            room, at = found
            take = max(1, min(n, room // size))
            rooms[at] = room - take * size
            tree.add(rooms[at], at)
            if placed and placed[-1][1] == at:
                placed[-1] = (placed[-1][0] + take, at)
            else:
                placed.append((take, at))
            n -= take
    return placed, rooms


def even_capacity(total: int, runs: list[tuple[int, int]], shards: int) -> int:
    """The even share of a shard, beside groups that are larger than a share."""
    rest, left = total, shards
    for size, n in runs:
        while n and left > 1 and size * left > rest:
            rest, left, n = rest - size, left - 1, n - 1
        if n:
            break
    return max(1, -(-rest // left))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """Each row of `docs` as `doc_id`, `size` (UTF-8 bytes + 1), `text_crc32`,
    `shard`, `slot`. Rows with equal texts (null and empty alike) form a group
    and share a shard; slots number a shard's rows from 0 by id. Other columns of
    `docs`, whatever their names, have no part in it; an empty table gives no rows.

    Best-fit-decreasing over all groups through a balanced tree of bins by room.
    Groups of the same size are alike, so the driver needs only how many there
    are of each size (as the sizes differ, there are at most the square root of
    twice the bytes of them; in texts some ten thousand), and gives back which
    bin each stretch of the groups in falling size enters. Groups are numbered in
    that order in Spark, by range. A group that is larger than a share is alone
    where it is. With `capacity`, shards of that many bytes are opened as needed
    (`shards` is ignored).

    A group with a third of the rows is one row of the table of groups; only the
    join of rows to their groups is skewed, which adaptive execution splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_text"), F.monotonically_increasing_id().alias("_row")), "shard-rows"
    )
    groups = materialize(rows.groupBy("_text").agg(F.sum("size").alias("_bytes")), "shard-groups")
    found = groups.groupBy("_bytes").agg(F.count("*").alias("n")).toArrow().to_pydict()
    runs = sorted(zip(found["_bytes"], found["n"]), reverse=True)
    share = capacity or even_capacity(sum(size * n for size, n in runs), runs, shards)
    placed, _ = best_fit_decreasing(runs, share, None if capacity else shards)
    ends, bins = np.cumsum([n for n, _ in placed]), np.array([b for _, b in placed], np.int32)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_text": pdf["_text"], "shard": bins[np.searchsorted(ends, pdf["_at"].to_numpy(), side="right")]})

    at = numbered(groups.withColumn("_less", -F.col("_bytes")), ["_less", "_text"], None, "_at")
    out = materialize(rows.join(at.select("_text", "_at").mapInPandas(put, "_text binary, shard int"), "_text").drop("_text"), "sharded")
    out = numbered(out, ["doc_id", "_row"], None, "slot", "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
