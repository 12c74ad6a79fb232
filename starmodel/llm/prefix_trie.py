"""The trie of conversations' shared beginnings, over a skeleton of splitters.

Each conversation is a path: a digest of 16 bytes for each turn. Paths are dealt
by range between splitters, which come from a sample. A node whose members are
on both sides of a splitter is a prefix of it, so the trie of the splitters (the
skeleton) holds all nodes that several shards have a part of. Each shard sorts
its own paths and finishes all other nodes; of the skeleton's nodes it gives
partial sums, which are added up, and carried from the leaves to the root."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import materialize

#: Bytes of a turn's digest.
STEP = 16
#: Turns of a shard, in the mean, and paths that are sampled for each splitter.
SHARD, SAMPLED = 100_000, 16
#: Shards at most; beyond that they grow.
SHARDS = 4_000
#: Bytes of decimal ids in one row that is sent on.
PIECE = 1 << 18

_PATHS = "conv_id long, path binary, sizes array<long>"
_NODES = (
    "skeleton int, conv_id long, depth long, parent_conv_id long, parent int, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends binary, piece binary, shard int, at int"
)


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, most: int = 9) -> DataFrame:
    """`conv_id`, `path` (a digest of each turn after the other), `sizes` (UTF-8
    bytes of their texts) of the rebuilt conversations: the first h turns of
    conversation c - c % family, then c's own after its first h; h is the crc32 of
    c's digits modulo `most`.

    Turns are in the order of `turn_col`, null first, then of their digests, so
    ties have one order and repeated rows stay. Null roles and texts are empty;
    rows without a conversation's id take no part. Texts are not shuffled: a
    family's digests meet in one task. A conversation is one row of 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, STEP)
    given = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t")
    )
    given = given.withColumn("base", F.col("c") - F.col("c") % family).repartition("base")
    own = given.groupBy("base", "c").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Families follow each other; within one the base comes first."""
        base, head = None, []
        for pdf in batches:
            out = []
            for b, c, ts in zip(pdf["base"].tolist(), pdf["c"].tolist(), pdf["t"]):
                ts = [(x["digest"], x["size"]) for x in ts]
                if b != base:
                    base, head = b, ts[: most - 1] if c == b else []
                h = zlib.crc32(str(c).encode()) % most
                whole = head[:h] + ts[h:]
                out.append((c, b"".join(d for d, _ in whole), [s for _, s in whole]))
            yield pd.DataFrame(out, columns=["conv_id", "path", "sizes"])

    return own.sortWithinPartitions("base", F.col("c") != F.col("base"), "c").mapInPandas(rebuild, _PATHS)


def _common(a: bytes, b: bytes) -> int:
    """The number of turns that two paths begin with alike."""
    n = min(len(a), len(b)) // STEP
    if a[: n * STEP] == b[: n * STEP]:
        return n
    lo, hi = 0, n - 1  # alike up to lo, not up to hi + 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * STEP] == b[: mid * STEP]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def splitters(table: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most `shards` - 1 places (path, conv_id) that cut `table` into parts of
    about the same number of turns, from SAMPLED paths for each (those whose ids
    have the smallest hashes). Between two sampled paths the shortest path that
    tells them apart is taken, so a splitter is one turn longer than what they share."""
    n = table.count()
    if shards <= 1 or not n:
        return []
    share = min(1.0, shards * SAMPLED / n)
    some = table.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    found: list[tuple[bytes, int]] = []
    # each splitter needs its neighbour only: sorted by Spark, and read one after the other
    weight = F.size("sizes") + 1
    total = some.agg(F.sum(weight)).first()[0] or 0
    before, seen, cut = None, 0, 1
    for path, conv, w in some.select("path", "conv_id", weight.alias("w")).orderBy("path", "conv_id").toLocalIterator():
        path = bytes(path)
        if before is not None and seen * shards >= cut * total:
            keep = _common(before[0], path) + 1
            found.append((path[: keep * STEP], conv if keep * STEP > len(path) else -(1 << 63)))
            cut = seen * shards // total + 1
        before, seen = (path, conv), seen + w
    return sorted(set(found))


class Skeleton:
    """The trie of the splitters' paths: its nodes are numbered, the root is 0."""

    def __init__(self, places: list[tuple[bytes, int]]) -> None:
        self.places = places
        self.step: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in places:
            node = 0
            for at in range(0, len(path), STEP):
                key = (node, path[at : at + STEP])
                if key not in self.step:
                    self.step[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.step[key]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.places, (path, conv))


class _Shard:
    """The nodes of one shard, whose rows come in the order of path and conv_id."""

    def __init__(self, skeleton: Skeleton, number: int) -> None:
        self.skeleton, self.number = skeleton, number
        self.rows: list[list] = []  # finished or not, children after their parents
        self.open = [self._node(0, -1, 0, 0)]
        self.before = b""
        self.ended: tuple[int, object] | None = None
        self.ends: dict[int, list] = {}
        self.pieces: list[tuple[int, bytes]] = []

    def _node(self, skeleton: int, parent: int, depth: int, size: int) -> int:
        # skeleton or -1, conv_id, depth, parent's row, n_convs, n_children, n_leaves, saved, bytes
        self.rows.append([skeleton, None, depth, parent, 0, 0, 0, 0, size])
        return len(self.rows) - 1

    def add(self, conv: int, path: bytes, sizes) -> None:
        depth = len(path) // STEP
        keep = min(_common(self.before, path), len(self.open) - 1)
        del self.open[keep + 1 :]
        for at in range(keep, depth):
            parent = self.open[-1]
            inside = self.rows[parent][0]
            skeleton = self.skeleton.step.get((inside, path[at * STEP : (at + 1) * STEP]), -1) if inside >= 0 else -1
            self.open.append(self._node(skeleton, parent, at + 1, int(sizes[at])))
            if skeleton < 0:
                self.rows[parent][5] += 1
        for node in self.open:
            row = self.rows[node]
            row[4] += 1
            if row[1] is None or conv < row[1]:
                row[1] = conv
        node = self.open[-1]
        text = str(conv).encode()
        if self.rows[node][0] < 0:  # equal paths follow each other, by id
            if node in self.ends:
                self.ends[node].update(b"," + text)
            else:
                self.ends[node] = hashlib.sha256(text)
        else:
            held = self.ends.setdefault(node, [])
            held.append(text)
            if len(held) * 12 > PIECE:
                self.pieces.append((node, b",".join(held)))
                held.clear()
        self.before = path

    def result(self) -> Iterator[pd.DataFrame]:
        empty = hashlib.sha256(b"").digest()
        out = []
        for node in range(len(self.rows) - 1, -1, -1):  # children before their parents
            skeleton, conv, depth, parent, n, children, leaves, saved, size = row = self.rows[node]
            if skeleton < 0:
                row[6] = leaves = leaves or 1
                row[7] = saved = saved + (n - 1) * size
                self.rows[parent][6] += leaves
                self.rows[parent][7] += saved
            elif node in self.ends and self.ends[node]:
                self.pieces.append((node, b",".join(self.ends[node])))
        for node, (skeleton, conv, depth, parent, n, children, leaves, saved, size) in enumerate(self.rows):
            if not n:
                continue
            up = self.rows[parent] if parent >= 0 else [0, None]
            ends = None if skeleton >= 0 else self.ends[node].digest() if node in self.ends else empty
            out.append((skeleton if skeleton >= 0 else None, conv, depth, None if skeleton >= 0 or up[0] >= 0 else up[1], None if skeleton >= 0 or up[0] < 0 else up[0], n, children, leaves, saved, size, ends, None, self.number, 0))
            if len(out) >= 20_000:
                yield _frame(out)
                out = []
        for at, (node, piece) in enumerate(self.pieces):
            out.append((self.rows[node][0], None, self.rows[node][2], None, None, 0, 0, 0, 0, 0, None, piece, self.number, at))
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in _NODES.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("skeleton", "parent"):
        out[c] = out[c].astype("Int32")
    for c in ("conv_id", "parent_conv_id"):
        out[c] = pd.array([None if x is None else x for x in (r[names.index(c)] for r in rows)], dtype="Int64")
    return out


def prefix_trie(turns: DataFrame, shard: int = SHARD, **columns) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see `paths`):
    `conv_id` (its smallest member), `depth`, `parent_conv_id` (null for the
    root), `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.

    Conversations without turns, and those that are rebuilt to none, are members
    of the root only; an empty table has no node. Repeated rows are turns of their
    own. A large group of equal conversations is cut by id like any other range;
    what is sent of it are its ids, in pieces, of which one digest is made piece by
    piece. A shard has about `shard` turns, so its nodes fit in memory."""
    spark = turns.sparkSession
    table = materialize(paths(turns, **columns), "trie-paths")
    turns_there = table.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = int(min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns_there // shard))))
    skeleton = Skeleton(splitters(table, shards))
    sent = spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["shard"] = np.fromiter(map(sent.value.shard, map(bytes, pdf["path"]), pdf["conv_id"].tolist()), np.int32, len(pdf))
            yield pdf

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            for n, conv, path, sizes in zip(pdf["shard"].tolist(), pdf["conv_id"].tolist(), pdf["path"], pdf["sizes"]):
                if now is None or n != now.number:
                    if now is not None:
                        yield from now.result()
                    now = _Shard(sent.value, n)
                now.add(conv, bytes(path), sizes)
        if now is not None:
            yield from now.result()

    dealt = table.mapInPandas(deal, f"{_PATHS}, shard int").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    nodes = materialize(dealt.mapInPandas(finish, _NODES), "trie-nodes")
    return _combined(nodes, skeleton)


def _combined(nodes: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The shards' own nodes, and the skeleton's from their parts."""
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast((skeleton.parent, skeleton.depth))
    parts = nodes.where("skeleton IS NOT NULL AND piece IS NULL").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("bytes").alias("bytes")
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, None
        for pdf in batches:
            for node, piece in zip(pdf["skeleton"].tolist(), pdf["piece"]):
                if node != now:
                    if made is not None:
                        yield pd.DataFrame({"skeleton": [now], "ends": [made.digest()]})
                    now, made = node, hashlib.sha256(piece)
                else:
                    made.update(b",")
                    made.update(piece)
        if made is not None:
            yield pd.DataFrame({"skeleton": [now], "ends": [made.digest()]})

    pieces = nodes.where("piece IS NOT NULL").select("skeleton", "shard", "at", "piece").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "at")
    parts = parts.join(pieces.mapInPandas(digest, "skeleton int, ends binary"), "skeleton", "left")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From the leaves to the root: a node's number is above its parent's.
        The skeleton's nodes are no more than its splitters' turns."""
        parent, depth = sent.value
        there = {r[0]: list(r[1:]) for pdf in batches for r in pdf.itertuples(index=False, name=None)}
        children: dict[int, int] = {}
        for node in sorted(there, reverse=True):
            row = there[node]
            row[2] += children.get(node, 0)
            row[3] = row[3] if row[2] else 1
            row[4] += (row[1] - 1) * row[5]
            if (up := parent[node]) >= 0:
                children[up] = children.get(up, 0) + 1
                there[up][3] += row[3]
                there[up][4] += row[4]
        out = [(n, r[0], depth[n], there[parent[n]][0] if parent[n] >= 0 else None, *r[1:5], r[6]) for n, r in there.items()]
        pdf = pd.DataFrame(out, columns=["skeleton", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"])
        pdf["parent_conv_id"] = pd.array([r[3] for r in out], dtype="Int64")
        yield pdf

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    kinds = "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
    top = materialize(parts.select("skeleton", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes", "ends").coalesce(1).mapInPandas(carry, kinds), "trie-skeleton")
    known = F.broadcast(top.select(F.col("skeleton").alias("_s"), F.col("conv_id").alias("_c")))
    own = nodes.where("skeleton IS NULL").join(known, F.col("parent") == F.col("_s"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_c"))
    out = own.select(*columns).unionByName(top.select(*columns))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*columns[:-1], F.coalesce(F.lower(F.hex("ends")), none).alias("ends_sha256"))
