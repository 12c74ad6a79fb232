"""SimHash fingerprints, and near-duplicate groups found in BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import materialize, words
from starmodel.llm.components import components

#: The fingerprint's parts; links of at most PARTS - 2 bits leave two parts as they are.
PARTS = 4
WIDTH = 64 // PARTS
#: Fingerprints in one shard tree at most.
SHARD = 2048


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words, repeats included; of the
    whole sequence where there are fewer words; none for none."""
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(w) - size + 1)
    last = ends[min(size, len(w)) - 1 :] - 1
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last[:n].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text's bits are summed part by part
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


class BKTree:
    """Integers as a tree: a child hangs at its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, tag) -> None:
        if self.root is None:
            self.root = [value, tag, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            nxt = node[2].get(d)
            if nxt is None:
                node[2][d] = [value, tag, {}]
                return
            node = nxt

    def search(self, value: int, radius: int) -> list[tuple[int, int, object]]:
        """(distance, value, tag) of all within the radius."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append((d, node[0], node[1]))
            children = node[2]
            if len(children) <= 2 * radius + 1:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp`: each row's fingerprint as a signed long."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(make, "doc_id long, fp long")


def links(fps: DataFrame, radius: int, salt: int = SHARD) -> DataFrame:
    """Links `a`, `b` between the different fingerprints of `fps` (column `fp`,
    unique) that differ in at most `radius` (up to 2) bits. The links of a tree
    are not all returned where they lead around a circle, but any two
    fingerprints within the radius are joined by a path of links.

    Of four 16-bit parts at least two are alike in such a pair, so each
    fingerprint goes under its six pairs of parts. All with the same key are a
    shard, held as one BK-tree. A key's trees are cut to `salt` fingerprints and
    sent, by a shuffle, to each block of the key's fingerprints that searches
    them; so neither a tree nor a task grows with the input.
    """
    if radius > PARTS - 2:
        raise ValueError(f"radius must be at most {PARTS - 2}")
    part = lambda i: F.shiftrightunsigned("fp", i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
    keys = [F.struct(F.lit(n).alias("n"), (part(i) * F.lit(1 << WIDTH) + part(j)).alias("v")) for n, (i, j) in enumerate(combinations(range(PARTS), 2))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / salt).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a row goes to each pair of blocks that has its own block in it
    there = keyed.join(counts, "key").withColumn("own", block)
    there = there.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    there = there.select("fp", "own", F.col("key.n").alias("n"), F.col("key.v").alias("v"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def search(keys: tuple, values: list[tuple[int, int]], out: list) -> None:
        lo, hi = keys[2], keys[3]
        tree, root = BKTree(), {}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def join(x: int, y: int) -> None:
            a, b = top(x), top(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))

        for fp, own in values:
            root[fp] = fp
        for fp, own in values:
            if own == lo:
                if lo == hi:
                    for _, near, _ in tree.search(fp, radius):
                        join(fp, near)
                tree.add(fp, None)
        if lo != hi:
            for fp, own in values:
                if own == hi:
                    for _, near, _ in tree.search(fp, radius):
                        join(fp, near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for pdf in batches:
            rows = zip(pdf["n"].tolist(), pdf["v"].tolist(), pdf["lo"].tolist(), pdf["hi"].tolist(), pdf["fp"].to_numpy().view(np.uint64).tolist(), pdf["own"].tolist())
            for n, v, lo, hi, fp, own in rows:
                if (n, v, lo, hi) != now:
                    if len(held) > 1:
                        search(now, held, out)
                    now, held = (n, v, lo, hi), []
                held.append((fp, own))
            if len(out) > 10_000:
                yield frame(out)
                out = []
        if len(held) > 1:
            search(now, held, out)
        yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = there.repartition("n", "v", "lo", "hi").sortWithinPartitions("n", "v", "lo", "hi", "fp")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of `docs` as `doc_id`, `fp` (a signed long), `fingerprint` (16
    hex digits), `component_id`: the smallest id among rows whose fingerprints
    lead to its own over links of at most `radius` bits.

    Equal fingerprints (exact copies among them) become one row with their
    smallest id before anything is linked, so a large group of copies is one
    row. Null and empty texts have fingerprint zero and link like any other. Ids
    may repeat; a null id has a component like any other and is never the
    smallest unless all ids are null.
    """
    made = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    linked = components(links(classes.select("fp"), radius), "a", "b")
    roots = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(smallest, "root").select("fp", "component_id")
    out = made.join(ids, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
