"""Near-duplicate documents by similarity: SimHash trees propose, shingles decide.

At a similarity of 0.8 of their five-word shingles two fingerprints of 64 bits
differ in about ten bits, more than parts of a fingerprint that stay alike can
find. So the shards that hold the BK-trees are keyed by bands of min-hashes, the
trees are searched within a wide radius, and what they propose is checked
against the whole sets of shingles. Whatever this leaves apart is decided by a
prefix join of the sets, so what the trees propose decides how soon a group is
joined, not whether it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmodel.llm import jaccard_join
from starmodel.llm.common import materialize, sift, unpacked, whole_row
from starmodel.llm.components import components
from starmodel.llm.simhash import BKTree, fingerprint

#: Of a pair at 0.8, one in 400 has no band in common, and is left to the join.
BANDS, ROWS = 8, 3
#: Bits: how far the trees are searched, and how far leaders are apart.
REACH, LEAD = 20, 12
NEAREST = 3
#: Texts of a tree at most, in the mean; larger shards are cut.
PART = 512


def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of min-hashes; none without shingles."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        np.minimum(least, (multipliers * hashes[None, at : at + (1 << 14)]).min(axis=1), out=least)
    return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each value of `keys`, which follow each other in the batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for k in keys:
            x = pdf[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        if held and any(held[-1][k].iat[-1] != pdf[k].iat[0] for k in keys):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        starts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        for a, b in zip(starts[:-1], starts[1:]):
            held.append(pdf.iloc[a:b])
            if b < len(pdf):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _frames(pairs: Iterator[tuple[bytes, bytes]], size: int = 10_000) -> Iterator[pd.DataFrame]:
    out: list[tuple[bytes, bytes]] = []
    for pair in pairs:
        out.append(pair)
        if len(out) >= size:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])


def _proposed(keyed: DataFrame, similarity: float) -> DataFrame:
    """Pairs `a`, `b` of `whole` that are likely links, a few for each row of
    `keyed` (`whole`, `fp`, `n`, `band`, `key`, and `m`, the classes with that key). A shard is the classes with a
    band in common, those that share bands with the most others first: an
    original comes before its copies. A class is paired with the first and with
    the nearest leaders within REACH; without a leader within LEAD it becomes one.
    A shard of over PART classes is cut by hash, and its first class is in every part."""
    shards = keyed.withColumn("degree", F.sum("m").over(Window.partitionBy("whole")))
    shards = shards.withColumn("parts", F.ceil(F.col("m") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("whole", "band"), F.col("parts")).cast("int"))
    columns = ["band", "key", "part", "degree", "whole", "fp", "n"]
    shards = materialize(shards.select(*columns, "parts"), "near-keyed")
    first = shards.where("parts > 1").groupBy("band", "key").agg(F.max("parts").alias("parts"), F.min_by(F.struct("degree", "whole", "fp", "n", "part"), F.struct(-F.col("degree"), "whole")).alias("x"))
    first = first.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x.degree", "x.whole", "x.fp", "x.n", F.col("x.part").alias("own")).where("part <> own")

    def search(pdf: pd.DataFrame) -> Iterator[tuple[bytes, bytes]]:
        names, ns, leaders = pdf["whole"].tolist(), pdf["n"].tolist(), BKTree()
        for at, fp in enumerate(pdf["fp"].to_numpy().view(np.uint64).tolist()):
            near = sorted(leaders.search(fp, REACH), key=lambda x: (x[0], x[2]))
            for other in {0, *(x[2] for x in near[:NEAREST])} - {at}:
                if min(ns[at], ns[other]) >= similarity * max(ns[at], ns[other]):
                    yield min(names[at], names[other]), max(names[at], names[other])
            if not near or near[0][0] > LEAD:
                leaders.add(fp, at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(pair for pdf in _groups(batches, ["band", "key", "part"]) if len(pdf) > 1 for pair in search(pdf))

    dealt = shards.select(*columns).unionByName(first.select(*columns)).repartition("band", "key", "part")
    return dealt.sortWithinPartitions("band", "key", "part", F.desc("degree"), "whole").mapInPandas(run, "a binary, b binary").distinct()


def near_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A description of each row of `docs` (`id`, `mark`, `whole`, `root`): rows
    with the same `root` are joined by a path of links, a link being two texts
    with at least `similarity` (in whole percents) of all their distinct shingles in
    common. Also the links between different sets of shingles (`a`, `b`).

    Texts with equal sets become one class before anything is paired, so exact
    copies are one row. Texts of fewer words than a shingle are one shingle; null,
    empty and blank texts are one class. Other columns of `docs` take no part,
    whatever their names; an empty table gives empty ones.
    """
    percent, multipliers = round(100 * similarity), _multipliers()[:, None]

    def more(hashes: np.ndarray) -> tuple[int, np.ndarray]:
        return int(np.array([fingerprint(hashes)], np.uint64).view(np.int64)[0]), _bands(hashes, multipliers)

    described = materialize(jaccard_join.describe(docs, size, percent, id_col, text_col, {"fp": "long", "bands": "array<long>"}, more), "near-described")
    classes = materialize(described.select("whole", "fp", "n", "bands").dropDuplicates(["whole"]), "near-classes")
    keyed = classes.select("whole", "fp", "n", F.posexplode("bands").alias("band", "key"))
    crowded = keyed.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    keyed = materialize(keyed.join(crowded, ["band", "key"]), "near-bands")
    links = jaccard_join.jaccard_links(docs, described, size, percent, id_col, text_col, proposed=_proposed(keyed, similarity))
    roots = materialize(components(links, "a", "b").withColumnRenamed("node", "whole"), "near-roots")
    out = described.select("id", "mark", "whole").join(roots, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    return out, links


def first_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, that stay: of each group of near
    duplicates the one with the smallest id (a null id last, then by a hash of
    the text). Repeated rows, with the same id and text, are one."""
    grouped, _ = near_classes(docs, size, similarity, id_col, text_col)
    grouped = materialize(grouped, "near-grouped")
    order = F.struct(F.col("id").isNull(), "id", "mark")
    stay = materialize(grouped.groupBy("root").agg(F.min(order).alias("s"), F.count("*").alias("n")).where("n > 1").select("root", "s"), "near-stay")
    stays = F.col("id").eqNullSafe(F.col("s.id")) & (F.col("mark") == F.col("s.mark"))
    gone = materialize(sift(grouped, "root", stay).join(stay, "root").where(~stays).select(F.col("id").alias("_id"), F.col("mark").alias("_gone")), "near-gone")
    marked = docs.select(whole_row(docs).alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark"))
    # few rows go, and only those that may be among them are shuffled
    there = gone.withColumnRenamed("_id", "_gone_id")
    unsure = sift(marked, "_id", gone).join(there, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_mark") == F.col("_gone")), "left_anti")
    out = sift(marked, "_id", gone, "left_anti").unionByName(unsure)
    repeated = grouped.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (out.dropDuplicates(["_id", "_mark"]) if repeated else out).select(*unpacked(docs))
