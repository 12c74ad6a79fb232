"""Documents whose shingles are alike, by a grouped prefix join.

A document's shingles are put in one order for all, rare ones first; two sets that
are alike enough share a shingle among the first few of each (their prefixes).
Documents with the same prefix and number of shingles are one group, and groups are
what is paired: by shared prefix shingles, sizes, and how much can still follow.
Pairs of groups are expanded to their members, which are compared in full.

Only components are asked for, so pairs that are joined already need no more
comparing. First each group is tried with a few likely partners, in a few rounds;
then all pairs whose members are still apart are compared, without exception."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmodel.llm.common import materialize, sift, small, words
from starmodel.llm.components import components

#: Shingles are counted by the first 32 bits of their hash, in 1024 segments of
#: 16 MB; what is sent to all tasks is a byte for each 256 counters: 16 MB whatever the input.
SEGMENTS, FOLD = 1024, 256
#: Counters of a segment, and tasks that count.
COUNTERS, COUNTING = (1 << 32) // SEGMENTS, 256
#: Shingles that a task counts before it passes them on.
CHUNK = 1 << 20
#: Groups with a shingle in common that are put side by side in one task, in the mean.
LIST = 512
#: With how many likely partners a group is tried, in each round before the rest.
LIKELY = (2, 1)
#: While more pairs than so many for each set are left, each set is tried with a FEW first.
MANY, FEW = 8, 3
#: Words whose hashes a task keeps.
KEPT = 1 << 17

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Words(dict):
    """Hashes of words, as they come."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxh64_intdigest(word, 7)
        return found


def shingles(text: str | None, size: int, known: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words; of the whole
    sequence where there are fewer words; none for none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    used = min(size, len(w))
    n = len(w) - used + 1
    out = np.full(n, used, np.uint64)
    for k in range(used):  # the order of the words counts
        out = (out ^ hashes[k : k + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    for m in _MIX[1:]:
        out = (out ^ (out >> np.uint64(30))) * m
    return np.unique(out ^ (out >> np.uint64(31)))


def frequencies(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """For each of 2^32 / FOLD ranges of hashes the binary logarithm of
    how many documents have the most frequent shingle in it, as bytes. Tasks pass
    sorted hashes on as differences, byte by byte, which takes two to three bytes
    each; a segment is counted in 16 MB however many there are."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, n = _Words(), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                held.append((shingles(text, size, known) >> np.uint64(32)).astype(np.uint32))
                n += len(held[-1])
                if n >= CHUNK:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        values = np.sort(np.concatenate(held))
        cuts = np.searchsorted(values, np.arange(1, SEGMENTS, dtype=np.uint32) * np.uint32(COUNTERS))
        parts = [(i, x) for i, x in enumerate(np.split(values, cuts)) if len(x)]
        steps = [np.diff(x & np.uint32(COUNTERS - 1), prepend=np.uint32(0)) for _, x in parts]
        return pd.DataFrame({"segment": [i for i, _ in parts], "steps": [x.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes() for x in steps]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, counts = None, np.zeros(COUNTERS, np.uint32)
        for pdf in batches:
            for i, steps in zip(pdf["segment"].tolist(), pdf["steps"]):
                if i != segment:
                    if segment is not None:
                        yield folded(segment, counts)
                    segment = i
                    counts[:] = 0
                planes = np.frombuffer(steps, np.uint8).reshape(3, -1).astype(np.uint32)
                values = np.cumsum(planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16), dtype=np.uint32)
                where, n = np.unique(values, return_counts=True)
                counts[where] += n.astype(np.uint32)
        if segment is not None:
            yield folded(segment, counts)

    def folded(segment: int, counts: np.ndarray) -> pd.DataFrame:
        most = counts.reshape(-1, FOLD).max(axis=1)
        return pd.DataFrame({"segment": [segment], "levels": [np.frexp(most.astype(float))[1].clip(1).astype(np.uint8).tobytes()]})

    given = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(pack, "segment int, steps binary")
    out = np.ones((SEGMENTS, COUNTERS // FOLD), np.uint8)
    for r in given.repartition(COUNTING, "segment").sortWithinPartitions("segment").mapInPandas(count, "segment int, levels binary").collect():
        out[r["segment"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def describe(
    docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text", more: dict[str, str] | None = None, of: Callable[[np.ndarray], tuple] = lambda hashes: ()
) -> DataFrame:
    """`id`, `mark` (64 bits of the text), `n` (distinct shingles), `whole` (128 bits
    of the set), `key` (128 bits of `n` and `prefix`), `prefix` (the first shingles in the common order: by frequency,
    then hash), `parts` (in how many parts a shingle's list is cut), and columns
    `more` (name -> type), which `of` makes from a text's shingles."""
    from xxhash import xxh3_128_digest

    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, levels = _Words(), sent.value
        shift = np.uint64(64 - (len(levels) - 1).bit_length())
        for pdf in batches:
            wholes, ns, keys, prefixes, parts, others = [], [], [], [], [], []
            for text in pdf["text"]:
                found = shingles(text, size, known)
                n = len(found)
                level = levels[(found >> shift).astype(np.int64)]
                first = np.argsort(level, kind="stable")[: n - -(-percent * n // 100) + 1]
                wholes.append(xxh3_128_digest(found.tobytes()))
                ns.append(n)
                keys.append(xxh3_128_digest(n.to_bytes(8) + found[first].tobytes()))
                prefixes.append(found[first].view(np.int64))
                parts.append(np.maximum(1 << level[first].astype(np.int64), LIST) // LIST)
                others.append(of(found))
            made = {"id": pdf["id"].astype("Int64"), "mark": pdf["mark"], "n": np.array(ns, np.int64), "whole": wholes, "key": keys, "prefix": prefixes, "parts": [p.astype(np.int32) for p in parts]}
            yield pd.DataFrame(made | {c: [x[i] for x in others] for i, c in enumerate(more or {})})

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return given.mapInPandas(run, ", ".join(["id long, mark long, n long, whole binary, key binary, prefix array<long>, parts array<int>", *[f"{c} {t}" for c, t in (more or {}).items()]]))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets with a shingle in common can be alike; `x` and `y` are structs
    with `n` and `pos` (the shingle's place), x the one that is not larger. At the
    first shingle that two alike sets share this is true."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    rest = F.least(nx - px, ny - py)  # this shingle and those after it
    return (nx * 100 >= ny * percent) & (rest * (100 + percent) >= (nx + ny) * percent) & ((nx - px) * (100 + percent) >= nx * (2 * percent))


def _postings(groups: DataFrame) -> DataFrame:
    """One row for each shingle of a group's prefix: `token`, `parts`, `n`, `pos`, `no`
    (numbers take far less than `gid`, as most of these rows are shuffled and left out)."""
    each = groups.select("no", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x"))
    return each.select(F.col("x.prefix").alias("token"), F.col("x.parts").alias("parts"), "n", "pos", "no")


def _likely(lists: DataFrame, roots: DataFrame | None, percent: int, most: int) -> DataFrame:
    """Pairs `a`, `b` of groups to try: in each part of a list the first group (the
    one that shares shingles with the most others, as an original does with its
    copies) or, for those that are joined with that, the first that they aren't
    joined with; for each group the `most` that it shares the most with."""
    rooted = lists.withColumn("root", F.col("e.gid"))
    if roots is not None:
        found = small(roots.withColumnRenamed("root", "_root"))
        rooted = lists.join(found, F.col("e.gid") == F.col("whole"), "left").withColumn("root", F.coalesce("_root", "e.gid"))
    side = Window.partitionBy("token", "part")
    order = side.orderBy(F.desc("degree"), "e").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = rooted.withColumn("top", F.first(F.struct("e", "root")).over(order))
    each = each.withColumn("other", F.first(F.when(F.col("root") != F.col("top.root"), F.col("e")), ignorenulls=True).over(order))
    each = each.select("e", F.when(F.col("root") != F.col("top.root"), F.col("top.e")).otherwise(F.col("other")).alias("o")).where("o IS NOT NULL")
    fits = F.when(F.col("e") <= F.col("o"), _may_link("e", "o", percent)).otherwise(_may_link("o", "e", percent))
    n = each.where(fits).groupBy(F.col("e.gid").alias("b"), F.col("o.gid").alias("a")).agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    return n.withColumn("at", at).where(F.col("at") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _could_link(pairs: DataFrame, groups: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """Those pairs of groups whose prefixes share enough: what both have behind
    their prefixes is no more than the longer rest."""
    # written, so that Spark knows where they are few, and doesn't shuffle all prefixes
    pairs = materialize(pairs, "jaccard-pairs")
    few = materialize(sift(groups.select("gid", "n", "prefix"), "gid", _sets(pairs, a, b).withColumnRenamed(a, "gid")), "jaccard-pairs")
    of = lambda g: few.select(F.col("gid").alias(g), F.struct("n", "prefix").alias(f"_{g}"))
    there = pairs.join(of(a), a).join(of(b), b)
    x, y = f"_{a}", f"_{b}"
    rest = F.greatest(*[F.col(f"{z}.n") - F.size(f"{z}.prefix") for z in (x, y)])
    enough = (F.size(F.array_intersect(f"{x}.prefix", f"{y}.prefix")) + rest) * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent
    return there.where(enough).select(*pairs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs `a`, `b` whose whole sets are alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, mine = _Words(), None, None
        for pdf in batches:
            good = []
            for b, tb, ta in zip(pdf["b"], pdf["tb"], pdf["ta"]):
                if b != last:
                    last, mine = b, shingles(tb, size, known)
                other = shingles(ta, size, known)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                good.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    both = pairs.join(texts.select(F.col("whole").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("whole").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary")


class _Texts:
    """The texts of sets that are compared, fetched when they are needed first."""

    def __init__(self, docs: DataFrame, described: DataFrame, id_col: str, text_col: str) -> None:
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.described, self.there = described, None

    def of(self, pairs: DataFrame) -> DataFrame:
        """`whole`, `text` (of the row with the smallest id) of the sets in `pairs`, and maybe of others."""
        used = materialize(_sets(pairs).withColumnRenamed("a", "whole"), "jaccard-used")
        new = used if self.there is None else materialize(used.join(self.there.select("whole"), "whole", "left_anti"), "jaccard-used")
        first = sift(self.described, "whole", new).groupBy("whole").agg(F.min(F.struct("id", "mark")).alias("x")).join(new, "whole").select("whole", F.col("x.id").alias("id"), F.col("x.mark").alias("_mark"))
        first = materialize(first, "jaccard-used")
        rows = sift(self.rows, "id", first).withColumn("mark", F.xxhash64("text")).withColumnRenamed("id", "_id")  # not all texts are shuffled
        same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("_mark"))
        more = materialize(rows.join(small(first), same).select("whole", "text").dropDuplicates(["whole"]), "jaccard-texts")
        if self.there is None:
            self.there = more
            return more
        self.there = self.there.union(more)
        return sift(self.there, "whole", used)


def _roots(links: DataFrame) -> DataFrame:
    return materialize(components(links, "a", "b").select(F.col("node").alias("whole"), "root"), "jaccard-roots")


def _apart(lists: DataFrame, groups: DataFrame, members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs `a`, `b` of sets that the filters leave and `roots` has not joined.

    Members of a group with the same root stay together: (group, root) is what is
    paired. In each shingle's list those with its most frequent root are paired
    only with the others, never with each other. Members of one group that are
    apart are paired whether or not another group shares a shingle with them."""
    entries = members.join(roots, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    alone = lists.select(F.col("e.gid").alias("gid")).distinct().join(members.select("gid").distinct(), "gid", "left_anti")
    alone = alone.join(roots, F.col("gid") == F.col("whole"), "left").select("gid", F.coalesce("root", "gid").alias("root"), F.col("gid").alias("whole"))
    entries = materialize(entries.select("gid", "root", "whole").unionByName(alone), "jaccard-entries")
    rooted = lists.select("token", "e", F.col("e.gid").alias("gid")).join(small(materialize(entries.select("gid", "root").distinct(), "jaccard-of")), "gid").select("token", "e", "root")
    rooted = materialize(rooted, "jaccard-rooted")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    rooted = sift(rooted, "token", materialize(mixed, "jaccard-mixed"))  # few rows have such a token
    n = rooted.groupBy("token", "root").agg(F.count("*").alias("n"))
    main = n.groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("token", F.col("m.root").alias("main"))
    main = materialize(main, "jaccard-main")  # few tokens
    there = materialize(rooted.join(main, "token").select("token", "e", "root", (F.col("root") == F.col("main")).alias("is_main")), "jaccard-apart")
    x = there.where(~F.col("is_main")).select("token", F.col("e").alias("ex"), F.col("root").alias("rx"))
    y = there.select("token", F.col("e").alias("ey"), F.col("root").alias("ry"), "is_main")
    once = F.col("is_main") | (F.struct("ex", "rx") < F.struct("ey", "ry"))
    smaller = F.col("ex") <= F.col("ey")
    fits = F.when(smaller, _may_link("ex", "ey", percent)).otherwise(_may_link("ey", "ex", percent))
    found = x.join(y, "token").where((F.col("rx") != F.col("ry")) & (F.col("ex.gid") != F.col("ey.gid")) & once & fits).select(F.col("ex.gid").alias("gx"), "rx", F.col("ey.gid").alias("gy"), "ry").distinct()
    of = lambda g, r, w: entries.select(F.col("gid").alias(g), F.col("root").alias(r), F.col("whole").alias(w))
    found = _could_link(found, groups, "gx", "gy", percent).unionByName(_within(members, entries))
    expanded = found.join(of("gx", "rx", "wx"), ["gx", "rx"]).join(of("gy", "ry", "wy"), ["gy", "ry"])
    return expanded.select(F.least("wx", "wy").alias("a"), F.greatest("wx", "wy").alias("b")).distinct()


def _within(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs `gx`, `rx`, `gy`, `ry` of parts with different roots of the same group."""
    inner = sift(entries.select("gid", "root"), "gid", members).distinct()
    apart = inner.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gid")
    inner = inner.join(apart, "gid")
    x, y = (inner.select("gid", F.col("root").alias(r)) for r in ("rx", "ry"))
    return x.join(y, "gid").where("rx < ry").select(F.col("gid").alias("gx"), "rx", F.col("gid").alias("gy"), "ry")


def _sets(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.select(a).distinct().union(pairs.select(b).distinct()).distinct()


def _few(pairs: DataFrame) -> DataFrame:
    """For each set that is first or second in `pairs` a FEW of them, by a hash."""
    at = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.xxhash64("a", "b"), "a", "b"))
    return pairs.withColumn("_a", at("a")).withColumn("_b", at("b")).where((F.col("_a") <= FEW) | (F.col("_b") <= FEW)).select("a", "b")


def _still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs that `roots` has not joined."""
    of = lambda c: roots.select(F.col("whole").alias(c), F.col("root").alias(f"_{c}"))
    there = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return there.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def jaccard_links(docs: DataFrame, described: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text", proposed: DataFrame | None = None) -> DataFrame:
    """Links `a`, `b` between sets (`whole`) of `described` that are alike: a path of
    links joins any two sets that are, though not every link is returned.
    `proposed` (`a`, `b`, the smaller first) are pairs to compare before all others."""
    groups = described.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts"), F.min("whole").alias("gid"), (F.min("whole") != F.max("whole")).alias("many"))
    groups = materialize(groups.withColumn("no", F.monotonically_increasing_id()), "jaccard-groups")
    many = groups.where("many").select("key", "gid")
    members = many.join(sift(described.where("n > 0").select("key", "whole"), "key", many).distinct(), "key").select("gid", "whole")
    members = materialize(members, "jaccard-members")
    part = F.pmod(F.xxhash64("no"), F.col("parts"))
    lists = _postings(groups).withColumn("part", part).withColumn("_n", F.count("*").over(Window.partitionBy("token", "part")))
    lists = materialize(lists.where("_n > 1 OR parts > 1").select("token", "part", "n", "pos", "no", "_n"), "jaccard-shared")
    degree = materialize(lists.groupBy("no").agg(F.sum("_n").alias("degree")), "jaccard-degree")
    # few groups have a shingle in common with others; from here on only they are read
    groups = materialize(groups.join(degree, "no").select("no", "gid", "n", "prefix", "degree"), "jaccard-sharing")
    e = F.struct("n", F.col("pos").cast("long").alias("pos"), "gid").alias("e")
    lists = materialize(lists.join(groups.select("no", "gid", "degree"), "no").select("token", "part", e, "degree"), "jaccard-lists")
    texts, links, roots, tried = _Texts(docs, described, id_col, text_col), None, None, None
    for most in (*([0] if proposed is not None else []), *LIKELY):
        pairs = _could_link(_likely(lists, roots, percent, most), groups, "a", "b", percent) if most else proposed
        if tried is None:  # members of a group are tried with its first
            pairs = pairs.union(members.where("gid != whole").select("gid", "whole")).distinct()
        else:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jaccard-tried")
        found = materialize(_verified(pairs, texts.of(pairs), size, percent), "jaccard-links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        roots = _roots(links)
        if most and found.isEmpty():
            break
    rest = materialize(_apart(lists, groups, members, roots, percent).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    while (n := rest.count()) > MANY * _sets(rest).count():
        few = materialize(_few(rest), "jaccard-tried")
        found = materialize(_verified(few, texts.of(few), size, percent), "jaccard-links")
        links = links.union(found)
        roots = _roots(links)
        rest = materialize(_still_apart(rest.join(few, ["a", "b"], "left_anti"), roots), "jaccard-rest")
        if found.isEmpty():
            break
    if n:
        links = links.union(materialize(_verified(rest, texts.of(rest), size, percent), "jaccard-links"))
    return links


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs`: `doc_id`, `n_shingles`, `component_id`. Two rows link
    when 100 * intersection >= `percent` * union of their sets of shingles of `size`
    lower-cased (A-Z) words; `component_id` is the smallest id that links lead to,
    its own included.

    Texts of fewer words are one shingle as a whole; null, empty and blank texts
    have no shingle, link with nothing, and are components of their own. Rows with
    equal sets are linked and compared once, so a group of copies is one set.
    Repeated rows and ids stay; a null id has a component like any other and is
    never the smallest unless all are null. Other columns of `docs` take no part,
    whatever their names; an empty table gives none. Whole texts count, in
    memory a text's shingles at a time."""
    described = materialize(describe(docs, size, percent, id_col, text_col), "jaccard-described")
    roots = _roots(jaccard_links(docs, described, size, percent, id_col, text_col))
    sets = described.where("n > 0").groupBy("whole").agg(F.min("id").alias("least")).join(roots, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    smallest = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(sets.select("whole", "root").join(smallest, "root").select("whole", "component_id"), "jaccard-ids")
    out = described.select("id", "n", "whole").join(ids, "whole", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
