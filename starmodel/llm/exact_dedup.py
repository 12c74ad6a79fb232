"""Exact dedup over cuckoo-filter indexes of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import WHITE, materialize

SLOTS = 4
KICKS = 500
#: Digests that the first merge of a task holds before it passes them on.
HELD = 200_000
#: Rows whose groups make one bucket of the second merge, in the mean.
BUCKET = 250_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over live digests, in front of a
    store that holds the digests themselves, in the same buckets. A filter hit
    is verified in the store; a full filter is doubled and filled again from the
    stored keys."""

    def __init__(self, buckets: int = 256) -> None:
        self.resizes = -1
        self.stored: dict[int, list[list]] = {}
        self._build(buckets)

    def _build(self, buckets: int) -> None:
        """Fills a filter of `buckets` (a power of two), or a larger one, from the store."""
        entries = [e for bucket in self.stored.values() for e in bucket]
        while True:
            self.mask = buckets - 1
            self.filter: list[list[int]] = [[] for _ in range(buckets)]
            self.resizes += 1
            if all(self._place(e[0]) for e in entries):
                break
            buckets *= 2
        self.stored = {}
        for e in entries:
            self.stored.setdefault(self._home(e[0]), []).append(e)

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:6], "little") & self.mask

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[6:8], "little") or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ ((fingerprint * 0x5BD1E995) & self.mask)

    def _place(self, digest: bytes) -> bool:
        fp, at = self._print(digest), self._home(digest)
        for bucket in (at, self._other(at, fp)):
            if len(self.filter[bucket]) < SLOTS:
                self.filter[bucket].append(fp)
                return True
        for kick in range(KICKS):
            slots = self.filter[at]
            fp, slots[kick % SLOTS] = slots[kick % SLOTS], fp
            at = self._other(at, fp)
            if len(self.filter[at]) < SLOTS:
                self.filter[at].append(fp)
                return True
        return False

    def find(self, digest: bytes) -> list | None:
        """The stored entry [digest, value], or None."""
        fp, at = self._print(digest), self._home(digest)
        if fp not in self.filter[at] and fp not in self.filter[self._other(at, fp)]:
            return None
        return next((e for e in self.stored.get(at, ()) if e[0] == digest), None)

    def insert(self, digest: bytes, value) -> None:
        """Adds a digest that isn't live."""
        self.stored.setdefault(self._home(digest), []).append([digest, value])
        if not self._place(digest):
            self._build(2 * (self.mask + 1))

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out of the filter and the store."""
        entry = self.find(digest)
        if entry is None:
            return False
        fp, at = self._print(digest), self._home(digest)
        bucket = at if fp in self.filter[at] else self._other(at, fp)
        self.filter[bucket].remove(fp)
        self.stored[at].remove(entry)
        return True

    def __iter__(self) -> Iterator[tuple]:
        return ((d, v) for bucket in self.stored.values() for d, v in bucket)


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


_GROUPS = "_digest binary, _chars long, _best long, _best_row long, _n long"


def _merge(batches: Iterator[pd.DataFrame], most: int | None = None) -> Iterator[pd.DataFrame]:
    """One row for each digest of a task: the best row and the number of rows.
    When a better row arrives, the entry of the one that had stayed is deleted
    and the better one becomes live. With `most`, the index is passed on and
    emptied when it holds that many digests."""
    index, size = CuckooIndex(), 0
    for pdf in batches:
        for digest, *row, n in zip(*(pdf[c] for c in ("_digest", "_chars", "_best", "_best_row", "_n"))):
            best = pd.isna(row[1])
            value = ((-row[0], best, 0 if best else row[1], row[2]), n)
            live = index.find(digest)
            if live is None:
                index.insert(digest, value)
                size += 1
                if size == most:
                    yield from _entries(index)
                    index, size = CuckooIndex(), 0
            elif value[0] < live[1][0]:
                total = live[1][1] + n
                index.delete(digest)
                index.insert(digest, (value[0], total))
            else:
                live[1] = (live[1][0], live[1][1] + n)
    yield from _entries(index)


def _entries(index: CuckooIndex) -> Iterator[pd.DataFrame]:
    found = list(index)
    for i in range(0, len(found), 20_000):
        part = found[i : i + 20_000]
        yield pd.DataFrame({
            "_digest": [d for d, _ in part],
            "_chars": [-v[0][0] for _, v in part],
            "_best": pd.array([None if v[0][1] else v[0][2] for _, v in part], dtype="Int64"),
            "_best_row": [v[0][3] for _, v in part],
            "_n": [v[1] for _, v in part],
        })


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs`: `doc_id`, `keep_id`, `group_size`, `kept`,
    `text_sha256`. Texts are equal when they are without their white space (all
    white-space and null texts are equal to the empty one). Of equal texts the
    row with the most code points stays, then the smallest id (null last), then
    the first of repeated rows, so exactly one row of a group is kept.

    Texts are read once, for their digests. Each task merges its own rows in a
    cuckoo index before anything is shuffled (a group of copies becomes a row a
    task), passing on what it holds from time to time; then digests are dealt by
    hash into as many buckets as the number of rows asks for, and merged the same
    way, so that the index of a task does not grow with the input. Digests are
    compared whole (256 bits). The join back is skewed for a large group, which
    adaptive execution splits.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("_best"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_chars"), F.unhex(F.sha2(normalised(text), 256)).alias("_digest"), F.monotonically_increasing_id().alias("_best_row")
        ),
        "digests",
    )
    local = rows.select("_digest", "_chars", "_best", "_best_row", F.lit(1).cast("long").alias("_n")).mapInPandas(lambda batches: _merge(batches, HELD), _GROUPS)
    buckets = max(1, -(-rows.count() // BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = local.repartition(buckets, "_digest").mapInPandas(_merge, _GROUPS)
    groups = groups.select("_digest", F.col("_best").alias("keep_id"), F.col("_best_row").alias("_keep_row"), F.col("_n").alias("group_size"))
    out = rows.join(groups, "_digest")
    return out.select(F.col("_best").alias("doc_id"), "keep_id", "group_size", (F.col("_best_row") == F.col("_keep_row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def live_after(changes: DataFrame, order_col: str = "seq", delete_col: str = "is_delete", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replays insertions and deletions of documents in the order of `order_col`
    (unique): a deletion takes the text's digest out of the index, an insertion
    of a text that isn't live makes its document live. Returns the live
    `doc_id`, `text_sha256`. Changes of one text go to one task in order, and
    digests are dealt by hash into as many buckets as the number of changes asks
    for, so that the index of a task does not grow with the input.

    A null text is the empty one, a null flag an insertion, a null order comes
    first, and a document with a null id is live as such. A repeated change does
    nothing. Other columns take no part, whatever their names; an empty table
    gives none."""
    buckets = max(1, -(-changes.count() // BUCKET), int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given = changes.select(F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("d"), F.col(order_col).alias("s"), F.coalesce(F.col(delete_col), F.lit(False)).alias("x"), F.col(id_col).cast("long").alias("i"))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for pdf in batches:
            for d, x, i in zip(pdf["d"], pdf["x"], pdf["i"]):
                if x:
                    index.delete(d)
                elif index.find(d) is None:
                    index.insert(d, i)
        found = list(index)
        yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(v) else v for _, v in found], dtype="Int64"), "d": [d for d, _ in found]})

    live = given.repartition(buckets, "d").sortWithinPartitions("s").mapInPandas(replay, "doc_id long, d binary")
    return live.select("doc_id", F.lower(F.hex("d")).alias("text_sha256"))
