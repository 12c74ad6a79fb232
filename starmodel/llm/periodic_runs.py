"""Periodic runs of words: suffix trees answer how far two places read alike.

The suffix tree of a stretch of words and that of its reversal are built online
(Ukkonen). In an Euler tour of a tree the lowest common ancestor of two leaves is
a range minimum, so how far two suffixes, or two prefixes, agree takes constant
time. Every run has a Lyndon root in one of two opposite orders of the words; the
longest Lyndon word from each place on is extended in both directions, and what
reaches far enough is a run.

Before that, words that can't be in any run are left out: in a run of at least
four periods every word is there four times, so trees are built only for the
stretches in which each word is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmodel.llm.common import unpacked, whole_row

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _ukkonen(s: list[int], size: int) -> tuple[list[int], list[int], list[int], dict[int, int]]:
    """The suffix tree of `s`, whose last symbol is there once; symbols are below
    `size`. Start and end of each node's edge, the leaves in the order of their
    suffixes, and the children: node * size + first symbol -> child; 0 is the root."""
    far = len(s)
    start, end, link, leaves = [0], [0], [0], []
    step: dict[int, int] = {}
    node, edge, length, left = 0, 0, 0, 0
    for i, c in enumerate(s):
        before = 0
        left += 1
        while left:
            if not length:
                edge = i
            key = node * size + s[edge]
            child = step.get(key)
            if child is None:
                step[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                end.append(far)
                link.append(0)
                if before:
                    link[before] = node
                before = node
            else:
                a, b = start[child], end[child]
                span = (b if b < far else i + 1) - a
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[a + length] == c:
                    length += 1
                    if before:
                        link[before] = node
                    break
                middle = len(start)
                step[key] = middle
                start += (a, i)
                end += (a + length, far)
                link += (0, 0)
                leaves.append(middle + 1)
                step[middle * size + c] = middle + 1
                start[child] = a + length
                step[middle * size + s[a + length]] = child
                if before:
                    link[before] = middle
                before = middle
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, end, leaves, step


class SuffixTree:
    """The suffixes of a sequence of words (numbers from 1 on): their sorted order
    and how far any two of them agree."""

    def __init__(self, words: np.ndarray) -> None:
        s = [*words.tolist(), 0]  # the end comes before all words
        self.size = size = int(words.max()) + 1
        start, end, leaves, step = _ukkonen(s, size)
        keys = np.fromiter(step.keys(), np.int64, len(step))
        self.child = np.fromiter(step.values(), np.int64, len(step))
        self.up, self.first = keys // size, keys % size
        self.nodes, self.leaves = len(start), np.array(leaves)
        parent = np.zeros(self.nodes, np.int64)
        parent[self.child] = self.up
        tour = self._preorder(self.first)
        depth, above, span = [0] * self.nodes, parent.tolist(), (np.array(end) - np.array(start)).tolist()
        for v in tour[1:]:
            depth[v] = depth[above[v]] + span[v]
        order = np.array(tour)
        at = np.empty(self.nodes, np.int64)
        at[order] = np.arange(self.nodes)
        self.at = at[self.leaves]
        #: The Euler tour: before each node it passes through that node's parent.
        self.passed = np.array(depth)[parent[order]]

    def _preorder(self, key: np.ndarray) -> list[int]:
        """All nodes, each before its children, which come by their first word's `key`."""
        order = np.lexsort((-key, self.up))
        kids = self.child[order].tolist()
        offsets = np.concatenate(([0], np.cumsum(np.bincount(self.up, minlength=self.nodes)))).tolist()
        stack, out = [0], []
        while stack:
            v = stack.pop()
            out.append(v)
            a, b = offsets[v], offsets[v + 1]
            if a != b:
                stack += kids[a:b]
        return out

    def rank(self, down: bool = False) -> np.ndarray:
        """The place of each suffix in sorted order; with `down` larger words come
        first. The end comes first in both."""
        key = np.where(self.first == 0, 0, self.size - self.first) if down else self.first
        at = np.empty(self.nodes, np.int64)
        at[self._preorder(key)] = np.arange(self.nodes)
        return at[self.leaves]

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words suffixes `i` and `j` (different) begin with alike: the
        depth of the leaves' lowest common ancestor, which is the least that the
        tour passes between them. Minima over powers of two answer each with two
        look-ups; one power is held at a time."""
        a, b = self.at[i], self.at[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        power = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out, least = np.empty(len(lo), np.int64), self.passed
        for k in range(int(power.max(initial=0)) + 1):
            if k:
                least = np.minimum(least[: -(1 << (k - 1))], least[1 << (k - 1) :])
            of = power == k
            out[of] = np.minimum(least[lo[of]], least[hi[of] - (1 << k) + 1])
        return out


def _lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place on ends: at the next smaller suffix."""
    rank = rank.tolist()
    n = len(rank) - 1
    out, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def _runs(words: np.ndarray, least: int, power: int) -> np.ndarray:
    """Rows `start`, `length`, `period` of the runs of one stretch."""
    n = len(words)
    forth, back = SuffixTree(words), SuffixTree(words[::-1])
    ends = np.concatenate([_lyndon_ends(forth.rank()), _lyndon_ends(forth.rank(down=True))])
    at = np.tile(np.arange(n), 2)
    period = ends - at
    some = period * power <= n
    at, period = at[some], period[some]
    right = forth.agree(at, at + period)
    left = back.agree(n - at, n - at - period)
    length = left + period + right
    found = np.stack([at - left, length, period], axis=1)[length >= np.maximum(least, power * period)]
    return np.unique(found, axis=0)


def _stretches(codes: np.ndarray, power: int, least: int) -> Iterator[tuple[int, int]]:
    """[from, to) of what is left when words that are in their stretch less than
    `power` times are taken out, again and again, and stretches shorter than `least`."""
    n, different = len(codes), int(codes.max()) + 1
    stretch, there = np.zeros(n, np.int64), np.arange(n)
    while len(there):
        if len(there) == n:
            stay = np.bincount(codes)[codes] >= power
        else:
            _, inverse, counts = np.unique(stretch * different + codes[there], return_inverse=True, return_counts=True)
            stay = counts[inverse] >= power
        if stay.all():
            break
        stretch, there = stretch[stay], there[stay]
        if not len(there):
            return
        # a new stretch begins where places no longer follow each other
        stretch = np.cumsum(np.concatenate(([0], (np.diff(there) > 1) | (np.diff(stretch) > 0))))
        long = np.bincount(stretch)[stretch] >= least
        there, stretch = there[long], stretch[long]
    if len(there):
        cuts = np.flatnonzero(np.diff(stretch) > 0) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(there)]):
            yield int(there[a]), int(there[b - 1]) + 1


def find_runs(words: list[bytes], least: int = 6, power: int = 4) -> np.ndarray:
    """Rows `start`, `length`, `period` of all runs, by start, then period: longest
    stretches with that smallest period, of at least `least` words and `power`
    (two or more) periods."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    found = [np.empty((0, 3), np.int64)]
    for a, b in _stretches(codes, power, least) if len(codes) >= least else ():
        own = _runs(np.unique(codes[a:b], return_inverse=True)[1] + 1, least, power)
        own[:, 0] += a
        found.append(own)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse_runs(docs: DataFrame, least: int = 6, power: int = 4, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with `_runs` (array of start, length and period, in
    words, by start, then period) and `_collapsed`: the words, joined by one space,
    without those that a run has after its first period. Columns of the same
    names give way; all others stay.

    Words are what stands between white space, compared byte by byte. Null, empty
    and blank texts have no runs and collapse to the empty text; ties are all runs
    of their own; repeated rows stay; a text is one row, whatever its length,
    and takes memory in proportion to its longest stretch of repeated words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs, collapsed = [], []
            for text in pdf["_text"]:
                words = text.encode("utf-8", "surrogatepass").split()
                found = find_runs(words, least, power)
                if len(found):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, found[:, 0] + found[:, 2], 1)
                    np.add.at(gone, found[:, 0] + found[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"_doc": pdf["_doc"], "_runs": runs, "_collapsed": collapsed})

    given = docs.select(whole_row(docs.drop(text_col)).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    made = T.StructType([given.schema["_doc"], *T.StructType.fromDDL(f"_runs array<{RUN}>, _collapsed string")])
    out = given.mapInPandas(run, made)
    return out.select(*unpacked(docs.drop(text_col), but=("_runs", "_collapsed")), "_runs", "_collapsed")


def with_periods(doc_id: Column, text: Column) -> Column:
    """Texts of which some are made periodic: with h the crc32 of the id's digits
    and g = h // 10, where h % 10 = 0 each word from a = g % n on is one of the p =
    1 + (n - a) // (3 + g % 8) words from a on, over and over. Texts without words
    or without an id stay as they are; null is empty."""
    text = F.coalesce(text, F.lit(""))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), tail)

    rebuilt = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, rebuilt).otherwise(text)


def digests(out: DataFrame) -> DataFrame:
    """`doc_id`, `n_runs`, the longest run (ties: first start, then period), and
    digests of all runs and of what is left of the text."""
    lines = F.concat_ws("", F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    longest = F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    length, start, period = (longest.getField(c) for c in ("length", "start", "period"))
    return out.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), (-start).alias("start"), length.alias("length"), (-period).alias("period"), F.floor(length * 1000 / -period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )
