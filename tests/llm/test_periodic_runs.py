"""Runs against a search over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starmodel.llm.periodic_runs import SuffixTree, collapse_runs, digests, find_runs, with_periods

from .helpers import rows, table


def brute(w, least=6, power=4):
    n, out = len(w), []
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            run = w[i : i + length]
            if j > i and length >= max(least, power * p) and not any(run[q:] == run[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.sampled_from([2, 3, 4]))
def test_runs_brute_force(words, power):
    assert [tuple(r) for r in find_runs(words, 6, power).tolist()] == brute(words, 6, power)


def test_planted_runs():
    r = random.Random(4)
    for _ in range(60):
        words = []
        while len(words) < 300:
            period = [b"%d" % r.randrange(9) for _ in range(r.randint(1, 9))]
            words += [b"u%d" % r.randrange(10**6) for _ in range(r.randint(0, 20))] + (period * 9)[: r.randint(1, 9 * len(period))]
        assert [tuple(x) for x in find_runs(words).tolist()] == brute(words)


def test_suffix_tree():
    w = np.random.default_rng(0).integers(1, 4, 200)
    tree = SuffixTree(w)
    suffixes = [w[i:].tolist() for i in range(201)]
    assert np.argsort(tree.rank()).tolist() == sorted(range(201), key=lambda i: suffixes[i])
    assert np.argsort(tree.rank(down=True)).tolist() == sorted(range(201), key=lambda i: [-x for x in suffixes[i]])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(201), np.arange(201)))
    i, j = i[i != j], j[i != j]
    alike = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert tree.agree(i, j).tolist() == [alike(suffixes[a], suffixes[b]) for a, b in zip(i.tolist(), j.tolist())]


def expected(i, text):
    w = (text or "").encode().split()
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(b" ".join(w[k] for k in range(n) if k not in gone)))


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_brute_force(spark, partitions):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.choice([0, 3, 30, 150]))) for _ in range(120)]
    texts += ["a b a b a b a b a b", "x " * 3000, None, "", " \t\n", "é　漢 é　漢 é　漢 é　漢 é　漢 é　漢", ("w v " * 4 + "stop ") * 40]
    given_rows = [(i, t) for i, t in enumerate(texts)] + [(None, "y " * 9), (3, texts[3])]
    docs = spark.createDataFrame(given_rows, "doc_id long, text string").repartition(partitions)
    out = digests(collapse_runs(docs.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text"))))
    assert sorted((tuple(x) for x in out.collect()), key=repr) == sorted((expected(*x) for x in given_rows), key=repr)


def test_columns_and_empty(spark):
    out = collapse_runs(table(spark).withColumn("_runs", F.lit(1)))
    assert out.columns[-2:] == ["_runs", "_collapsed"] and "a.b" in out.columns and out.count() == len(rows())
    assert collapse_runs(table(spark, [])).count() == 0
