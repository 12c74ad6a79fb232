"""The grouped prefix join against all pairs."""

import random

import pytest

from starmodel.llm import common, jaccard_join
from starmodel.llm.common import words
from starmodel.llm.jaccard_join import jaccard_groups

from .helpers import rows, table


def sets(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(given, size=5, percent=80):
    """[(id, text)] -> [(id, n, component)]"""
    of = [sets(t, size) for _, t in given]
    root = list(range(len(given)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            if of[i] and of[j] and 100 * len(of[i] & of[j]) >= percent * len(of[i] | of[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(given):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(of[i]), d if not of[i] else least.get(top(i))) for i, (d, _) in enumerate(given)), key=repr)


def corpus(seed, n):
    """Groups of near copies that differ by so much that some link and some don't, templates, and copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    shared = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.choice([2, 4, 5, 6, 20, 60, 120]))]
        if r.random() < 0.3:
            base += shared
        for _ in range(r.choice([1, 1, 2, 8, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w) + 1)
                w[at : at + 1] = r.choice([[], [word()], [*w[at : at + 1], word()]])
            out.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
    return [(i, t) for i, t in enumerate(out)]


def run(spark, given, **more):
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in jaccard_groups(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("tries,size,percent", [((2, 1), 5, 80), ((1,), 3, 60), ((1,), 5, 95)])
def test_join_brute_force(spark, monkeypatch, tries, size, percent):
    """With lists cut into parts, and with few tries, so that much is left to the rest."""
    monkeypatch.setattr(jaccard_join, "LIKELY", tries)
    monkeypatch.setattr(jaccard_join, "LIST", 8 if percent == 80 else 512)
    given = corpus(size, 400)
    assert run(spark, given, size=size, percent=percent) == brute(given, size, percent)


def test_exact_threshold(spark):
    """Sets of 9 and 9 with 8 in common: 8 of 10."""
    a, b = [f"a{i}" for i in range(13)], [f"a{i}" for i in range(12)] + ["other"]
    assert [r[2] for r in run(spark, [(5, " ".join(a)), (7, " ".join(b))])] == [5, 5]
    assert [r[2] for r in run(spark, [(5, " ".join(a)), (7, " ".join(b))], percent=81)] == [5, 7]


def test_odd_rows(spark):
    given = [(r[0], r[1]) for r in rows()]
    got = sorted((tuple(r) for r in jaccard_groups(table(spark)).collect()), key=repr)
    assert got == brute(given)
    assert jaccard_groups(table(spark, [])).count() == 0


def test_templates_are_no_candidates(spark):
    """Pages that share 160 of 194 words are at 0.67: no two of them are compared."""
    r = random.Random(3)
    template = [f"t{i}" for i in range(160)]
    given = [(i, " ".join(template + [f"x{r.randrange(10**9)}" for _ in range(34)])) for i in range(600)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    tried = []
    plain = jaccard_join._verified
    try:
        jaccard_join._verified = lambda pairs, *a: (tried.append(pairs.count()), plain(pairs, *a))[1]
        assert len({r.component_id for r in jaccard_groups(docs).collect()}) == 600
    finally:
        jaccard_join._verified = plain
    assert sum(tried) == 0


def test_members_of_a_group_without_its_first(spark):
    """Three texts with the same prefix, which no other text shares; two are alike,
    and the third may be the first of the group."""
    given = []
    for k in range(8):
        own, at = [f"p{k}x{i}" for i in range(80)], [f"s{k}w{i}" for i in range(4)]
        tails = [at + [f"q{k}b{b}w{i}" for i in range(20)] for b in range(2)]
        tails.append(tails[1][:-4] + [f"q{k}b2w{i}" for i in range(4)])
        given += [" ".join(own + tail) for tail in tails]
        # more frequent than the rest, so that no tail is in a prefix
        given += [" ".join([f"o{k}c{c}t{t}y{i}" for i in range(60)] + tail) for t, tail in enumerate(tails) for c in range(8)]
    given = list(enumerate(given))
    assert run(spark, given) == brute(given)


@pytest.mark.parametrize("most", [500_000, 0])
def test_few_texts_are_sifted_out(spark, monkeypatch, most):
    """Rows that are used come through, with null keys among them, and hardly any
    others; the rest is exactly what is left. Joins are the same by shuffles."""
    ids = [*range(5000), None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    used = spark.createDataFrame([(i,) for i in (7, 11, 4999, None, 90_000)], "id long")
    got = {r.id for r in common.sift(docs, "id", used).collect()}
    assert got >= {7, 11, 4999, None} and len(got) < 20
    assert {r.id for r in common.sift(docs, "id", used, "left_anti").collect()} == set(ids) - got
    assert common.sift(docs, "id", used).columns == ["id", "text"]
    monkeypatch.setattr(common, "SMALL", most)
    given = corpus(5, 120)
    assert run(spark, given) == brute(given)


def test_few_of_many_pairs(spark):
    """Of all pairs of 60 sets a few for each; pairs that are joined are left out."""
    given = [(bytes([i]), bytes([j])) for i in range(60) for j in range(i + 1, 60)]
    pairs = spark.createDataFrame(given, "a binary, b binary")
    few = [(bytes(r.a), bytes(r.b)) for r in jaccard_join._few(pairs).collect()]
    assert set(few) <= set(given) and len(few) == len(set(few)) <= 2 * jaccard_join.FEW * 60
    assert {x for p in few for x in p} == {bytes([i]) for i in range(60)}
    roots = spark.createDataFrame([(bytes([i]), bytes([0])) for i in range(58)], "whole binary, root binary")
    left = {(bytes(r.a), bytes(r.b)) for r in jaccard_join._still_apart(pairs, roots).collect()}
    assert left == {p for p in given if p[1] >= bytes([58])}


def test_shingles_are_counted_in_small_tables(spark):
    """Counts of all documents, whatever segment a shingle's hash is in."""
    assert jaccard_join.COUNTERS * 4 <= 16 << 20
    texts = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(12)) for i in range(200)]
    levels = jaccard_join.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 5)
    counts = {}
    for t in texts:
        for h in jaccard_join.shingles(t, 5, jaccard_join._Words()).tolist():
            counts[h >> 32] = counts.get(h >> 32, 0) + 1
    most = {}
    for h, n in counts.items():
        most[h // jaccard_join.FOLD] = max(n, most.get(h // jaccard_join.FOLD, 1))
    assert len(levels) == (1 << 32) // jaccard_join.FOLD
    assert all(levels[at] == n.bit_length() for at, n in most.items()) and int((levels != 1).sum()) == sum(n > 1 for n in most.values())
