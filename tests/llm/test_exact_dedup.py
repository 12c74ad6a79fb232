import hashlib
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starmodel.llm import exact_dedup
from starmodel.llm.exact_dedup import CuckooIndex, exact_groups, live_after

from .helpers import rows, table

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_brute_force(spark):
    got = [tuple(r) for r in exact_groups(table(spark)).collect()]
    groups = {}
    for g in rows():
        t = g[1] or ""
        groups.setdefault(hashlib.sha256(t.translate(WHITE).encode()).hexdigest(), []).append((-len(t), g[0] is None, g[0] or 0, g[0]))
    assert len(got) == len(rows())
    for digest, members in groups.items():
        best = min(members)
        mine = [r for r in got if r[4] == digest]
        assert len(mine) == len(members) and all(r[1] == best[3] and r[2] == len(members) for r in mine)
        kept = [r for r in mine if r[3]]
        assert len(kept) == 1 and kept[0][0] == best[3]


def test_empty_table(spark):
    assert exact_groups(table(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=400))
def test_index_is_a_dictionary(changes):
    index, live = CuckooIndex(buckets=1), {}
    for delete, k in changes:
        digest = hashlib.sha256(str(k).encode()).digest()
        if delete:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
        elif index.find(digest) is None:
            assert digest not in live
            index.insert(digest, k)
            live[digest] = k
        assert (index.find(digest) is not None) == (digest in live)
    assert dict(index) == live


def test_index_grows_from_its_keys():
    index = CuckooIndex(buckets=2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        index.insert(d, i)
    assert index.resizes > 5 and all(index.find(d)[1] == i for i, d in enumerate(digests))
    random.Random(1).shuffle(digests)
    for d in digests[:1500]:
        assert index.delete(d)
    assert all(index.find(d) is None for d in digests[:1500]) and all(index.find(d) for d in digests[1500:])


def test_live_after_changes(spark):
    changes = [(1, False, 1, "a b"), (2, False, 2, "ab"), (3, True, 9, " a b "), (4, False, 3, "ab"), (5, False, 4, None), (6, True, 4, "")]
    df = spark.createDataFrame(changes, "seq long, is_delete boolean, doc_id long, text string")
    assert [r.doc_id for r in live_after(df).collect()] == [3]


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    texts = [f"text {i % 97} " + " " * (i % 3) for i in range(400)] + ["copy"] * 300
    whole = sorted(map(tuple, exact_groups(table(spark, texts)).collect()))
    monkeypatch.setattr(exact_dedup, "HELD", 7)
    monkeypatch.setattr(exact_dedup, "BUCKET", 20)
    got = sorted(map(tuple, exact_groups(table(spark, texts)).collect()))
    assert got == whole and len(got) == 700 and sum(r[3] for r in got) == 98


def test_a_full_index_is_passed_on():
    n = 1000
    digests = [hashlib.sha256(str(i % 250).encode()).digest() for i in range(n)]
    given = pd.DataFrame({"_digest": digests, "_chars": 1, "_best": pd.array(range(n), dtype="Int64"), "_best_row": range(n), "_n": 1})
    parts = list(exact_dedup._merge(iter([given]), 60))
    assert max(map(len, parts)) <= 60 and sum(p["_n"].sum() for p in parts) == n
    (merged,) = exact_dedup._merge(iter(parts))
    assert sorted(merged["_best"]) == list(range(250)) and set(merged["_n"]) == {4}


def test_live_after_nulls_repeats_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 3)
    changes = [(None, None, 1, None), (2, False, 2, " "), (3, None, None, "x"), (3, None, None, "x"), (4, True, 5, "never there")]
    changes += [(10 + i, False, 100 + i, f"t{i}") for i in range(40)] + [(100 + i, True, 0, f"t {i}") for i in range(0, 40, 2)]
    df = spark.createDataFrame(changes, "seq long, is_delete boolean, doc_id long, text string").withColumn("d", F.lit("clash"))
    got = {r.doc_id for r in live_after(df).collect()}
    assert got == {1, None} | {100 + i for i in range(1, 40, 2)}
    assert live_after(df.limit(0)).count() == 0
