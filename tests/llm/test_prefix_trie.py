"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from starmodel.llm.prefix_trie import Skeleton, _common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path binary, `a.b` string"


def brute(rows):
    """Rows (conv_id, turn, role, text) -> the contract's rows; turns of a conversation have no ties."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": []})
            node["members"].append(c)
        nodes[tuple(path)]["ends"].append(c)
    for p in sorted(nodes, key=len, reverse=True):
        n = nodes[p]
        below = [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p]
        n["children"] = len(below)
        n["leaves"] = sum(nodes[q]["leaves"] for q in below) or 1
        own = (len(n["members"]) - 1) * len(p[-1][1].encode()) if p else 0
        n["saved"] = own + sum(nodes[q]["saved"] for q in below)
    out = []
    for p, n in nodes.items():
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        out.append((min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), n["children"], n["leaves"], n["saved"], ends))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", b"y", "z") for r in rows], SCHEMA).repartition(3)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = prefix_trie(table, **more)
    assert out.columns == columns
    return sorted((tuple(r) for r in out.collect()), key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    texts = [None, "", "é", "hello", "hi there", "x" * 50]
    rows = []
    for c in r.sample(range(-20, 3 * n), n):
        length = r.choice([0, 1, 2, 3, 5, 12])
        order = r.sample(range(100), length)
        same = r.random() < 0.4  # a third and more have the same turns
        for k, t in enumerate(sorted(order)):
            rows.append((c, t, "user" if k % 2 else None, texts[k % 6] if same else r.choice(texts)))
    return rows


@pytest.mark.parametrize("shard", [1, 7, 100_000])
def test_trie_brute_force(spark, shard):
    """Many shards and few, with a large group of equal conversations."""
    rows = conversations(shard, 150) + [(1000 + i, t, "user", f"same {t}") for i in range(60) for t in range(9)]
    rows += [(5, None, "system", "before all"), (None, 1, "user", "no conversation"), (999, 2_000, "user", "y" * 20_000)]
    rows += [(7000, t, "user", "long") for t in range(400)]
    assert run(spark, rows, shard=shard) == brute(rows)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    one = [(3, 0, None, None)]  # its first turns come from conversation 0, which is absent
    assert run(spark, one) == brute(one)
    repeated = [(0, 1, "user", "a")] * 3
    assert [r[1] for r in run(spark, repeated)] == [0, 1, 2, 3]
    tied = [(0, 1, "user", "a"), (0, 1, "user", "b")]
    assert run(spark, tied) == run(spark, tied[::-1])


def test_splitters():
    a, b = bytes(range(32)), bytes(range(16)) + b"z" * 16
    assert _common(a, b) == 1 and _common(a, a) == 2 and _common(a, b"") == 0 and _common(a, a + b) == 2
    skeleton = Skeleton([(a, -(1 << 63)), (b, 7)])
    assert len(skeleton.parent) == 4 and [skeleton.shard(x, c) for x, c in ((b"", 9), (a[:16], 0), (a, 0), (b, 6), (b, 7))] == [0, 0, 1, 1, 2]
