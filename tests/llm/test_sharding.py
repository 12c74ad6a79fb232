import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from starmodel.llm.sharding import BinTree, best_fit_decreasing, shard_by_bytes

from .helpers import rows, table


def check(got, given_rows, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((g[0] is None, g[0] or 0) for g in given_rows)
    slots, homes, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())
    assert set(slots) <= set(range(shards))
    return sizes


def test_groups_stay_together(spark):
    got = shard_by_bytes(table(spark), 8).collect()
    check(got, rows(), 8)
    texts = {g[0]: (g[1] or "").encode() for g in rows()}
    for r in got:
        if r.doc_id is not None:
            assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])


def test_even_and_hot(spark):
    rng = random.Random(3)
    texts = [rng.choice("abcdef") * rng.randint(0, 3000) for _ in range(600)] + ["hot " * 50] * 300
    given_rows = rows(texts)
    got = shard_by_bytes(table(spark, texts), 8).collect()
    sizes = check(got, given_rows, 8)
    share = sum(sizes.values()) / 8
    assert max(sizes.values()) - min(sizes.values()) < share * 0.05


def test_empty_table(spark):
    assert shard_by_bytes(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_tree_is_best_fit(sizes):
    """The tree gives what a search over all bins gives."""
    sizes = sorted(sizes, reverse=True)
    taken, rooms = best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 100)
    placed = [b for n, b in taken for _ in range(n)]
    assert len(placed) == len(sizes)
    plain = []
    for s, b in zip(sizes, placed):
        fits = [(r, i) for i, r in enumerate(plain) if r >= s]
        if fits:
            assert (plain[b], b) == min(fits)
        else:
            assert b == len(plain)
            plain.append(100)
        plain[b] -= s
    assert plain == rooms


def test_tree_stays_balanced():
    tree = BinTree()
    for i in range(4000):
        tree.add(i, i)

    def depth(t):
        return 0 if t is None else 1 + max(depth(t.left), depth(t.right))

    assert depth(tree.root) <= 26
    for i in range(0, 4000, 2):
        assert tree.take(i) == (i, i)
    assert depth(tree.root) <= 26
    assert tree.take_roomiest() == (3999, 3999)


def test_fixed_capacity(spark):
    texts = [c * n for c in "abcdefgh" for n in (10, 40, 90, 350)] * 2
    got = shard_by_bytes(table(spark, texts), capacity=2000).collect()
    sizes = check(got, rows(texts), 99)
    assert max(sizes.values()) <= 2000 and len(sizes) <= -(-sum(sizes.values()) // 2000) + 1
