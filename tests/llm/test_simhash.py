import numpy as np
import xxhash

from starmodel.llm import jaccard_join, near_dedup
from starmodel.llm.near_dedup import first_of_each, near_classes
from starmodel.llm.simhash import BKTree, links, near_groups

from .helpers import BASE, rows, table


def plain_words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


def plain_fingerprint(t, size):
    w = plain_words(t)
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_groups_brute_force(spark):
    given = rows()
    got = near_groups(table(spark)).collect()
    fps = [plain_fingerprint(g[1], 3) for g in given]
    root = roots(len(given), [(i, j) for i in range(len(given)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for g, r in zip(given, root):
        if g[0] is not None:
            least[r] = min(least.get(r, g[0]), g[0])
    want = sorted((g[0] is None, g[0] or 0, f"{f:016x}", least.get(r, -1)) for g, f, r in zip(given, fps, root))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_tree_search():
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    values += [v ^ (1 << int(b)) ^ (1 << int(c)) for v, b, c in zip(values, rng.integers(0, 63, 300), rng.integers(0, 63, 300))]
    tree = BKTree()
    for v in values:
        tree.add(v, v)
    for v in values[:100]:
        for radius in (0, 2, 20):
            assert sorted(x[1] for x in tree.search(v, radius)) == sorted(w for w in values if (v ^ w).bit_count() <= radius)


def test_links_in_blocks(spark):
    """A key that many fingerprints share, cut into small blocks."""
    rng = np.random.default_rng(2)
    fps = {int(b) << 40 | 7 for b in rng.integers(0, 1 << 6, 60)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    at = {x: i for i, x in enumerate(fps)}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = roots(len(fps), [(at[r.a], at[r.b]) for r in links(df, 2, salt=5).collect()])
    assert got == want


def test_empty_table(spark):
    assert near_groups(table(spark, [])).count() == 0
    assert first_of_each(table(spark, [])).count() == 0


def brute_near(given):
    sets = []
    for g in given:
        w = plain_words(g[1])
        sets.append((w, {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    pairs = [(i, j) for i in range(len(given)) for j in range(i) if sets[i][0] == sets[j][0] or (sets[i][1] and len(sets[i][1] & sets[j][1]) >= 0.8 * len(sets[i][1] | sets[j][1]))]
    return roots(len(given), pairs)


def test_first_of_each_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(12):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(30, 200)))]
        for _ in range(int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(copy))
    for given, df in ((rows(texts), table(spark, texts)), (rows(), table(spark))):
        root = brute_near(given)
        groups = {}
        for g, r in zip(given, root):
            groups.setdefault(r, []).append((g[0] is None, g[0] or 0))
        got = first_of_each(df)
        assert got.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(min(v) for v in groups.values())


def test_links_between_classes(spark):
    texts = [BASE, BASE + " end", "  " + BASE, "something else entirely that shares no shingle with it"]
    grouped, found = near_classes(table(spark, texts))
    assert len({r.root for r in grouped.collect()}) == 2 and found.count() == 1


def test_line_repeated_in_one_copy(spark):
    """Repeats inside a text change its fingerprint with repeats, not its set of shingles."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(30):
        base = " ".join(f"w{x}" for x in rng.integers(0, 90_000, 200))
        line = "\n" + " ".join(f"r{x}" for x in rng.integers(0, 90_000, 10))
        texts += [base + line, base + line * 20]
    root = brute_near(rows(texts))
    assert root == [i - i % 2 for i in range(60)]
    assert sorted(r.doc_id for r in first_of_each(table(spark, texts)).collect()) == list(range(0, 60, 2))


def hot_texts(pairs):
    """Texts at about 0.75 to each other, each with one partner at about 0.82."""
    rng = np.random.default_rng(8)
    base, texts = [f"w{x}" for x in rng.integers(0, 90_000, 600)], []

    def edited(words, times):
        words = list(words)
        for at in rng.choice(len(words), times, replace=False).tolist():
            words[at] = f"x{rng.integers(0, 1 << 40)}"
        return words

    for _ in range(pairs):
        both = edited(base, 3)
        texts += [" ".join(edited(both, 6)) for _ in range(2)]
    return [texts[i] for i in rng.permutation(len(texts))]


def check_hot(spark, texts):
    root = brute_near(rows(texts))
    assert len(set(root)) >= len(texts) // 3
    assert sorted(r.doc_id for r in first_of_each(table(spark, texts)).collect()) == sorted(set(root))


def test_partners_in_other_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST", 40)
    monkeypatch.setattr(near_dedup, "PART", 40)
    check_hot(spark, hot_texts(100))


def test_partners_behind_many_nearer(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NEAREST", 1)
    check_hot(spark, hot_texts(100))


def test_large_group_of_near_copies(spark, monkeypatch):
    """One text with many copies of a few edits: one group, found by few pairs a copy."""
    monkeypatch.setattr(jaccard_join, "LIST", 150)
    monkeypatch.setattr(near_dedup, "PART", 150)
    rng = np.random.default_rng(9)
    base, texts = [f"w{x}" for x in rng.integers(0, 90_000, 300)], []
    for i in range(1200):
        copy = list(base)
        for at in rng.choice(300, int(rng.integers(0, 5)), replace=False).tolist():
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    others = [" ".join(f"o{x}" for x in rng.integers(0, 90_000, 100)) for _ in range(50)]
    grouped, found = near_classes(table(spark, texts + others))
    assert sorted(r["count"] for r in grouped.groupBy("root").count().collect()) == [1] * 50 + [1200]
    assert found.count() < 12 * (near_dedup.NEAREST + 1) * 1200


def test_short_texts_with_distant_fingerprints(spark):
    """Of few shingles one more moves many bits; what the trees don't find the join does."""
    rng = np.random.default_rng(10)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 90_000, 9)]
        texts += [" ".join(base), " ".join([*base, f"z{rng.integers(0, 90_000)}"])]
    root = brute_near(rows(texts))
    kept = {r.doc_id for r in first_of_each(table(spark, texts)).collect()}
    assert set(root) == kept
