import math
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from starmodel.llm import ann, lm, quality
from starmodel.llm.common import words

from .helpers import BASE, rows, table


def test_lm_counts_brute_force(spark):
    for heads, dictionary in ((3840, 200_000), (8, 20)):
        got = lm.score(table(spark), heads=heads, dictionary=dictionary).collect()
        given = rows()
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for g in given if not out(g[0]) for w in [*words(g[1]), b""])
        n, v = sum(c.values()), len(c)
        want = []
        for g in given:
            w = [*words(g[1]), b""]
            want.append((g[0] is None, g[0] or 0, out(g[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_is_normalised():
    model = lm.LogBilinear(np.arange(1, 201)[::-1])
    trainer = lm.Trainer(model, 3)
    rng = np.random.default_rng(0)
    for _ in range(5):
        trainer.step([rng.integers(0, 200, 400)])
    context = rng.integers(0, 200, 6)
    alone = model.log_probabilities([context])[0]
    total = sum(math.exp(model.log_probabilities([np.append(context, i)])[0] - alone) for i in range(200))
    assert abs(total - 1) < 1e-4


def test_lm_learns_contexts():
    """Two languages whose words never mix: the context tells which."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, 200) + 50 * (i % 2) for i in range(600)]
    model = lm.LogBilinear(np.bincount(np.concatenate(texts), minlength=100))
    before = model.log_probabilities(texts[:20]).sum()
    trainer = lm.Trainer(model, 2)
    for _ in range(3):
        for i in range(0, 600, 10):
            trainer.step(texts[i : i + 10])
    assert model.log_probabilities(texts[:20]).sum() > before + 20 * 200 * 0.5


def test_lm_long_text_in_parts():
    model = lm.LogBilinear(np.arange(1, 100))
    ids = np.random.default_rng(2).integers(0, 99, 1000)
    assert abs(sum(lm._parts(model, ids, 77)) - model.log_probabilities([ids])[0]) < 1e-2


def test_lm_tail_groups_are_shared_out(spark):
    """The words of a tail group, each with its count and one, and an unseen one make up its total."""
    counts = lm.count_words(table(spark))
    vocab = lm.vocabulary(counts, heads=8)
    seen = {r.word: (r.tail, r.c) for r in counts.collect() if r.word}
    assert all(tail == lm.tail_group(w) for w, (tail, _) in seen.items())
    want = np.ones(lm.TAILS, int)
    for w, (tail, c) in seen.items():
        want[tail] += (c + 1) * (vocab.known[w] >= 8)
    assert (vocab.tail_total == want).all()
    assert vocab.weights.sum() == vocab.n == sum(c for _, c in seen.values()) + len(rows())


def test_lm_long_text_keeps_its_place(spark):
    """Texts that are scored in parts stay in the order of the rows."""
    given = ["one two", "the quick fox " * 30_000, "one two", "three"]
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm.score(table(spark, given, 1)).collect()}
    assert [got[i][0] for i in range(4)] == [3, 90_001, 3, 2]
    assert abs(got[0][1] - got[2][1]) < 1e-4 and got[1][1] < -90_001 < got[0][1]


def test_lm_beats_counts_on_held_out_texts(spark):
    """The contexts are worth a margin on texts that the model hasn't seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs).where("held_out").agg({"n_tokens": "sum", "base_score": "sum", "score": "sum"}).first()
    assert (r["sum(score)"] - r["sum(base_score)"]) / r["sum(n_tokens)"] > 0.15


def test_lm_empty_table(spark):
    assert lm.score(table(spark, [])).count() == 0


def _labelled(spark, n=400):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(n):
        w = [f"w{rng.integers(0, 900)}" for _ in range(int(rng.integers(5, 60)))]
        texts.append(" ".join(w) + "." if i % 3 else " ".join(x.upper() + "!!" for x in w))
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, quality int")
    return texts, labels


def test_quality_held_out(spark):
    texts, labels = _labelled(spark)
    docs = table(spark, texts)
    model = quality.learn(docs, labels)
    got = quality.scored(docs, model)
    assert [c for c in got.columns if c != "_score"] == [c for c in docs.columns if c != "_score"]
    for r in got.collect():
        assert 0 <= r._score <= 1
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            assert (r._score >= 0.5) == (r.doc_id % 3 > 0)
    kept = quality.good(docs, model, 0.3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if i % 3}


def test_quality_of_held_out_labels(spark):
    """On the given labels that learning doesn't see: bad texts rank below good ones."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    scored = quality.scored(docs, quality.learn(docs, labels)).where(quality.held_out(F.col("doc_id")))
    got = scored.join(labels.select("doc_id", "quality"), "doc_id").select("_score", "quality").toPandas()
    good, bad = (got.loc[got["quality"] == q, "_score"].to_numpy() for q in (1, 0))
    assert len(good) > 20 and len(bad) > 20
    above = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert above > 0.99


def test_quality_compiled_rules_are_the_model(spark):
    texts, labels = _labelled(spark)
    model = quality.learn(table(spark, texts), labels)
    stats = quality.with_statistics(table(spark)).select(*[f"_{s}" for s in quality.STATISTICS], model.column().alias("score")).toPandas()
    assert np.allclose(model.score(stats[[f"_{s}" for s in quality.STATISTICS]].to_numpy(float)), stats["score"])


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.scored(table(spark), quality.learn(table(spark), none)).collect()
    assert len(got) == len(rows()) and {r._score for r in got} == {0.5}
    assert quality.good(table(spark, []), quality.RuleModel()).count() == 0


def _vectors(spark, x, extra=()):
    data = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)


def _brute(x, ids, every, k):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for a, i in zip(u, ids):
        if i % every == 0:
            out[i] = sorted(((-round(float(a @ b), 12), j) for b, j in zip(u, ids) if j != i))[:k]
    return out


def test_ann_small_is_exact(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[40:90] = x[3]  # one vector that many rows have
    extra = [(900, None, 0), (950, [0.0] * 16, 0), (1000, [float("nan")] * 16, 0), (1050, [1.0, None] * 8, 0), (1100, [float("inf")] * 16, 0), (1150, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    got = {}
    for r in ann.nearest(_vectors(spark, x, extra), every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, -round(r.score, 12), r.vec_id))
    want = _brute(x, range(300), 50, 5)
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()} == want


def test_ann_repeated_rows_and_doubles(spark):
    """Rows that are there several times, as queries and as candidates, and vectors
    that differ only beyond a float's precision, or are too large for one."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 8))
    x[50] = x[7] * 1e300
    x[51] = x[8] * (1 + 1e-12)
    again = [(i, x[i].tolist(), 1) for i in [0, 50, 100, 150] * 4 + [7] * 9 + list(range(20, 40)) * 3]
    docs = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + again, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {}
    for r in ann.nearest(docs, every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        want = sorted((-float(u[q] @ u[j]), j) for j in range(200) if j != q)[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and [j for _, j, _ in found] == [j for _, j in want]
        assert np.allclose([s for _, _, s in found], [-s for s, _ in want], rtol=0, atol=1e-14)


def test_ann_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 24)).astype(np.float32)
    got = {}
    for r in ann.nearest(_vectors(spark, x), every=50, k=5, list_size=64, sample=1500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _brute(x, range(4000), 50, 5)
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * 5 * len(want)


def test_ann_sparse_probing_of_clusters_with_outliers(spark):
    """Few of many lists are looked into, and an isolated query still gets its five."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((300, 32))
    x = np.concatenate([(centres[rng.integers(0, 300, 8000)] + 0.3 * rng.standard_normal((8000, 32))), rng.standard_normal((200, 32))]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    x[50] = 0.01 * rng.standard_normal(32) + np.eye(32)[0] * 9
    got = {}
    for r in ann.nearest(_vectors(spark, x), every=50, k=5, list_size=8, most_probes=48, probe_share=0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _brute(x, range(len(x)), 50, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * 5 * len(want)


def test_ann_lengths_apart(spark):
    got = ann.nearest(_vectors(spark, [[1, 0], [1, 1], [1, 0, 0], [1, 1, 0], [0, 1, 1]]), every=1, k=2).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1), (1, 0), (2, 3), (2, 4), (3, 2), (3, 4), (4, 2), (4, 3)]


def test_ann_few_and_none(spark):
    x = np.eye(3, dtype=np.float32)
    got = ann.nearest(_vectors(spark, x), every=50, k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert ann.nearest(_vectors(spark, []), every=50).count() == 0


def test_base_text_is_used():
    assert len(words(BASE)) > 20


def test_ann_deals_each_block_of_a_list_once(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    deal = ann.Deal(np.array([5, 35, 0, 12, 9]), 30)
    assert deal.blocks.tolist() == [1, 4, 1, 2, 1] and (np.diff(deal.group) >= 0).all() and deal.group[-1] > 0
    row, group, units = deal.rows([[1, 0], [4], [3, 1]])
    assert len(set(zip(row.tolist(), group.tolist()))) == len(row)
    assert [sorted(u for r, us in zip(row, units) if r == n for u in us) for n in range(3)] == [[0, 1, 2, 3, 4], [8], [1, 2, 3, 4, 6, 7]]
    row, _, units = deal.rows([[1, 0], [3]], [6, 7])  # a vector is in one block of each list
    assert [sorted(u for r, us in zip(row, units) if r == n for u in us) for n in range(2)] == [[0, 3], [7]]


def test_ann_queries_are_dealt_to_tasks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    found = ann.nearest(_vectors(spark, x), every=3, k=4, list_size=40, most_probes=900, probe_ratio=9.0)
    assert "RoundRobinPartitioning(4)" in found._jdf.queryExecution().toString()  # the search by queries was one task
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -9)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = {q: dict(enumerate(np.argsort(-sim[q])[:4].tolist(), 1)) for q in range(0, 900, 3)}
    assert got == want
