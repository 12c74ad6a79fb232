"""The hash tree against the plain comparison."""

import random

from starmodel.operators import quality


def test_same_as_reconcile(spark):
    r = random.Random(5)
    source = [(r.randrange(300), r.choice([None, "a", "b"])) for _ in range(600)]
    target = [x for x in source if r.random() > 0.02] + [(r.randrange(300), "c") for _ in range(5)] + source[:3]
    a, b = (spark.createDataFrame(x, "k long, v string").repartition(3) for x in (source, target))
    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    for levels in ((4, 64), (1 << 12, 1 << 20)):
        assert rows(quality.reconcile_by_hash(a, b, ["k", "v"], levels)) == rows(quality.reconcile(a, b, ["k", "v"]))
    assert quality.reconcile_by_hash(a, a, ["k", "v"]).count() == 0 and quality.reconcile_by_hash(a.limit(0), a.limit(0), ["k", "v"]).count() == 0
    assert rows(quality.reconcile_by_hash(a, b.limit(0), ["k", "v"])) == rows(quality.reconcile(a, b.limit(0), ["k", "v"]))
