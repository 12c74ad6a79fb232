import hashlib
import time
from collections import Counter

from starmodel.llm import line_dedup

from .helpers import rows, table

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(texts, least, min_chars):
    n = Counter()
    for t in texts:
        n.update({k for k in map(key, (t or "").split("\n")) if len(k) >= min_chars})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_brute_force(spark):
    given = rows()
    for least, min_chars in ((10, 1), (2, 1), (2, 0), (1, 1)):
        out = line_dedup.drop_common_lines(table(spark), min_docs=least, min_chars=min_chars)
        assert set(table(spark).columns) <= set(out.columns)
        got = sorted(((r.doc_id is None, r.doc_id or 0, r._n_lines, r._n_dropped, hashlib.sha256(r._kept.encode()).hexdigest()) for r in out.collect()))
        want = sorted((g[0] is None, g[0] or 0, a, b, hashlib.sha256(k.encode()).hexdigest()) for g, (a, b, k) in zip(given, brute([g[1] for g in given], least, min_chars)))
        assert got == want


def test_keys_differ_only_by_ascii_case_and_space(spark):
    texts = ["É a\n  Same LINE \t", "é a\nsame line"]
    got = {r.doc_id: r._kept for r in line_dedup.drop_common_lines(table(spark, texts), min_docs=2).collect()}
    assert got == {0: "É a", 1: "é a"}


def test_empty_table(spark):
    assert line_dedup.drop_common_lines(table(spark, [])).count() == 0


def test_native_plan(spark):
    plan = line_dedup.drop_common_lines(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_many_lines_in_one_text(spark):
    """Work on a text is in proportion to its lines."""
    long = [f"own {i}" if i % 2 else f"common {i}" for i in range(200_000)]
    common = "\n".join(long[::2])
    start = time.time()
    got = {r.doc_id: (r._n_lines, r._n_dropped, r._kept) for r in line_dedup.drop_common_lines(table(spark, ["\n".join(long), common]), min_docs=2).collect()}
    assert got == {0: (200_000, 100_000, "\n".join(long[1::2])), 1: (100_000, 100_000, "")}
    assert time.time() - start < 60
