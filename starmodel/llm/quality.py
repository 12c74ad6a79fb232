"""A quality classifier: a sparse ensemble of rules over text statistics.

Rules are the paths of small trees; lasso logistic regression leaves few of them
with a weight; those are compiled into a Spark column expression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import hash_sample, unpacked, whole_row

STATISTICS = (
    "chars", "words", "lines", "upper_share", "symbol_share", "bar_share", "exclaim_share", "digit_share", "stop_share",
    "word_chars", "line_words", "distinct_word_share", "distinct_line_share",
)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as the struct `_doc`, with `_<statistic>` doubles of its whole
    text (null counts as empty) and `_barrier`, which keeps Spark from computing
    a statistic once for each rule that uses it."""
    t = F.col("_t")
    base = docs.select(whole_row(docs).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.select("*", F.length(t).cast("double").alias("_chars"), F.filter(F.split(t, "[ \\n]"), lambda w: w != "").alias("_ws"), F.split(t, "\n").alias("_ls"), F.monotonically_increasing_id().alias("_barrier"))
    one = lambda c: F.greatest(c, F.lit(1.0))
    share = lambda n: n.cast("double") / one(F.col("_chars"))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    out = base.select(
        "_doc", "_chars", F.size("_ws").cast("double").alias("_words"), F.size("_ls").cast("double").alias("_lines"),
        share(F.regexp_count(t, F.lit("\\p{Lu}"))).alias("_upper_share"), share(F.regexp_count(t, F.lit("[#$%&*@^~<>{}=_+\\\\/\\[\\]]"))).alias("_symbol_share"),
        share(count("|")).alias("_bar_share"), share(count("!")).alias("_exclaim_share"), share(F.regexp_count(t, F.lit("[0-9]"))).alias("_digit_share"), share(count(".") + count(",")).alias("_stop_share"),
        F.size(F.array_distinct("_ws")).cast("double").alias("_dw"), F.size(F.array_distinct("_ls")).cast("double").alias("_dl"), F.monotonically_increasing_id().alias("_barrier"),
    )
    return out.select(
        "*", (F.col("_chars") / one(F.col("_words"))).alias("_word_chars"), (F.col("_words") / one(F.col("_lines"))).alias("_line_words"),
        (F.col("_dw") / one(F.col("_words"))).alias("_distinct_word_share"), (F.col("_dl") / one(F.col("_lines"))).alias("_distinct_line_share"),
    ).drop("_dw", "_dl")


@dataclass
class RuleModel:
    """score = logistic(intercept + sum of the weights of the rules that hold);
    a rule is a list of (statistic, above, threshold) that must all hold."""

    intercept: float = 0.0
    rules: list[tuple[list[tuple[str, bool, float]], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score over the columns of `with_statistics`, from 0 to 1."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [(F.col(f"_{s}") > t) if above else (F.col(f"_{s}") <= t) for s, above, t in conditions])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same for rows of statistics in the order of STATISTICS."""
        total = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            total += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, conditions: list[tuple[str, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, t in conditions:
        c = x[:, STATISTICS.index(s)]
        out &= (c > t) if above else (c <= t)
    return out


def _paths(x: np.ndarray, residual: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[list[list[tuple[str, bool, float]]], np.ndarray]:
    """The conditions of every node of one tree on the residuals, and its fit."""
    out, fit = [], np.zeros(len(x))
    stack = [(np.arange(len(x)), [])]
    while stack:
        rows, conditions = stack.pop()
        if conditions:
            out.append(conditions)
        fit[rows] = residual[rows].mean() if len(rows) else 0.0
        if len(conditions) == depth or len(rows) < 2 * least:
            continue
        best = (1e-9, None, 0.0)
        r = residual[rows]
        total, n = r.sum(), len(rows)
        for j in rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False):
            v = x[rows, j]
            cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, 33)))
            if len(cuts) < 2:
                continue
            at = np.searchsorted(cuts, v, side="left")
            sums = np.cumsum(np.bincount(at, r, len(cuts) + 1))[:-1]
            counts = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
            ok = (counts >= least) & (n - counts >= least)
            gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, float(cuts[k]))
        if best[1] is not None:
            _, j, t = best
            low = x[rows, j] <= t
            stack += [(rows[low], [*conditions, (STATISTICS[j], False, t)]), (rows[~low], [*conditions, (STATISTICS[j], True, t)])]
    return out, fit


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 1e-3, rounds: int = 400, seed: int = 7) -> RuleModel:
    """Fits the ensemble to rows of STATISTICS and labels 0/1. Without rows of
    both labels the score is the smoothed share of label 1."""
    n = len(y)
    rate = (y.sum() + 1.0) / (n + 2.0)
    model = RuleModel(float(np.log(rate / (1 - rate))))
    if n < 20 or len(np.unique(y)) < 2:
        return model
    rng = np.random.default_rng(seed)
    score, seen = np.full(n, model.intercept), {}
    least = max(5, n // 400)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        some = rng.random(n) < 0.7
        if some.sum() < 2 * least:
            some[:] = True
        paths, _ = _paths(x[some], residual[some], rng, depth, least)
        for conditions in paths:
            holds = _holds(x, conditions)
            seen.setdefault(holds.tobytes(), (conditions, holds))
        leaves = [_holds(x, c) for c in paths if len(c) == depth] or [_holds(x, c) for c in paths]
        for holds in leaves:
            if holds.any():
                p = 1 / (1 + np.exp(-score[holds]))
                score[holds] += 0.3 * residual[holds].sum() / max(1e-3, (p * (1 - p)).sum())
        score = np.clip(score, -6, 6)
    rules = [c for c, h in seen.values() if 0 < h.sum() < n]
    if not rules:
        return model
    a = np.stack([h for _, h in seen.values() if 0 < h.sum() < n], axis=1).astype(np.float32)
    scale = np.maximum(a.std(axis=0), 0.02)
    mean = a.mean(axis=0)
    z = (a - mean) / scale
    w, b, v, vb, t = np.zeros(z.shape[1], np.float32), model.intercept, np.zeros(z.shape[1], np.float32), model.intercept, 1.0
    u = np.ones(z.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, for the step
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u)
    step = 4 / (float(np.linalg.norm(z @ u) ** 2) / n + 1)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        w1 = v - step * (z.T @ g.astype(np.float32) / n)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = vb - step * float(g.mean())
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1.astype(np.float32), b1, t1
    keep = np.flatnonzero(w)
    weights = w[keep] / scale[keep]
    return RuleModel(float(b - (weights * mean[keep]).sum()), [(rules[i], float(x)) for i, x in zip(keep, weights)])


def held_out(id_col: Column) -> Column:
    """Whether labels of a row are kept from learning: crc32 of its id as text
    is divisible by 5 (never for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000) -> RuleModel:
    """Fits the rules to at most `most` labelled rows that aren't held out: those
    whose ids have the smallest hashes. Only these rows' statistics are computed
    here and reach the driver; the sample of labels is what is broadcast. Rows
    without a label or an id are left out; of several labels of an id the
    largest counts, of several texts the one with the smallest hash."""
    given = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label")).where("_label IS NOT NULL AND _label_id IS NOT NULL")
    given = given.where(~held_out(F.col("_label_id"))).groupBy("_label_id").agg(F.max("_label").alias("_label"))
    given = hash_sample(given, "_label_id", most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(given), F.col("_id") == F.col("_label_id"))
    seen = with_statistics(rows, "_text").select("_doc._id", "_doc._label", F.xxhash64("_doc._text").alias("_h"), *[f"_{s}" for s in STATISTICS])
    one = seen.groupBy("_id", "_label").agg(F.min(F.struct("_h", *[f"_{s}" for s in STATISTICS])).alias("x"))
    seen = one.select("_id", "_label", "x.*").toPandas().sort_values("_id")
    return fit_rules(seen[[f"_{s}" for s in STATISTICS]].to_numpy(float), (seen["_label"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """`docs` with `_score`; one pass without a shuffle. Empty and null texts
    have statistics of zero and are scored like any other."""
    out = with_statistics(docs, text_col).select("_doc", model.column().alias("_own"))
    return out.select(*unpacked(docs, but=["_score"]), F.col("_own").alias("_score"))


def good(docs: DataFrame, model: RuleModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, whose score is at least `least`."""
    out = with_statistics(docs, text_col).where(model.column() >= least)
    return out.select(*unpacked(docs))
