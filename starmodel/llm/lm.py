"""Language-model scores of whole texts: a log-bilinear model with
noise-contrastive estimation, over counts of the whole corpus.

The outcomes of the model are the most frequent words, the end of a text, and
tail groups, which hold all other words by their last bytes. A position's
context is the elementwise weighted sum of the vectors of the outcomes before
it; its product with the vectors of the classes, and of the outcomes of a
class, normalised, gives the probability of an outcome. A word of a tail group
then has its share of the group's count. Each probability is normalised, over
all words seen in training and one slot for unseen ones a group."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmodel.llm.common import LOWER_TABLE, WHITE, discard, materialize

WORDS = 3840  # outcomes that are words, the end of a text among them
TAILS = 256
WIDE = 64  # outcomes of a class
DIM = 16
CONTEXT = 5
CHUNK = 1024  # positions that are scored over all classes at once
BATCH, WARM_BATCH = 16384, 1024  # positions of a step of training, and of the first task's
NOISE_CLASSES, NOISE_WORDS = 16, 8
DICTIONARY = 400_000  # counts that every task holds; those of other words are joined
WARM = 1_500_000  # tokens, about, that one task trains on first, to give all others their start
SOME = 6_000_000  # bytes of text that are gone through together
PARTIAL = 800_000  # words of which a task sums up counts before it passes them on
RATE, WARM_RATE = 0.1, 0.2
NEVER = -1e4  # the bias of an outcome that isn't there
END = b""
#: A-Z lower-cased, all white space as spaces.
_CLEAN = LOWER_TABLE.translate(bytes(32 if chr(b) in WHITE else b for b in range(256)))


def tail_group(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def is_held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 7 (never for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """The batches in portions of at most about SOME bytes of their column
    `text`: the portion, where its texts' words begin, and the words as indices
    into the different ones of the portion."""
    for batch in batches:
        column = batch.column(text)
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SOME, side="right")) - 1)
            low, high = int(offsets[at]), int(offsets[end])
            clean = (column.buffers()[2].slice(low, high - low).to_pybytes() if high > low else b"").translate(_CLEAN)
            texts = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer((offsets[at : end + 1] - low).tobytes()), pa.py_buffer(clean)])
            lists = pc.split_pattern(texts, b" ")
            found = lists.flatten()
            there = pc.not_equal(pc.binary_length(found), 0)
            begins = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield batch.slice(at, end - at), begins, found.filter(there).dictionary_encode()
            at = end


def count_words(docs: DataFrame, text_col: str = "text", most: int = PARTIAL) -> DataFrame:
    """`word` (binary; the end of a text is empty), `tail`, `c` over all rows of
    `docs`. Each task sums up what it has seen, at about `most` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for portion, _, coded in _portions(batches, 0):
            ends = pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([len(portion)], pa.int64())})
            held += [pa.table({"word": coded.dictionary, "c": np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))}), ends]
            if sum(map(len, held)) > 2 * most:
                held = [summed()]
                if len(held[0]) > most:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
        if held:
            yield from summed().combine_chunks().to_batches()

    given = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = F.crc32(F.substring("word", -3, 3)) % TAILS
    return given.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).select("word", tail.cast("int").alias("tail"), "c")


@dataclass
class Vocabulary:
    """What every task knows of the counts; `counts` has at most DICTIONARY words."""

    known: dict[bytes, int]  # word -> its place by falling count, the end first
    counts: np.ndarray
    heads: int  # the first so many are outcomes of their own
    outcome: np.ndarray  # outcome of each place
    weights: np.ndarray  # count of each outcome
    tail_total: np.ndarray  # count + words + 1 of each tail group
    n: int
    v: int

    @property
    def outcomes(self) -> int:
        return self.heads + TAILS


def vocabulary(counts: DataFrame, heads: int = WORDS, dictionary: int = DICTIONARY) -> Vocabulary:
    """Collects the most frequent words (fewer than `dictionary`, all that reach a
    count) and sums over the rest."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    named = counts.where(F.length("word") > 0)
    # from how many words have each count: the least count that few enough words reach
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("c"))
    reached = named.groupBy("c").agg(F.count("*").alias("words")).select("c", F.sum("words").over(order).alias("words"))
    least = reached.where(F.col("words") < dictionary).agg(F.min("c")).first()[0]
    found = named.where(F.col("c") >= least).select("word", "c").toArrow().to_pydict() if least is not None else {"word": [], "c": []}
    top = sorted(zip([-x for x in found["c"]], found["word"]))
    end = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    names = [END, *(w for _, w in top)]
    c = np.array([end, *(-x for x, _ in top)], np.int64)
    heads = min(heads, len(names))
    tails = np.zeros((TAILS, 2), np.int64)
    for r in counts.where(F.length("word") > 0).groupBy("tail").agg(F.sum("c").alias("s"), F.count("*").alias("w")).collect():
        tails[r["tail"]] = r["s"], r["w"]
    for w, x in zip(names[1:heads], c[1:heads].tolist()):
        tails[tail_group(w)] -= (x, 1)
    outcome = np.array([i if i < heads else heads + tail_group(w) for i, w in enumerate(names)], np.int64)
    weights = np.concatenate([c[:heads], tails[:, 0]])
    return Vocabulary({w: i for i, w in enumerate(names) if i}, c, heads, outcome, weights, tails.sum(axis=1) + 1, int(n), int(v))


class LogBilinear:
    """Vectors of outcomes as context (`r`) and as prediction (`q`, `b`), of
    classes (`qc`, `bc`), and the weights of the context's places (`place`).
    Outcome i is number i // classes of class i % classes."""

    def __init__(self, weights: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        n = len(weights)
        self.classes = max(1, -(-n // WIDE))
        share = (weights + 1.0) / (weights + 1.0).sum()
        grid = np.zeros((WIDE, self.classes))
        grid.reshape(-1)[:n] = share
        self.class_share = grid.sum(axis=0)
        self.word_share = (grid / self.class_share).T.copy()  # class x number
        self.start = n
        f = np.float32
        self.r = (rng.standard_normal((n + 1, DIM)) * 0.1).astype(f)
        self.q = (rng.standard_normal((self.classes, WIDE, DIM)) * 0.1).astype(f)
        self.qc = (rng.standard_normal((self.classes, DIM)) * 0.1).astype(f)
        with np.errstate(divide="ignore"):
            self.b = np.where(self.word_share > 0, np.log(self.word_share), NEVER).astype(f)
        self.bc = np.log(self.class_share).astype(f)
        self.place = np.ones((CONTEXT, DIM), f) / 2

    #: What training changes.
    PARTS = ("r", "q", "qc", "b", "bc", "place")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).reshape(-1) for p in self.PARTS])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for p in self.PARTS:
            a = getattr(self, p)
            setattr(self, p, values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size

    def stream(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' outcomes one after the other, each after CONTEXT starts,
        and where they are."""
        pad = np.full(CONTEXT, self.start)
        ids = np.concatenate([x for t in texts for x in (pad, t)])
        return ids, np.flatnonzero(ids != self.start)

    def contexts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.r.take(ids, axis=0)
        h = np.zeros_like(e)
        part = np.empty((min(len(e), CHUNK), e.shape[1]), e.dtype)
        for at in range(0, len(e), CHUNK):  # in parts that stay in the cache
            for j in range(CONTEXT):
                a, b = max(at, j + 1), min(at + CHUNK, len(e))
                if a < b:
                    np.multiply(e[a - j - 1 : b - j - 1], self.place[j], out=part[: b - a])
                    h[a:b] += part[: b - a]
        return h, e

    def log_probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of each text's probability."""
        ids, at = self.stream(texts)
        h, target = self.contexts(ids)[0].take(at, axis=0), ids.take(at)
        k, number = target % self.classes, target // self.classes
        longest = np.sqrt((h * h).sum(axis=1).max())
        high = lambda q, b: longest * np.sqrt((q * q).sum(axis=-1).max()) + np.abs(b[b > NEVER / 2]).max()
        out = np.empty(len(h))
        shift = high(self.qc, self.bc) > 60
        for i in range(0, len(h), CHUNK):
            out[i : i + CHUNK] = _log_softmax(h[i : i + CHUNK], self.qc, self.bc, k[i : i + CHUNK], shift)
        order, ends = _by_class(k, self.classes)
        h, number, more = h.take(order, axis=0), number.take(order), np.empty(len(h))
        shift = high(self.q, self.b) > 60
        for c, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            for i in range(a, b, CHUNK):
                e = min(b, i + CHUNK)
                more[i:e] = _log_softmax(h[i:e], self.q[c], self.b[c], number[i:e], shift)
        out[order] += more
        return np.add.reduceat(out, np.append(0, np.cumsum([len(t) for t in texts])[:-1]))


def _by_class(k: np.ndarray, classes: int) -> tuple[np.ndarray, list[int]]:
    """The positions in the order of their class, and where each class begins and ends in it."""
    order = np.argsort(k.astype(np.uint8 if classes <= 256 else np.int32), kind="stable")  # bytes are sorted by counting
    return order, np.append(0, np.cumsum(np.bincount(k, minlength=classes))).tolist()


def _log_softmax(h: np.ndarray, q: np.ndarray, b: np.ndarray, pick: np.ndarray, shift: bool) -> np.ndarray:
    """log(softmax(h q + b)) at `pick`; scores that can't overflow need no shift."""
    s = h @ q.T
    s += b
    if shift:
        s -= s.max(axis=1, keepdims=True)
    chosen = s[np.arange(len(s)), pick].astype(np.float64)
    np.exp(s, out=s)
    return chosen - np.log(s @ np.ones(s.shape[1], s.dtype))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of `values` (one row each) by `rows` (below n, itself below 65,536)."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    found = rows.take(order)
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[found[first]] = np.add.reduceat(values.take(order, axis=0), first)
    return out


class Trainer:
    """Noise-contrastive steps: each observed class, and outcome in its class, is
    told from noise that is drawn by frequency and shared by a step's positions.
    Gradients are scaled by their past squares."""

    def __init__(self, model: LogBilinear, seed: int, rate: float = RATE, past: np.ndarray | None = None) -> None:
        self.m, self.rng, self.rate = model, np.random.default_rng(seed), rate
        self.past = np.full(len(model.flat()), 1e-2, np.float32) if past is None else past.astype(np.float32)
        self.log_class = np.log(NOISE_CLASSES * model.class_share).astype(np.float32)
        self.log_word = np.log(NOISE_WORDS * np.maximum(model.word_share, 1e-30)).astype(np.float32)
        self.cumulative = np.cumsum(model.word_share, axis=1)

    def step(self, texts: list[np.ndarray]) -> None:
        m, rng, classes = self.m, self.rng, self.m.classes
        ids, at = m.stream(texts)
        h_all, e = m.contexts(ids)
        h, target = h_all.take(at, axis=0), ids.take(at)
        order, ends = _by_class(target % classes, classes)
        h, target = h.take(order, axis=0), target.take(order)  # by class from here
        k, cell = target % classes, target % classes * WIDE + target // classes
        q, b = m.q.reshape(-1, DIM), m.b.reshape(-1)
        # classes: the observed one, then the noise
        noise = rng.choice(classes, NOISE_CLASSES, p=m.class_share / m.class_share.sum())
        mine = m.qc.take(k, axis=0)
        good = 1 - _sigmoid(np.einsum("nd,nd->n", h, mine) + (m.bc - self.log_class).take(k))
        bad = h @ m.qc[noise].T
        bad += (m.bc - self.log_class)[noise]
        bad = _sigmoid(bad)
        mine *= good[:, None]
        dh = mine
        dh -= bad @ m.qc[noise]
        starts = np.flatnonzero(np.diff(ends))
        gqc, gbc = np.zeros_like(m.qc), np.zeros_like(m.bc)
        gqc[starts] = np.add.reduceat(h * good[:, None], np.array(ends)[starts])
        gbc[starts] = np.add.reduceat(good, np.array(ends)[starts])
        np.subtract.at(gqc, noise, bad.T @ h)
        np.subtract.at(gbc, noise, bad.sum(axis=0))
        # outcomes in their class
        mine = q.take(cell, axis=0)
        good = 1 - _sigmoid(np.einsum("nd,nd->n", h, mine) + b.take(cell) - self.log_word.reshape(-1).take(cell))
        draws = rng.random((classes, NOISE_WORDS)) * self.cumulative[:, -1:]
        noise = (self.cumulative[:, None, :] < draws[:, :, None]).sum(axis=2).clip(max=WIDE - 1) + np.arange(classes)[:, None] * WIDE
        qn, bn = q[noise], b[noise] - self.log_word.reshape(-1)[noise]
        bad = np.empty((len(h), NOISE_WORDS), np.float32)
        there = [(c, i, j) for c, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if i < j]
        for c, i, j in there:
            np.matmul(h[i:j], qn[c].T, out=bad[i:j])
        bad += bn.take(k, axis=0)
        _sigmoid(bad)
        mine *= good[:, None]
        dh += mine
        gn = np.zeros_like(qn)
        for c, i, j in there:
            dh[i:j] -= bad[i:j] @ qn[c]
            gn[c] = bad[i:j].T @ h[i:j]
        gb = np.zeros((classes, NOISE_WORDS), np.float32)
        gb[[c for c, _, _ in there]] = np.add.reduceat(bad, [i for _, i, _ in there])
        gq, gbias = _sums(cell, h * good[:, None], len(q)), np.bincount(cell, good, len(q)).astype(np.float32)
        np.subtract.at(gq, noise.reshape(-1), gn.reshape(-1, DIM))
        np.subtract.at(gbias, noise.reshape(-1), gb.reshape(-1))
        # back through the contexts
        wide = np.zeros_like(h_all)
        wide[at[order]] = dh
        de, gp = np.zeros_like(e), np.zeros_like(m.place)
        part, ones = np.empty((CHUNK, DIM), np.float32), np.ones(CHUNK, np.float32)
        for i in range(0, len(e), CHUNK):
            for j in range(CONTEXT):
                end = min(i + CHUNK, len(e) - j - 1)
                if i < end:
                    later = wide[i + j + 1 : end + j + 1]
                    np.multiply(later, m.place[j], out=part[: end - i])
                    de[i:end] += part[: end - i]
                    np.multiply(later, e[i:end], out=part[: end - i])
                    gp[j] += ones[: end - i] @ part[: end - i]
        g = np.concatenate([x.reshape(-1) for x in (_sums(ids, de, len(m.r)), gq, gqc, gbias, gbc, gp)])
        g *= 1e2 / len(at)
        self.past += g * g
        g *= self.rate / np.sqrt(self.past)
        i = 0
        for p in m.PARTS:
            value = getattr(m, p)
            value += g[i : i + value.size].reshape(value.shape)
            i += value.size


def _train(model: LogBilinear, past: np.ndarray | None, batch: int, rate: float, seed: int, texts: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """Trains `model` in steps of `batch` positions; gives the past squares and the positions."""
    trainer, held, size, seen = Trainer(model, seed, rate, past), [], 0, 0
    for ids in texts:
        for at in range(0, len(ids), batch):  # a long text is more than one step
            held.append(ids[at : at + batch])
            size += len(held[-1])
            if size >= batch:
                trainer.step(held)
                held, seen, size = [], seen + size, 0
    if held:
        trainer.step(held)
    return trainer.past, seen + size


def train(texts: DataFrame, weights: np.ndarray, n: int) -> LogBilinear:
    """Trains on all rows of `texts` (`row`, `ids`: outcomes as 16-bit integers;
    `n` in all). One task trains on a sample of about WARM outcomes, chosen by
    hash; all tasks then start from its model, train on their own rows, and what
    they end with is averaged, weighted by outcomes, in two levels. Only models
    (their size is fixed) are brought together, and reach the driver. The last
    level is one task for the square root of the number of tasks."""
    spark = texts.sparkSession
    model, past = LogBilinear(weights), None

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for ids in batch.column(0):
                yield np.frombuffer(ids.as_buffer(), "<u2").astype(np.int64)

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = LogBilinear(weights)
        squares, seen = _train(mine, None, WARM_BATCH, WARM_RATE, 7, arrays(batches))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (mine.flat(), squares)], ["model", "past"])

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, WARM / max(1, n))))
    found = some.select("ids", F.xxhash64("row").alias("h")).repartition(1).sortWithinPartitions("h").select("ids").mapInArrow(warm, "model binary, past binary").collect()
    if found:
        model.load(np.frombuffer(found[0]["model"], "<f4"))
        past = np.frombuffer(found[0]["past"], "<f4")
    start = spark.sparkContext.broadcast((model.flat(), past))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, mine = TaskContext.get().partitionId(), LogBilinear(weights)
        mine.load(start.value[0])
        _, seen = _train(mine, start.value[1], BATCH, RATE, 100 + part, arrays(batches))
        if seen:
            blob = (mine.flat().astype(np.float64) * seen).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([blob], pa.binary())], ["part", "seen", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "<f4").astype(np.float64) for b in pdf["sums"])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "seen": [pdf["seen"].sum()], "sums": [total.astype("<f4").tobytes()]})

    schema = "part long, seen double, sums binary"
    sums = materialize(texts.select("ids").mapInArrow(run, schema), "lm-parts")
    groups = max(1, int(sums.count() ** 0.5))
    whole = sums.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInPandas(add, schema).groupBy(F.lit(0).alias("g")).applyInPandas(add, schema).collect()
    discard(sums)
    if whole:
        model.load(np.frombuffer(whole[0]["sums"], "<f4").astype(np.float64) / whole[0]["seen"])
    return model


def encoded(docs: DataFrame, vocab, text_col: str = "text") -> DataFrame:
    """`docs` with its text as `ids` (the outcome of each token, as 16-bit
    integers), `n_tokens`, `known` (tokens of the dictionary that were counted),
    `base` (what they add to the logarithm to base 10 under add-one counts, less
    the total's part), `own` (what the shares of words in their tail groups add,
    but for words that aren't in the dictionary), and `rest`, these words."""
    columns = [c for c in docs.columns if c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [*columns, "ids", "n_tokens", "known", "base", "own", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocab.value
        plus, tail_log = np.log10(voc.counts + 1.0), np.log10(voc.tail_total.astype(float))
        total = np.log10(voc.n + voc.v + 1.0)
        for portion, begins, coded in _portions(batches, len(columns)):
            different = coded.dictionary.to_pylist()
            place = np.fromiter(map(voc.known.get, different, repeat(-1)), np.int64, len(different))
            outcome = voc.outcome[place]
            new = np.flatnonzero(place < 0)
            outcome[new] = [voc.heads + tail_group(different[i]) for i in new.tolist()]
            base = np.where(place < 0, 0.0, plus[place])
            # a word of a tail group, and one that the dictionary lacks, whose count is joined later
            own = np.where(outcome < voc.heads, 0.0, base - tail_log[np.maximum(outcome - voc.heads, 0)])
            words = coded.indices.to_numpy()
            inside = lambda x: np.diff(np.append(0.0, np.cumsum(x[words]))[begins])
            known = inside((place >= 0) & (voc.counts[place] > 0)).astype(np.int64) + int(voc.counts[0] > 0)
            n = np.diff(begins) + 1
            ids = np.zeros(len(words) + len(portion), "<u2")
            ids[np.arange(len(words)) + np.repeat(np.arange(len(portion)), n - 1)] = outcome[words]
            rest = place[words] < 0
            offsets = np.append(0, np.cumsum(rest))[begins].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *portion.columns[: len(columns)],
                    pa.Array.from_buffers(pa.binary(), len(portion), [None, pa.py_buffer((2 * np.append(0, np.cumsum(n))).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                    pa.array(n), pa.array(known), pa.array(inside(base) + plus[0] - n * total), pa.array(inside(own)),
                    pa.ListArray.from_arrays(pa.array(offsets), coded.dictionary.take(pa.array(words[rest]))),
                ],
                names,
            )

    given = docs.select(*columns, text_col)
    return given.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "ids binary, n_tokens long, known long, base double, own double, rest array<binary>"]))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heads: int = WORDS, dictionary: int = DICTIONARY) -> DataFrame:
    """Each row of `docs` as `doc_id`, `held_out`, `n_tokens`, `n_known`,
    `train_tokens`, `base_score`, `score`: logarithms to base 10 of the
    probability of its whole text (null: empty) under add-one counts and under
    the model, learned from the rows that aren't held out. Other columns of
    `docs`, whatever their names, have no part in it.

    All training tokens are counted in Spark. The most frequent words (a number
    that is fixed) are in every task; other words of a text are exploded and
    joined to the counts, so no task holds them all. Texts are split once into
    outcomes, which training and scoring then read. Without training rows every
    word is unseen; an empty table gives no rows. Rows with the same id are
    scored one by one.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), is_held_out(F.col(id_col)).alias("held_out"))
    counts = materialize(count_words(given.where(~F.col("held_out"))), "lm-counts")
    vocab = vocabulary(counts, heads, dictionary)
    n, v = vocab.n, vocab.v
    texts = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    texts = materialize(encoded(texts, spark.sparkContext.broadcast(vocab)), "lm-texts")
    model = spark.sparkContext.broadcast(train(texts.where(~F.col("held_out")).select("row", "ids"), vocab.weights, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, logs = [], 0, [np.empty(0)]
            for x in batch.column(0):
                ids = np.frombuffer(x.as_buffer(), "<u2").astype(np.int64)
                if size and size + len(ids) > 80_000:
                    logs.append(model.value.log_probabilities(held))
                    held, size = [], 0
                if len(ids) > 80_000:  # in parts, each after the words before it
                    logs.append(np.array([sum(_parts(model.value, ids))]))
                else:
                    held.append(ids)
                    size += len(ids)
            if held:
                logs.append(model.value.log_probabilities(held))
            columns = [*batch.columns[1:-1], pa.array(np.concatenate(logs) / np.log(10) + batch.column(batch.num_columns - 1).to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"])

    scored = texts.select("ids", "row", "doc_id", "held_out", "n_tokens", "known", "base", "own").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double")
    rest = texts.select("row", F.explode("rest").alias("word"))
    found = rest.join(counts.select("word", "c"), "word").groupBy("row").agg(F.count("*").alias("also"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    out = scored.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def _parts(lm: LogBilinear, ids: np.ndarray, step: int = 50_000) -> Iterator[float]:
    for at in range(0, len(ids), step):
        lead = ids[max(0, at - CONTEXT) : at]
        both = lm.log_probabilities([np.concatenate([lead, ids[at : at + step]])])[0]
        yield float(both - (lm.log_probabilities([lead])[0] if len(lead) else 0.0))
