"""Best-fit packing of token pieces into sequences by a linear grouping scheme."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import materialize, numbered
from starmodel.llm.tokens import byte_encoder, default_path

#: Characters of texts that are encoded together, if these are several texts.
CHARS = 2_000_000
#: Chunks whose ids a task remembers.
CHUNKS = 250_000


def group_lengths(counts: Counter, smallest: int, groups: int) -> list[list[tuple[int, int]]]:
    """The lengths of at least `smallest`, largest first, in `groups` groups of
    equal cardinality: lists of (length, number). The first member of a group is
    the size that all of it is rounded up to."""
    total = sum(n for length, n in counts.items() if length >= smallest)
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted((x for x in counts if x >= smallest), reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _best_fill(sizes: list[int], values: list[float], limits: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """The configuration (size index -> copies, within `limits`) of the greatest
    value in `capacity`: a bounded knapsack over the few sizes."""
    best = np.zeros(capacity + 1)
    picks = []
    for size, value, limit in zip(sizes, values, limits):
        pick = np.zeros(capacity + 1, np.int8)
        top = best.copy()
        for k in range(1, min(limit, capacity // size) + 1):
            cand = best[: capacity + 1 - k * size] + k * value
            better = cand > top[k * size :] + 1e-12
            top[k * size :][better] = cand[better]
            pick[k * size :][better] = k
        best = top
        picks.append(pick)
    at, out = capacity, {}
    for i in range(len(sizes) - 1, -1, -1):
        k = int(picks[i][at])
        if k:
            out[i] = k
            at -= k * sizes[i]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400, rest: bool = True) -> list[tuple[dict[int, int], int]]:
    """Configurations of the few rounded sizes and how often each is used, to
    cover the demand with few sequences (without `rest` only what the programme
    uses a whole number of times).

    The linear programme over all configurations is solved by generating them:
    those in use price each size, a knapsack finds the configuration that is
    worth most at these prices, and it replaces the one it drives to zero, until
    none is worth more than a sequence. What is used a whole number of times
    stays; the rest of the demand is covered by the fullest configurations of
    what is left, again and again."""
    n, want = len(sizes), np.array(demand, float)
    limits = [capacity // s for s in sizes]
    columns = np.diag(np.array(limits, float)) if n else np.zeros((0, 0))
    for _ in range(rounds if n else 0):
        prices = np.linalg.solve(columns.T, np.ones(n))
        worth, pick = _best_fill(sizes, prices.tolist(), limits, capacity)
        if worth <= 1 + 1e-7:
            break
        new = np.array([pick.get(i, 0) for i in range(n)], float)
        used, change = np.linalg.solve(columns, want), np.linalg.solve(columns, new)
        ratio = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    left, out = list(demand), []
    times = np.floor(np.maximum(np.linalg.solve(columns, want), 0) + 1e-9).astype(int).tolist() if n else []
    for column, t in sorted(zip(columns.T.astype(int).tolist(), times), reverse=True):
        pattern = {i: k for i, k in enumerate(column) if k}
        t = min([t, *(left[i] // k for i, k in pattern.items())])
        if t:
            out.append((pattern, t))
            for i, k in pattern.items():
                left[i] -= k * t
    while rest and any(left):
        live = [i for i, x in enumerate(left) if x]
        # filling the room is worth its tokens, large pieces a little more, as they are harder to place later
        _, pick = _best_fill([sizes[i] for i in live], [sizes[i] * (1 + 0.02 * sizes[i] / capacity) for i in live], [left[i] for i in live], capacity)
        pattern = {live[i]: k for i, k in pick.items()}
        t = min(left[i] // k for i, k in pattern.items())
        for i, k in pattern.items():
            left[i] -= k * t
        out.append((pattern, t))
    return out


#: Groups of large lengths, and from which share of the capacity on lengths are large.
GROUPS, LARGE = 256, (1 / 2, 1 / 3)


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences of those in which lengths are `large` from
    different shares of the capacity on. The more lengths are grouped, the more is
    lost by rounding, and the more configurations there are to gain by."""
    plans = [_plan(counts, capacity, max(1, groups // (1 + (share < 1 / 2))), share) for share in large]
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def _plan(counts: dict[int, int], capacity: int, groups: int, smallest: float) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, from the number of pieces of each length alone: runs
    (length, first rank, number, first sequence, offset). The pieces of a length
    with ranks [first rank, + number) are at that offset of as many sequences in
    a row. At most `capacity` lengths go in, however many pieces there are.

    Large lengths (from `smallest` of the capacity on) are grouped and rounded
    up, the few sizes are packed by configurations, actual lengths then take the
    places of the rounded ones, largest first. What configurations leave over (at
    most a sequence for each group) and the small lengths enter the tightest room
    by their actual lengths, largest first."""
    counts = Counter({k: v for k, v in counts.items() if v})
    least = max(1, int(capacity * smallest))
    runs: list[tuple[int, int, int, int, int]] = []
    rank = Counter()
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, number)
    sequence = counts.pop(capacity, 0)
    if sequence:
        runs.append((capacity, 0, sequence, 0, 0))
    grouped = group_lengths(counts, least, groups)
    sizes, demand = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    stock = [[list(x) for x in g] for g in grouped]  # of each group, what is left: [length, number], largest first
    for pattern, times in configurations(sizes, demand, capacity, rest=False):
        slots = [i for i, k in sorted(pattern.items()) for _ in range(k)]
        while times:
            # as many sequences as can have the same lengths in every slot, or one with what is next
            step = max(1, min(times, *[stock[i][0][1] // k for i, k in pattern.items()]))
            offset = 0
            for i in slots:
                if not stock[i][0][1]:
                    stock[i].pop(0)
                length = stock[i][0][0]
                stock[i][0][1] -= step
                runs.append((length, rank[length], step, sequence, offset))
                rank[length] += step
                offset += length
            for i in pattern:
                if not stock[i][0][1]:
                    stock[i].pop(0)
            if offset < capacity:
                rooms.setdefault(capacity - offset, []).append((sequence, step))
            sequence += step
            times -= step
    order = sorted(rooms)
    over = Counter({x: n for x, n in counts.items() if x < least})
    for length, n in (x for group in stock for x in group if x[1]):
        over[length] += n
    for length in sorted(over, reverse=True):
        n = over[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                need = -(-n // (capacity // length))
                rooms.setdefault(capacity, []).append((sequence, need))
                insort(order, capacity)
                sequence += need
                continue
            room = order[at]
            first, number = rooms[room].pop()
            take = min(n, number)
            if number > take:
                rooms[room].append((first + take, number - take))
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            runs.append((length, rank[length], take, first, capacity - room))
            rank[length] += take
            n -= take
            if room > length:
                if room - length not in rooms:
                    insort(order, room - length)
                rooms.setdefault(room - length, []).append((first, take))
    return runs


def _some(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, as lists of at most so many characters or of one text."""
    first = size = 0
    for at, text in enumerate(texts):
        if at > first and size + len(text) > most:
            yield texts[first:at]
            first, size = at, 0
        size += len(text)
    if texts:
        yield texts[first:]


def pieces(docs: DataFrame, capacity: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """The pieces of each document's ids (with the end id): `doc_id`, `_row`,
    `piece`, `start`, `length`, `ids_crc32`. Documents longer than the capacity
    are cut into full pieces, the first of which may be shorter."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path or default_path("byte_bpe_50k.json"), CHUNKS)
        for pdf in batches:
            out: list[tuple] = []
            # some texts at a time, so that few ids are held at once, however long texts are
            coded = (ids for texts in _some(pdf["text"].tolist(), CHARS) for ids in encoder.encode_all(texts))
            for doc, row, ids in zip(pdf["doc_id"], pdf["_row"], coded):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                for i, at in enumerate([0, *range(first, n, capacity)] if n > first else [0]):
                    size = first if i == 0 else capacity
                    out.append((doc, row, i, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
            made = pd.DataFrame(out, columns=["doc_id", "_row", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInPandas(cut, "doc_id long, _row long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, groups: int = GROUPS) -> DataFrame:
    """Every piece of every row of `docs` with its `sequence_id` and `offset`;
    the pieces of a sequence follow each other without gaps and hold at most
    `capacity` ids. Null texts are empty and give a piece of the end id alone;
    repeated rows are documents of their own; an empty table gives no piece.
    Other columns of `docs`, whatever their names, have no part in it.

    Texts are encoded once, into a slim table of pieces. The plan is made from
    the number of pieces of each length (at most `capacity` numbers, the only
    thing that reaches the driver) and returns as runs, joined to the pieces by
    length and rank in it. Ranks are counted on in range partitions, so a length
    that many pieces have is in many tasks.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, path, id_col, text_col, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity, groups)
    placed = spark.createDataFrame(
        [tuple(map(int, r)) for r in runs] or [],
        "_length long, _first long, _number long, _sequence long, offset long",
    )
    ranked = numbered(cut, ["_row", "piece"], None, "_rank", "length")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_number"))
    # the runs are few: the plan has at most some hundreds for each of the lengths
    out = ranked.join(F.broadcast(placed), on)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")
