"""An adaptive context-mixing range coder for token ids, many blocks abreast.

Each block starts from an empty model and is coded by itself; the blocks of a
group advance together, so that a step is a few array operations over all of
them. An id is guessed to be the one that last followed the two ids before it
(order 2), or else the one before it (order 1), and has a share by how often it
came of late (order 0). What guesses of that kind have been worth in the block so
far mixes them into one division of the coder's range: the id is new, the guess
is right, and, over the rest, the order-0 shares. New ids follow in a prefix code,
which a group makes from how often each of its ids is new in a block.

The model learns segment by segment. So all that the encoder needs of it is
worked out for a segment at once, and a decoder's step only looks up.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

MAGIC = b"IDRC"
VERSION = 3
HEAD = struct.Struct("<4sHIQII")  # magic, version, documents, ids, ids a block, bytes of the document table
SHARE_BITS = 16
SHARES = 1 << SHARE_BITS  # into which a range is divided
STATE, LEAST = (1 << 48) - 1, 1 << 32  # 48 bits; a range below LEAST takes in one unit of 16 bits
SEGMENT = 64  # steps between which the model learns, at most
WINDOW = 1024  # the latest ids whose frequencies are the order-0 shares
ORDER1, ORDER2 = 1024, 2048  # contexts of a block
NONE = 0xFFFF  # no guess yet, which is a guess at that id
ROWS = 12  # mixing contexts of a block: which guesses there are, whether they are alike, whether the last one was right
TOGETHER = 64  # blocks whose segments are prepared at once, so that they stay in the cache
#: What a mixing context has seen at the start of a block: a new id, the guess, another id.
_PRIOR = np.array([2, 2, 12], np.int64)


def block_size(n: int) -> int:
    """Ids a block: a group has about four thousand blocks, of 1024 to 8192 ids."""
    return max(1, n) if n < 1024 else min(8192, max(1024, n >> 12))


def _segments(block: int) -> list[tuple[int, int]]:
    """The steps of each segment: 16, and as many as there were, up to SEGMENT."""
    ends = [0]
    while ends[-1] < block:
        ends.append(min(block, ends[-1] + min(SEGMENT, max(16, ends[-1]))))
    return list(zip(ends[:-1], ends[1:]))


FLAT = np.full(1 << 16, 16, np.uint8)  # code lengths where nothing is known of the ids


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """How many bits (16 at most, 0 for none) each id has in the prefix code with the
    fewest bits for these counts; where a code would be longer it is cut, and others
    get longer in turn, rare ones first."""
    there = np.flatnonzero(counts)
    out = np.zeros(1 << 16, np.uint8)
    if len(there) < 2:
        out[there] = 1
        return out
    n = len(there)
    heap = list(zip(counts[there].tolist(), range(n)))
    heapq.heapify(heap)
    up = [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heap[0]
        up[a[1]] = up[b[1]] = node
        heapq.heapreplace(heap, (a[0] + b[0], node))
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    bits = np.minimum(depth[:n], 16)
    over = int((1 << 16 - bits).sum()) - (1 << 16)
    for i in np.argsort(counts[there], kind="stable").tolist():
        while over > 0 and bits[i] < 16:
            bits[i] += 1
            over -= 1 << (16 - int(bits[i]))
    out[there] = bits
    return out


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in the order of their codes (by length, then id), and each one's code
    at the upper end of 16 bits."""
    order = np.argsort(lengths, kind="stable")[int((lengths == 0).sum()) :]
    steps = 1 << 16 - lengths[order].astype(np.int64)
    return order, np.cumsum(steps) - steps


class _Model:
    """The state of all blocks of a group; steps are rows, blocks are columns."""

    def __init__(self, lanes: int) -> None:
        self.lanes, lane = lanes, np.arange(lanes)
        self.base1, self.base2, self.base_mix = lane * ORDER1, lane * ORDER2, lane * ROWS
        self.guess1, self.guess2 = np.full(lanes * ORDER1, NONE, np.uint16), np.full(lanes * ORDER2, NONE, np.uint16)
        self.counts = np.tile(_PRIOR, lanes * ROWS)
        self.width = 0

    def begin(self, grid: np.ndarray, t: int) -> bool:
        """Takes the order-0 shares of the ids before step t, if they are due, which
        is returned, and each mixing context's division of a range: up to `fresh`
        the id is new, up to `right` the guess is, and each place of the order-0
        window has a `unit` of the rest."""
        n = min(WINDOW, 1 << (t.bit_length() - 1))
        due = n != self.width or t % WINDOW == 0
        if due:
            self.width = n
            symbols = np.sort(np.ascontiguousarray(grid[t - n : t].T), axis=1, kind="stable").reshape(-1)
            first = np.empty(len(symbols), bool)
            np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
            first[::n] = True
            self.runs = np.flatnonzero(first)
            self.lengths = np.diff(self.runs, append=len(symbols))
            self.symbols = symbols
            self.base0 = np.arange(self.lanes) * n
        new, guess, rest = (self.counts[i::3] for i in range(3))
        most = SHARES // n
        self.unit = np.clip(most * rest // (new + guess + rest), 1, most - 1)
        self.right = SHARES - self.unit * n
        self.fresh = 1 + (self.right - 2) * new // (new + guess)
        return due

    def contexts(self, grid: np.ndarray, t: int, end: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the guesses of the rows t to end of the blocks a to b are."""
        before = grid[t - 2 : end - 1, a:b].astype(np.int64)
        at2 = before[:-1] * 0x3D7
        at2 += before[1:]
        at2 &= ORDER2 - 1
        at2 += self.base2[a:b]
        at1 = before[1:] & ORDER1 - 1
        at1 += self.base1[a:b]
        return at1, at2

    def learn(self, a: int, b: int, at1: np.ndarray, at2: np.ndarray, mixed: np.ndarray, ids: np.ndarray) -> None:
        """From a segment's ids of the blocks a to b in the order of their steps, and
        `mixed`, the mixing contexts (from the block a on) times 3 plus which part of
        the range was right."""
        self.guess1[at1] = ids  # the last of several stays
        self.guess2[at2] = ids
        n = ROWS * 3
        self.counts[a * n : b * n] += np.bincount(mixed.reshape(-1), minlength=(b - a) * n)


def _order0(model: _Model, ids: np.ndarray, out: np.ndarray) -> None:
    """Sets the run of the order-0 window that each id (rows are steps, columns
    blocks) is in, -1 if it is in none."""
    width = model.width
    first_run = np.append(np.searchsorted(model.runs, model.base0), len(model.runs))
    place = np.full(min(TOGETHER, model.lanes) << 16, -1, np.int32)
    for a in range(0, model.lanes, TOGETHER):
        b = min(model.lanes, a + TOGETHER)
        begin, end = first_run[a], first_run[b]
        runs = model.runs[begin:end]
        where = ((runs // width - a) << 16) + model.symbols[runs]
        place[where] = np.arange(begin, end, dtype=np.int32)
        out[: len(ids), a:b] = place.take(ids[:, a:b] + (np.arange(b - a) << 16))
        place[where] = -1


def _prepare(model: _Model, grid: np.ndarray, hit: np.ndarray, t: int, end: int, runs: np.ndarray, start: np.ndarray, share: np.ndarray, fresh: np.ndarray) -> None:
    """Fills where each id's part of the range begins and how large it is, and
    which ids are new, for the rows t to end of the grid; then learns. `hit` tells
    whether the guess before was right, and is set for the last one here."""
    n = end - t
    for a in range(0, model.lanes, TOGETHER):
        b = min(model.lanes, a + TOGETHER)
        ids = np.ascontiguousarray(grid[t:end, a:b])
        at1, at2 = model.contexts(grid, t, end, a, b)
        g1, g2 = model.guess1.take(at1), model.guess2.take(at2)
        none = g2 == NONE
        kind = (g1 == g2).view(np.uint8) * np.uint8(3)
        kind -= none.view(np.uint8)
        kind += (g1 != NONE).view(np.uint8)
        g2[none] = g1[none]
        right = ids == g2
        kind[0] += hit[a:b].view(np.uint8) * np.uint8(6)
        kind[1:] += right[:-1].view(np.uint8) * np.uint8(6)
        hit[a:b] = right[-1]
        row = (model.base_mix[a:b] + 1) + kind
        run = runs[:n, a:b].astype(np.int64)
        other = np.flatnonzero(np.logical_or(run < 0, right))
        unit, begun = model.unit.take(row), model.right.take(row)
        s = model.runs.take(run)
        s -= model.base0[a:b]
        s *= unit
        s += begun
        unit *= model.lengths.take(run)
        x, o = model.fresh.take(row.reshape(-1)[other]), right.reshape(-1)[other]
        s.reshape(-1)[other] = np.where(o, x, 0)
        unit.reshape(-1)[other] = np.where(o, begun.reshape(-1)[other] - x, x)
        row -= a * ROWS
        row *= 3
        row += 2
        row.reshape(-1)[other] -= 2 - o
        new = np.zeros(ids.shape, bool)
        new.reshape(-1)[other] = ~o
        start[:n, a:b], share[:n, a:b], fresh[t:end, a:b] = s, unit, new
        model.learn(a, b, at1, at2, row, ids)


class _Writer:
    """The ranges of all blocks, and the units of 16 bits that are settled."""

    def __init__(self, lanes: int, block: int) -> None:
        self.low, self.span = np.zeros(lanes, np.int64), np.full(lanes, STATE)
        self.wide = block + 8  # a step settles at most one unit
        self.out = np.zeros(lanes * self.wide, np.int32)
        self.begin = np.arange(lanes) * self.wide
        self.at = self.begin.copy()
        self.r, self.s = np.empty(lanes, np.int64), np.empty(lanes, np.int64)

    def code(self, start: np.ndarray, share: np.ndarray) -> None:
        low, span, r, s = self.low, self.span, self.r, self.s
        np.right_shift(span, SHARE_BITS, out=r)
        np.multiply(r, start, out=s)
        low += s
        np.multiply(r, share, out=span)
        self.settle(np.flatnonzero(low > STATE), np.flatnonzero(span < LEAST))

    def settle(self, over: np.ndarray, small: np.ndarray) -> None:
        low, span, at = self.low, self.span, self.at
        if len(over):  # into the unit before; carried on when all is written
            low[over] -= STATE + 1
            self.out[at.take(over) - 1] += 1
        if len(small):
            value, to = low.take(small), at.take(small)
            self.out[to] = value >> 32
            at[small] = to + 1
            low[small] = (value & LEAST - 1) << 16
            span[small] = span.take(small) << 16

    def blocks(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.out[self.at] = self.low >> shift & 0xFFFF
            self.at += 1
        while len(more := np.flatnonzero(self.out > 0xFFFF)):
            self.out[more] -= 1 << 16
            np.add.at(self.out, more - 1, 1)
        units = self.out.astype("<u2")
        return [units[a:b].tobytes() for a, b in zip(self.begin.tolist(), self.at.tolist())]


def encode_blocks(ids: np.ndarray, block: int, lengths: np.ndarray | None = FLAT) -> list[bytes]:
    """The blocks of `encode_group`, with the code of these lengths."""
    return encode_group(ids, block, lengths)[0]


def encode_group(ids: np.ndarray, block: int, lengths: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
    """Each block of `ids` (below 65,536), the last filled up with zeros: the
    number of coded units (16 bits), these units, and the new ids in a prefix code,
    whose lengths are returned too; by default it is made for them."""
    if not len(ids):
        return [], FLAT
    if ids.max() > 0xFFFF or block > 16384:
        raise ValueError("ids must be below 65,536 and blocks of at most 16,384")
    lanes = -(-len(ids) // block)
    whole = np.zeros(lanes * block, np.uint16)
    whole[: len(ids)] = ids
    grid = np.zeros((block + 2, lanes), np.uint16)  # two rows before the first step
    grid[2:] = whole.reshape(lanes, block).T
    model, writer = _Model(lanes), _Writer(lanes, block)
    hit, fresh = np.zeros(lanes, bool), np.ones(grid.shape, bool)
    start, share = np.empty((SEGMENT, lanes), np.int64), np.empty((SEGMENT, lanes), np.int64)
    segments, runs, since = _segments(block)[1:], np.empty((WINDOW, lanes), np.int32), 0
    for t, end in segments:
        if model.begin(grid[2:], t):
            since, last = t, min(block, t + WINDOW if t >= WINDOW else 2 * t)  # until the next window
            _order0(model, grid[t + 2 : last + 2], runs)
        _prepare(model, grid, hit, t + 2, end + 2, runs[t - since :], start, share, fresh)
        for i in range(end - t):
            writer.code(start[i], share[i])
    fresh = np.ascontiguousarray(fresh[2:].T)
    raw, n = whole[fresh.reshape(-1)], fresh.sum(axis=1)
    if lengths is None:
        lengths = code_lengths(np.bincount(raw, minlength=1 << 16))
    coded = writer.blocks()
    return [struct.pack("<H", len(c) // 2) + c + r for c, r in zip(coded, _packed(raw, n, lengths))], lengths


def _packed(raw: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The codes of new ids, `n` of them for each block, in whole units of 16 bits."""
    order, codes = _codes(lengths)
    code = np.zeros(1 << 16, np.int64)
    code[order] = codes
    bits = lengths[raw].astype(np.int64)
    ends, last = np.cumsum(bits), np.cumsum(n)
    total = np.where(last > 0, ends[np.maximum(last - 1, 0)], 0)
    total = np.diff(total, prepend=0)
    units = -(-total // 16)
    begin = np.cumsum(units) - units
    place = ends - bits + np.repeat(16 * begin - (np.cumsum(total) - total), n)
    at, spread = place >> 4, code[raw] << (16 - (place & 15))
    size = int(units.sum()) + 1  # bits of different codes do not meet, so their sums are exact
    out = np.bincount(at, spread >> 16, size) + np.bincount(at + 1, spread & 0xFFFF, size + 1)[:size]
    out = out.astype("<u2")
    return [out[a : a + k].tobytes() for a, k in zip(begin.tolist(), units.tolist())]


class _Reader:
    """The ranges of all blocks, and where in them the coded value is."""

    def __init__(self, blocks: list[bytes], lengths: np.ndarray) -> None:
        units = np.frombuffer(b"".join(blocks) + b"\0" * 8, "<u2")
        sizes = np.array([len(b) // 2 for b in blocks])
        begin = np.cumsum(sizes) - sizes + 1
        self.raw = (begin + units[begin - 1]) * 16  # the bit at which the next new id is
        order, _ = _codes(lengths)
        times = 1 << 16 - lengths[order].astype(np.int64)
        self.symbol, self.length = (np.append(np.repeat(x, times), np.zeros((1 << 16) - times.sum(), np.int64)) for x in (order, lengths[order].astype(np.int64)))
        self.value = units[begin].astype(np.int64) << 32 | units[begin + 1].astype(np.int64) << 16 | units[begin + 2]
        self.span, self.at, self.units = np.full(len(blocks), STATE), begin + 3, units

    def settle(self, small: np.ndarray) -> None:
        at, value, span = self.at, self.value, self.span
        of = at.take(small)
        more = value.take(small)
        more <<= 16
        more |= self.units.take(of, mode="clip")
        value[small] = more
        of += 1
        at[small] = of
        more = span.take(small)
        more <<= 16
        span[small] = more

    def ids(self, lanes: np.ndarray) -> np.ndarray:
        """The next new id of each lane."""
        bit = self.raw.take(lanes)
        at = bit >> 4
        two = self.units.take(at, mode="clip").astype(np.int64) << 16
        two |= self.units.take(at + 1, mode="clip")
        two >>= 16 - (bit & 15)
        two &= 0xFFFF
        self.raw[lanes] = bit + self.length.take(two)
        return self.symbol.take(two)


def decode_blocks(blocks: list[bytes], n_ids: int, block: int, code: np.ndarray = FLAT) -> np.ndarray:
    """The ids of `encode_group`, with the lengths of its code."""
    lanes = len(blocks)
    if not lanes:
        return np.empty(0, np.uint16)
    grid = np.zeros((block + 2, lanes), np.uint16)
    model, reader = _Model(lanes), _Reader(blocks, code)
    value, span = reader.value, reader.span
    long = lambda *shape: np.empty(shape, np.int64)
    row, r, v, begun, unit, start, share, x1, x2, one = (long(lanes) for _ in range(10))
    parts = np.empty((SEGMENT, lanes), np.uint8)
    g1, g2, first, length = (np.empty(lanes, np.uint16) for _ in range(4))
    flag, none, hit = (np.zeros(lanes, bool) for _ in range(3))
    byte, was, kind, gone = flag.view(np.uint8), hit.view(np.uint8), np.empty(lanes, np.uint8), none.view(np.uint8)
    three, six = np.uint8(3), np.uint8(6)
    for i in range(min(16, block)):
        grid[i + 2] = reader.ids(np.arange(lanes))
    for t, end in _segments(block)[1:]:
        if model.begin(grid[2:], t):
            places, n = np.arange(len(model.runs)), model.lengths
            firsts, lengths = np.repeat((model.runs % model.width).astype(np.uint16), n), np.repeat(n.astype(np.uint16), n)
        two = grid[t].astype(np.int64)
        one[:] = grid[t + 1]
        for i in range(end - t):
            now = grid[t + 2 + i]
            np.bitwise_and(one, ORDER1 - 1, out=x1)
            x1 += model.base1
            np.multiply(two, 0x3D7, out=x2)
            x2 += one
            x2 &= ORDER2 - 1
            x2 += model.base2
            model.guess1.take(x1, out=g1, mode="clip")
            model.guess2.take(x2, out=g2, mode="clip")
            np.equal(g1, g2, out=flag)
            np.multiply(byte, three, out=kind)
            np.not_equal(g1, NONE, out=flag)
            kind += byte
            np.equal(g2, NONE, out=none)
            kind -= gone
            was *= six
            kind += was
            kind += 1
            np.copyto(g2, g1, where=none)
            np.add(model.base_mix, kind, out=row)
            kind *= three
            part = np.add(kind, 2, out=parts[i])
            model.right.take(row, out=begun, mode="clip")
            model.unit.take(row, out=unit, mode="clip")
            np.right_shift(span, SHARE_BITS, out=r)
            np.floor_divide(value, r, out=v)
            other = np.flatnonzero(np.less(v, begun, out=flag))
            low = v.take(other)
            v -= begun
            v //= unit
            v += model.base0
            model.symbols.take(v, out=now, mode="clip")
            firsts.take(v, out=first, mode="clip")
            lengths.take(v, out=length, mode="clip")
            np.multiply(unit, first, out=start)
            start += begun
            np.multiply(unit, length, out=share)
            x = model.fresh.take(row.take(other))
            o = low >= x
            new = other[~o]
            start[other] = np.where(o, x, 0)
            share[other] = np.where(o, begun.take(other) - x, x)
            now[other] = g2.take(other)
            part[other] = kind.take(other) + o
            now[new] = reader.ids(new)
            start *= r
            value -= start
            np.multiply(r, share, out=span)
            reader.settle(np.flatnonzero(np.less(span, LEAST, out=flag)))
            np.equal(now, g2, out=hit)
            two, one = one, two
            one[:] = now
        n = end - t
        for a in range(0, lanes, TOGETHER):
            b = min(lanes, a + TOGETHER)
            mixed = parts[:n, a:b] + np.arange(b - a) * (ROWS * 3)
            model.learn(a, b, *model.contexts(grid, t + 2, end + 2, a, b), mixed, grid[t + 2 : end + 2, a:b])
    return np.ascontiguousarray(grid[2:].T).reshape(-1)[:n_ids]


def pack_group(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A self-contained group: header, table of documents and of code lengths, table of blocks
    (coded bytes, CRC32 of the ids as little-endian 32 bits), coded blocks."""
    block = block_size(len(ids))
    coded, code = encode_group(ids, block)
    table = zlib.compress(np.diff(doc_ids.astype("<i8"), prepend=0).astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + code.tobytes(), 1)
    sums = [zlib.crc32(ids[at : at + block].astype("<u4").tobytes()) for at in range(0, len(ids), block)]
    blocks = b"".join(struct.pack("<II", len(c), s) for c, s in zip(coded, sums))
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), block, len(table))
    return head + struct.pack("<I", zlib.crc32(head + table + blocks)) + table + blocks + b"".join(coded)


def unpack_group(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a group; ValueError if it is damaged."""
    try:
        magic, version, n_docs, n_ids, block, table_size = HEAD.unpack_from(data)
        (crc,) = struct.unpack_from("<I", data, HEAD.size)
    except struct.error as e:
        raise ValueError("damaged group: too short") from e
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a group of this format")
    at = HEAD.size + 4
    n_blocks = -(-n_ids // block)
    tables = data[at : at + table_size + 8 * n_blocks]
    if zlib.crc32(data[: HEAD.size] + tables) != crc:
        raise ValueError("damaged group: header or tables")
    table = zlib.decompress(tables[:table_size])
    doc_ids = np.cumsum(np.frombuffer(table, "<i8", n_docs))
    lengths, code = np.frombuffer(table, "<u4", n_docs, 8 * n_docs), np.frombuffer(table, np.uint8, 1 << 16, 12 * n_docs)
    sizes = np.frombuffer(tables, "<u4", 2 * n_blocks, table_size).reshape(-1, 2)
    ends = at + len(tables) + np.cumsum(sizes[:, 0], dtype=np.int64)
    ids = decode_blocks([data[e - s : e] for e, s in zip(ends.tolist(), sizes[:, 0].tolist())], n_ids, block, code)
    for i in range(n_blocks):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != sizes[i, 1]:
            raise ValueError(f"damaged group: block {i}")
    return doc_ids, lengths, ids
