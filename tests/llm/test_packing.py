import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starmodel.llm import packing
from starmodel.llm.packing import configurations, pack, plan
from starmodel.llm.tokens import ByteEncoder, default_path

from .helpers import TEXTS, rows, table


def check_plan(counts, runs, capacity):
    used, ranks, sequences = Counter(), defaultdict(list), defaultdict(list)
    for length, first, n, sequence, offset in runs:
        used[length] += n
        ranks[length].append((first, n))
        for i in range(n):
            sequences[sequence + i].append((offset, length))
    assert used == Counter({k: v for k, v in counts.items() if v})
    for v in ranks.values():
        at = 0
        for first, n in sorted(v):
            assert first == at
            at += n
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(sequences) == set(range(len(sequences)))
    return len(sequences)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=40), st.integers(1, 12))
def test_plan_is_whole(counts, groups):
    n = check_plan(counts, plan(counts, 64, groups), 64)
    assert n >= -(-sum(k * v for k, v in counts.items()) // 64)


@pytest.mark.parametrize("lengths", ["log", "even", "middle"])
def test_plan_is_as_good_as_best_fit_decreasing(lengths):
    """With the settings that the query uses."""
    rng = np.random.default_rng(0)
    of = {"log": np.minimum(1024, rng.lognormal(5.5, 1, 20_000).astype(int) + 1), "even": rng.integers(1, 1025, 20_000), "middle": rng.integers(300, 700, 20_000)}
    counts = Counter(of[lengths].tolist())
    rooms, bins = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r in rooms if r >= length and rooms[r]), default=None)
            if room is None:
                room, bins = 1024, bins + 1
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    assert check_plan(counts, plan(counts, 1024), 1024) <= bins


def test_pieces(spark):
    for capacity in (16, 1024):
        got = defaultdict(list)
        sequences = defaultdict(list)
        for r in pack(table(spark), capacity, groups=8).collect():
            got[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        for v in sequences.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= capacity
        tokenizer = ByteEncoder(default_path("byte_bpe_50k.json")).tokenizer
        for g in rows():
            if g[0] is None or g[0] == 0:
                continue  # ids that more than one row has
            ids = np.array([*tokenizer.encode(g[1] or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for i, r in enumerate(sorted(got[g[0]], key=lambda r: r.piece)):
                assert r.piece == i and r.start == at and (i == 0 or r.length == capacity)
                assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        assert len(got[0]) == 2 * len({r.piece for r in got[0]})


def test_empty_table(spark):
    assert pack(table(spark, [])).count() == 0


def test_encoder_is_the_library():
    encoder = ByteEncoder(default_path("byte_bpe_50k.json"), most=50)
    texts = [t or "" for t in TEXTS] + ["a. b, c'd", " a", "a ", "a\nb c\n d", "x  y", "1,2 3. é,"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_all(texts) == want and encoder.encode_all(texts[::-1]) == want[::-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé ,.'s1\n\t　\x1c漢-<|>") | st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_encoder_on_odd_texts(texts):
    encoder = _shared_encoder()
    assert encoder.encode_all(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


_kept = []


def _shared_encoder():
    if not _kept:
        _kept.append(ByteEncoder(default_path("byte_bpe_50k.json")))
    return _kept[0]


def test_few_groups_are_near_the_bound():
    """Sixty-four groups of real and of even lengths: within 2 % of the tokens' own bound, in about a second."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1025, 200_000), np.minimum(1024, rng.lognormal(5.5, 1, 200_000).astype(int) + 1)):
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        start = time.time()
        runs = plan(counts, 1024)
        assert time.time() - start < 5
        assert sum(n for _, _, n, _, _ in runs) == len(lengths)
        assert max(first + n for _, _, n, first, _ in runs) <= 1.02 * lengths.sum() / 1024


def test_configurations_are_the_fewest():
    """Three sizes, of which only the right mixture fills sequences."""
    got = configurations([60, 40, 25], [100, 200, 100], 100)
    assert sum(t for _, t in got) == 175
    for i, want in enumerate([100, 200, 100]):
        assert sum(p.get(i, 0) * t for p, t in got) == want


def test_few_characters_are_encoded_at_once():
    texts = ["a" * 1_500_000, "", "b" * 400_000, "c" * 200_000, "d" * 5_000_000, "e"]
    assert list(packing._some(texts, packing.CHARS)) == [texts[:3], texts[3:4], texts[4:5], texts[5:]]
    assert list(packing._some([], packing.CHARS)) == []
