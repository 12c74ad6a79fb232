import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starmodel.llm import token_file
from starmodel.llm.range_coder import code_lengths, decode_blocks, encode_blocks, pack_group, unpack_group
from starmodel.llm.tokens import byte_encoder, default_path
from starmodel.llm.word_bpe import WordBPE, encode_decode

from .helpers import TEXTS, rows, table


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535)), max_size=300), st.integers(1, 70))
def test_blocks_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    coded = encode_blocks(ids, block)
    assert len(coded) == -(-len(ids) // block)
    assert (decode_blocks(coded, len(ids), block) == ids).all()


def test_blocks_are_independent():
    ids = np.random.default_rng(0).integers(0, 50257, 5000).astype(np.uint32)
    whole = encode_blocks(ids, 1000)
    assert whole[3] == encode_blocks(ids[3000:4000], 1000)[0]


def test_repeats_are_cheap():
    ids = np.tile(np.arange(50, dtype=np.uint32) * 997, 200)
    assert len(pack_group(np.array([1]), np.array([len(ids)]), ids)) < len(ids) / 2


def test_smaller_than_zlib_and_than_order_0():
    """The ids of real documents: fewer bits than static order-0 entropy, with all tables, and than deflate."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:3000]
    encoder = byte_encoder(default_path("byte_bpe_50k.json"))
    ids = np.frombuffer(b"".join(x + b"\2\0\0\0" for x in encoder.encode_all([t or "" for t in texts])), "<u4")
    data = pack_group(np.array([0]), np.array([len(ids)]), ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(ids) > 2_000_000
    assert 8 * len(data) < -(share * np.log2(share)).sum() * len(ids)
    assert len(data) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))
    assert (unpack_group(data)[2] == ids).all()


def test_code_lengths():
    rng = np.random.default_rng(0)
    for counts in (np.zeros(1 << 16, int), np.ones(1 << 16, int), np.eye(1, 1 << 16, 7, dtype=int)[0], np.bincount([1, 2, 2], minlength=1 << 16), 2 ** np.minimum(np.arange(1 << 16), 40), np.bincount(rng.zipf(1.2, 100_000) % (1 << 16), minlength=1 << 16)):
        lengths = code_lengths(counts)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= 16
        assert sum(2.0 ** -lengths[lengths > 0].astype(float)) <= 1


def test_damage_is_found():
    data = bytearray(pack_group(np.array([5, 9]), np.array([700, 300]), np.arange(1000, dtype=np.uint32)))
    docs, lengths, ids = unpack_group(bytes(data))
    assert docs.tolist() == [5, 9] and lengths.tolist() == [700, 300] and (ids == np.arange(1000)).all()
    for at in (0, 6, 40, len(data) // 2, len(data) - 12):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            unpack_group(bytes(bad))
    with pytest.raises(ValueError):
        unpack_group(bytes(data[:10]))


def test_ids_above_16_bits():
    with pytest.raises(ValueError):
        encode_blocks(np.array([70_000], np.uint32), 10)


def test_files(spark, tmp_path):
    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/ids"
    token_file.write_ids(table(spark), path, group=3000)
    got = token_file.read_ids(spark, path).collect()
    order = sorted(rows(), key=lambda g: (g[0] is not None, g[0] or 0, g[1] or ""))
    at, want = 0, []
    for g in order:
        ids = np.array([*tokenizer.encode(g[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((g[0], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda x: x[1]) == want


def test_empty_files(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_file.write_ids(table(spark, []), path)
    assert token_file.read_ids(spark, path).count() == 0


def _library():
    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def test_word_bpe_is_the_library(spark):
    t = _library()
    got = {r.doc_id: r for r in encode_decode(table(spark)).collect()}
    for g in rows():
        if g[0] is not None:
            ids = t.encode(g[1] or "", add_special_tokens=False).ids
            assert list(got[g[0]].ids) == ids and got[g[0]].decoded == t.decode(ids, skip_special_tokens=False)
    assert encode_decode(table(spark, [])).count() == 0


_kept = []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBÉé ,.'sLl1\n\t　\x1c漢-ΣİǅßſÅ<|>") | st.characters(codec="utf-8"), max_size=40))
def test_word_bpe_on_odd_texts(text):
    if not _kept:
        _kept.extend([_library(), WordBPE(default_path("word_bpe_49k.json"))])
    ids, decoded = _kept[1].encode(text)
    want = _kept[0].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<i4").tolist() == want and decoded == _kept[0].decode(want, skip_special_tokens=False)


def test_small_memory_gives_the_same():
    bpe, t = WordBPE(default_path("word_bpe_49k.json"), most=3), _library()
    for text in TEXTS:
        assert np.frombuffer(bpe.encode(text or "")[0], "<i4").tolist() == t.encode(text or "", add_special_tokens=False).ids
