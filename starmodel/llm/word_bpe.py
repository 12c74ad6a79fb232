"""BPE encoding and decoding with a word-end vocabulary, whole texts in Spark."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.llm.tokens import LATIN, byte_letters, default_path

#: Rows that go back to Spark at once.
ROWS = 256
#: Fixed value: what the split pattern calls white space.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class WordBPE:
    """A tokenizers file of the kind: NFC, white space to spaces, lower case;
    split by pattern with the rest removed; byte letters; BPE with an end-of-word
    suffix; no decoder. Chunks between white space are remembered."""

    def __init__(self, path: str, most: int = 200_000) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in added.items()}
        self.added = {s: i.to_bytes(4, "little") for s, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        self.letters = byte_letters()
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.most = most
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def spelled(self, chunk: str) -> list[str]:
        """The pieces of a chunk in byte letters. Beyond Latin the file's own
        split decides what a letter is, as Unicode versions differ."""
        if LATIN(chunk):
            return ["".join([self.letters[b] for b in p.encode()]) for p in self.pieces(chunk)]
        return [p for p, _ in self.split(chunk)]

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece in byte letters: ranks wait in a queue over a doubly linked list
        of symbols; an entry whose pair has changed since is stale and skipped."""
        symbols = list(piece)
        symbols[-1] += self.suffix
        ids = [i for i in map(self.vocab.get, symbols) if i is not None]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = [(m[0], at, m[1]) for at in range(n - 1) if (m := merges.get((ids[at], ids[at + 1])))]
        heapify(queue)
        while queue:
            rank, at, made = heappop(queue)
            after = right[at]
            if ids[at] < 0 or after >= n:
                continue
            now = merges.get((ids[at], ids[after]))
            if now is None or now[0] != rank:
                continue
            ids[at], ids[after] = made, -1
            right[at] = right[after]
            if right[at] < n:
                left[right[at]] = at
                if m := merges.get((made, ids[right[at]])):
                    heappush(queue, (m[0], at, m[1]))
            if left[at] >= 0 and (m := merges.get((ids[left[at]], made))):
                heappush(queue, (m[0], left[at], m[1]))
        return tuple(i for i in ids if i >= 0)

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= 2 * self.most:
                self.known.clear()
            found = self.known[piece] = self.merge(piece)
        return found

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids; a file without a decoder sets a
        space between them, as the library does."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        found = self.old.get(chunk)
        if found is None:
            ids = [i for piece in self.spelled(chunk) for i in self._piece(piece)]
            found = (b"".join([i.to_bytes(4, "little") for i in ids]), self.decode(ids))
        if len(self.chunks) >= self.most:
            self.old, self.chunks = self.chunks, {}
        self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids (little-endian 32 bits) of a whole text, and their decoding."""
        ids, strings = [], []
        for part in self.cut.split(text) if self.cut and "<" in text else (text,):
            if part in self.added:
                ids.append(self.added[part])
                strings.append(part)
                continue
            plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
            plain = plain.lower()
            odd = "\x1c" in plain or "\x1d" in plain or "\x1e" in plain or "\x1f" in plain
            for chunk in _SPACE.split(plain) if odd else plain.split():
                if chunk:
                    found = self.chunks.get(chunk) or self._chunk(chunk)
                    if found[0]:
                        ids.append(found[0])
                        strings.append(found[1])
        return b"".join(ids), " ".join(strings)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """One encoder a Python worker, kept between its tasks."""
    return WordBPE(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of `docs` as `doc_id`, `ids` (array of int), `decoded`: the ids
    of its whole text and the text that they decode to. Null texts are empty and
    have no ids; long texts are one row like others, sent back in small batches;
    nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path or default_path("word_bpe_49k.json"))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                both = [bpe.encode(t) for t in part.column(1).to_pylist()]
                sizes = np.array([0] + [len(i) // 4 for i, _ in both])
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join([i for i, _ in both]), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([t for _, t in both], pa.string())], ["doc_id", "ids", "decoded"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
