"""Token ids of whole texts, with ids of recurring chunks remembered."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places in a text where a byte-level BPE vocabulary always starts a new piece:
#: before a single space, and around a single line feed, between non-spaces.
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: White space but for the space and the line feed.
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Fixed value: the split pattern of byte-level BPE files.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of texts whose white space isn't single; such texts are encoded otherwise.
BARE = {"": b"", "\n": b""}
#: Characters of texts whose chunks are looked up, and encoded where they are new, together.
TOGETHER = 8_000_000


#: Whether all of a text is below U+0250.
LATIN = re.compile("[\\x00-\\u024f]*").fullmatch


def _odd(text: str) -> bool:
    """Whether there is other white space than spaces and line feeds, or a
    special token may be."""
    return "<|" in text or any(c in text for c in _OTHER_SPACES)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the
    others counted on from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class ByteEncoder:
    """What tokenizers gives for a text with add_special_tokens=False, without
    truncation and padding, for a byte-level BPE file with its default split.

    A text is cut into chunks at places where pieces always end: each word with
    the space or line feed before it. New chunks of many texts are encoded in one
    call of the file's model, which gets their pieces (in byte letters, as the
    file's split would make them) one after the other, and at most about `most`
    are remembered. A word with a mark after it is the word and the mark."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        if hasattr(self.model.model, "_resize_cache"):  # new chunks are hardly ever there
            self.model.model._resize_cache(0)
        self.pieces = regex.compile(PIECES).findall
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.letters = {b: ord(c) for b, c in enumerate(letters)}
        #: What each byte is spelled as, a zero byte as the space between pieces.
        self.spelling = np.array([32, *map(ord, letters[1:])], "<u2")
        self.space, self.line = letters[32], letters[10]
        strings = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(strings.values()) + 1, bool)  # ids that only the first piece of a chunk has
        for string, i in strings.items():
            self.begins[i] = string.startswith((self.space, self.line))
        self.most = most
        self.known: dict[str, bytes] = dict(BARE)
        self.odd: dict[str, bytes] = {}
        self.feed = len(self._plain("\n"))
        self.marks = {m: self._plain(m) for m in ",."}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _spell(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def _split(self, key: str) -> str:
        """The pieces of a chunk in byte letters, a space between them. Beyond
        Latin the file's own split decides what a letter is, as Unicode versions differ."""
        if not LATIN(key):
            return " ".join([p for p, _ in self.split(key if key[0] == "\n" else " " + key)])
        if key[0] == "\n":
            return f"{self.line} {' '.join([self._spell(p) for p in self.pieces(key[1:])])}"
        return " ".join([self._spell(p) for p in self.pieces(" " + key)])

    def _learn(self, keys: list[str]) -> None:
        """Encodes chunks: a word alone (it follows a space), or a line feed and a word."""
        known, marks = self.known, self.marks
        marked = [k for k in keys if k[-1] in marks and k[:-1].lstrip("\n").isalpha()]
        if marked:
            rest = set(keys).difference(marked)
            rest.update(w for k in marked if (w := k[:-1]) not in known)
            keys = list(rest)
        plain = [k for k in keys if k.lstrip("\n").isalpha()]
        if plain and not LATIN("".join(plain)):
            plain = [k for k in plain if LATIN(k)]
        if len(plain) < len(keys):
            self._encode_new([(k, self._split(k)) for k in set(keys).difference(plain)])
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            letters = np.frombuffer("\x00".join([k.replace("\n", "\n\x00") if k[0] == "\n" else " " + k for k in part]).encode(), np.uint8)
            self._remember(part, self.spelling[letters].tobytes().decode("utf-16-le"))
        known.update([(k, known[k[:-1]] + marks[k[-1]]) for k in marked])

    def _encode_new(self, pairs: list[tuple[str, str]]) -> None:
        for at in range(0, len(pairs), 20_000):
            part = pairs[at : at + 20_000]
            self._remember([k for k, _ in part], " ".join([p for _, p in part]))

    def _remember(self, keys: list[str], pieces: str) -> None:
        """Encodes the pieces of chunks that follow each other."""
        ids = np.array(self.model.encode_batch_fast([pieces], add_special_tokens=False)[0].ids, "<u4")
        starts = 4 * np.flatnonzero(self.begins[ids])
        if len(starts) != len(keys):
            raise ValueError("a chunk isn't one run of pieces")
        whole = ids.tobytes()
        self.known.update(zip(keys, [whole[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(whole)])]))

    def _chunks(self, text: str) -> bytes:
        """A text with runs of white space or other spaces."""
        out = []
        for chunk in _SAFE.split(text):
            found = self.odd.get(chunk)
            if found is None:
                if len(self.odd) >= self.most // 4:
                    self.odd.clear()
                found = self.odd[chunk] = self._plain(chunk)
            out.append(found)
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if _odd(text):
                out[i] = self._chunks(text)
                continue
            some.append(i)
            size += len(text)
            if size >= TOGETHER:
                self._encode_some(texts, some, out)
                some, size = [], 0
        if some:
            self._encode_some(texts, some, out)
        return out

    def _encode_some(self, texts: list[str], some: list[int], out: list[bytes]) -> None:
        """Each chunk that these texts have is looked up once; its ids are then
        copied to wherever it is. Where white space isn't single and between other
        characters there are chunks of none or of a line feed alone, and the text
        is encoded for itself."""
        lists = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in some], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for bare in BARE:
            if bare in keys:
                place = coded.dictionary.index(bare).as_py()
                hit = np.flatnonzero(coded.indices.to_numpy() == place)
                for i in np.unique(np.searchsorted(lists.offsets.to_numpy(), hit, side="right") - 1).tolist():
                    out[some[i]] = self._chunks(texts[some[i]])
        found = list(map(self.known.get, keys))
        new = [k for k, v in zip(keys, found) if v is None]
        if new:
            if len(self.known) + len(new) > self.most:
                self.known = BARE | {k: v for k, v in zip(keys, found) if v is not None}
            self._learn(new)
            known = self.known
            found = [known[k] if v is None else v for k, v in zip(keys, found)]
        ids = pa.array(found, pa.binary()).take(coded.indices)
        data, offsets = memoryview(ids.buffers()[2]), np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
        begins = offsets[lists.offsets.to_numpy()].tolist()
        for i, begin, end in zip(some, begins, begins[1:]):
            if not out[i]:
                out[i] = bytes(data[begin + self.feed : end])  # without the line feed that was set before it

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def byte_encoder(path: str, most: int = 600_000) -> ByteEncoder:
    """One encoder a Python worker, kept between its tasks."""
    return ByteEncoder(path, most)


def default_path(name: str) -> str:
    """Where a public vocabulary file is, on each machine its own."""
    import public_tokenizers

    return public_tokenizers.path(name)
