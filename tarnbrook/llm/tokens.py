"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit numbers.

A byte-level BPE works on each pre-token alone, so the ids of a text are those of its pre-tokens one after the
other. The library encodes each distinct pre-token once; its ids are remembered under a 64-bit hash of its bytes, in
arrays of bounded size that start anew when full, and put together for a whole batch by numpy. The pre-token borders
follow from the classes of neighbouring bytes for texts of ASCII and two-byte Latin letters; any other text, and one
that holds the content of an added token (`<|endoftext|>`), is encoded whole by the library."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import chunks, hash_prefix, span_hash, string_buffers

END_ID = 0
#: Pre-tokens remembered by a worker.
MEMORY = 1_500_000
_U = np.uint64
_SLOT_BITS = 23
SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)


def _classes() -> np.ndarray:
    """The class of each byte: those of ASCII characters, and LETTER for the bytes of U+00C0 to U+024F."""
    kind = np.full(256, FOREIGN, dtype=np.uint8)
    for i in (9, 10, 13, *range(32, 127)):
        c = chr(i)
        kind[i] = SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    kind[0x80:0xC0] = LETTER
    kind[0xC3:0xCA] = LETTER
    return kind


_KIND = _classes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text whether its borders can be told from byte classes."""
    odd = _KIND[raw] == FOREIGN
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    odd[lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]] = True  # the signs for times and divided by
    found = np.searchsorted(np.flatnonzero(odd), offsets)
    return found[1:] == found[:-1]


def holding(contents: list[bytes], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text whether one of the contents begins in it."""
    out, body = np.zeros(len(offsets) - 1, dtype=bool), raw.tobytes()
    for content in filter(None, contents):
        at = body.find(content)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            out[text] = True
            at = body.find(content, max(at + 1, int(offsets[text + 1]) - len(content) + 1))
    return out


def pre_token_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of plain texts: runs of letters, digits or other characters, each with one
    space before it; runs of white space without that space; and the English contractions, where an apostrophe
    begins a pre-token."""
    kind = _KIND[raw]
    begin = np.zeros(len(raw) + 1, dtype=bool)
    begin[offsets] = True
    start = begin[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    is_space = kind == SPACE
    # The last white space of a run that a text goes on after: a space joins what follows, another one is alone.
    last = np.flatnonzero(is_space[:-1] & ~is_space[1:] & ~begin[1:-1])
    start[last] = True
    joins = last[raw[last] == 32]
    start[joins + 1] = False
    mark = np.flatnonzero((raw == 39) & start)
    if len(mark):
        text_end = offsets[np.searchsorted(offsets, mark, side="right")]
        after = [np.where(mark + k < text_end, raw[np.minimum(mark + k, len(raw) - 1)], 0) for k in (1, 2)]
        one = np.isin(after[0], list(b"sdmt"))
        two = ((after[0] == 108) & (after[1] == 108)) | ((after[1] == 101) & ((after[0] == 118) | (after[0] == 114)))
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = mark[hit]
            start[at + 1] = False
            go_on = at + size
            go_on = go_on[go_on < text_end[hit]]
            letters = go_on[kind[go_on] == LETTER]
            start[letters] = True
    return np.flatnonzero(start)


class Memory:
    """Ids by the hash of a pre-token: two slots for each hash, then a sorted rest."""

    def __init__(self):
        self.slots = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.keys = np.zeros(1 << 16, dtype=_U)
        self.first = np.zeros((1 << 16) + 1, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype="<u4")
        self.n = 0
        self.rest = np.zeros(0, dtype=_U)
        self.rest_at = np.zeros(0, dtype=np.int32)

    @staticmethod
    def _place(h: np.ndarray, k: int) -> np.ndarray:
        return ((h * _U(0x9E3779B97F4A7C15) if k else h) >> _U(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if it isn't remembered."""
        out = np.full(len(h), -1, dtype=np.int32)
        left = np.arange(len(h))
        for k in range(2):
            own = h[left]
            at = self.slots[self._place(own, k)]
            hit = (self.keys[at] == own) & (at >= 0)
            out[left[hit]] = at[hit]
            left = left[~hit]
            if not len(left):
                return out
        if len(self.rest):
            own = h[left]
            at = np.minimum(np.searchsorted(self.rest, own), len(self.rest) - 1)
            hit = self.rest[at] == own
            out[left[hit]] = self.rest_at[at[hit]]
        return out

    def add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers distinct new hashes with the number of ids of each and all these ids."""
        n, total = self.n + len(h), int(self.first[self.n]) + len(ids)
        while n > len(self.keys):
            self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)))
            self.first = np.concatenate((self.first, np.zeros(len(self.keys) + 1 - len(self.first), np.int64)))
        while total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        number = np.arange(self.n, n, dtype=np.int32)
        self.keys[self.n : n] = h
        self.ids[total - len(ids) : total] = ids
        self.first[self.n + 1 : n + 1] = self.first[self.n] + np.cumsum(sizes)
        self.n = n
        for k in range(2):
            place = self._place(h, k)
            free = self.slots[place] < 0
            self.slots[place[free]] = number[free]
            left = self.slots[place] != number
            h, number = h[left], number[left]
            if not len(h):
                return
        rest, at = np.concatenate((self.rest, h)), np.concatenate((self.rest_at, number))
        order = np.argsort(rest)
        self.rest, self.rest_at = rest[order], at[order]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in a row, number of ids of each)."""
        first = self.first[numbers]
        sizes = self.first[numbers + 1] - first
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory()

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each text) of plain texts."""
        starts = pre_token_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw)).astype(np.int64)
        h = span_hash(hash_prefix(raw, fold=False), starts, ends)
        numbers = self.memory.find(h)
        missed = np.flatnonzero(numbers < 0)
        if len(missed):
            new, at = np.unique(h[missed], return_index=True)
            if self.memory.n + len(new) > MEMORY:
                self.memory = Memory()
                missed = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            body = raw.tobytes()
            at = missed[at]
            found = self.library([body[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.memory.add(new, sizes, np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())))
            numbers[missed] = self.memory.find(h[missed])
        ids, sizes = self.memory.gather(numbers)
        of_text = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, offsets)]
        return ids, np.diff(of_text)

    def encode(self, column: pa.Array | list, end_id: int | None = END_ID):
        """For runs of texts (null: an empty text) in order: (ids in a row, number of ids of each text), with the end
        id after each text."""
        if isinstance(column, list):
            column = pa.array(column, pa.string())
        raw, offsets = string_buffers(column)
        for lo, hi in chunks(offsets):
            part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            plain = plain_texts(part, at) & ~holding(self.added, part, at)
            if plain.all():
                ids, sizes = self._plain(part, at)
            else:
                pieces = []
                for i, fine in enumerate(plain.tolist()):
                    one = part[at[i] : at[i + 1]]
                    pieces.append(self._plain(one, np.array([0, len(one)]))[0] if fine else np.array(self.library([one.tobytes().decode()])[0], dtype="<u4"))
                ids, sizes = np.concatenate(pieces), np.array([len(x) for x in pieces])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                sizes = sizes + 1
            yield ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_each(path: str, column) -> list[np.ndarray]:
    """The ids of each text as an array."""
    out: list[np.ndarray] = []
    for ids, sizes in encoder(path).encode(column):
        ends = np.cumsum(sizes)
        out += [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    return out
