"""Whole-batch word hashing in numpy: one pass over the bytes of many texts, no Python work per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))
    if fold:
        values[65:91] = values[97:123]
    return values


_FOLDED, _PLAIN = _byte_values(True), _byte_values(False)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * _CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and for each text the index of its first word (n+1 values).

    `offsets` start at 0 and end at len(raw); a run never goes over the border of a text."""
    w = is_word[raw]
    first, last = w.copy(), w.copy()
    if len(raw):
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        full = offsets[1:] > offsets[:-1]
        at = offsets[:-1][full]
        first[at] |= w[at]
        at = offsets[1:][full] - 1
        last[at] |= w[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_prefix(raw: np.ndarray, fold: bool = True) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span; with `fold` A-Z counts as a-z."""
    up, _ = _powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((_FOLDED if fold else _PLAIN)[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))
