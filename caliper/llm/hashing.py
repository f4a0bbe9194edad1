"""64-bit hashes of words and word runs, taken from the UTF-8 bytes of many texts at once.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; A-Z count as a-z.  A word's hash is a polynomial of its bytes modulo
2^64, mixed with its length; a run's hash is made of its words' hashes and their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_B, _P = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_POWERS = [np.ones(1, np.uint64)]
_PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a permutation of them)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, _B, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS[0]


def texts_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts (null: empty)."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and n + 1 offsets of the texts in them.
    Long input is taken in pieces that end where a word ends."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    hashes, places = [], []
    at = 0
    while at < len(data):
        stop = min(at + _PIECE, len(data))
        while stop < len(data) and not (first[stop] or _SPACE[data[stop]]):
            more = _SPACE[data[stop : stop + _PIECE]] | first[stop : min(stop + _PIECE, len(data))]
            stop += int(more.argmax()) if more.any() else len(more)
        piece = data[at:stop]
        inside = np.flatnonzero(~_SPACE[piece])
        if len(inside):
            begins = np.ones(len(inside), bool)
            begins[1:] = np.diff(inside) != 1
            begins |= first[at:stop][inside]
            starts = np.flatnonzero(begins)
            lengths = np.diff(starts, append=len(inside))
            place = np.arange(len(inside)) - np.repeat(starts, lengths)
            value = _LOWER[piece[inside]] * _powers(int(lengths.max()))[place]
            hashes.append(mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * _P))
            places.append(inside[starts] + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of fewer words, the whole sequence as one run."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * _P + words[j : j + n]
    return mix(total)
