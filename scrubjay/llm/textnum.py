"""Words and their hashes from Arrow text columns, in whole-array steps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; a longer document is a chunk of its own.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
_PARTS = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(8)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one-to-one)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` at least; one array per base is kept."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(max(CHUNK, 1 << (n - 1).bit_length()) + 1, base, _U)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base]


def blocks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in its text ``column``, one row at least."""
    _, offsets = text_buffers(batch.column(column))
    for a, b in chunks(offsets, size):
        yield batch.slice(a, b - a)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts, without copying the bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents with at most ``size`` bytes, one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def byte_classes(ranges: list[tuple[int, int]], lower: bool = True) -> np.ndarray:
    """A table from byte to its value in a word (0: not part of a word); ASCII letters lowered."""
    out = np.zeros(256, _U)
    for a, b in ranges:
        out[a:b + 1] = np.arange(a, b + 1) + 1
    if lower:
        out[65:91] = np.where(out[65:91] > 0, np.arange(97, 123) + 1, 0)
    return out


#: Words between white space (bytes 0x20 and 0x09 to 0x0D).
PLAIN = byte_classes([(0, 8), (14, 31), (33, 255)])
#: Words of letters, digits and all non-ASCII characters.
ALNUM = byte_classes([(48, 57), (65, 90), (97, 122), (128, 255)])


def segments(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the values from ``start`` to ``end``; values are greater than 0.

    A polynomial modulo 2 ** 64: quick for any values, but unlike segments can
    be made that share one, so callers compare what they look up by it."""
    n = len(value)
    total = np.zeros(n + 1, _U)
    np.cumsum(value * _powers(_BASE, n + 1)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _powers(_INVERSE, n + 1)[start])


#: Bytes beyond which a word's hash is a BLAKE2 digest.
LONG_WORD = 64
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)  # masks of the first k bytes


def _word_hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of lowered bytes; ``low`` has eight bytes to spare.

    Words up to 8 bytes of one length never share a hash. Longer ones go
    through a mixing step for every 8 bytes, those beyond ``LONG_WORD`` through
    BLAKE2, so that other pairs do with a chance of about 2 ** -64 each."""
    h = mix(size.astype(_U) * _PARTS[7])
    eight = np.lib.stride_tricks.as_strided(low, (len(low) - 7, 8), (1, 1))
    at = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(at):
        lane = np.ascontiguousarray(eight[start[at] + k]).view("<u8").ravel() & _BYTES[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] ^ lane)
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = low[start[i]:start[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, a: int, b: int, classes: np.ndarray,
          stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(64-bit hash of every word of documents a to b, in order; number of words of each document).

    For each length in ``stems`` follows the hash of every word's first so many
    bytes (of the whole word where it is not longer).
    """
    lo, hi = int(offsets[a]), int(offsets[b])
    n, docs = hi - lo, b - a
    if not n:
        none = np.empty(0, _U)
        return none, np.zeros(docs, np.int64), *(none for _ in stems)
    value = classes[data[lo:hi]]
    start, end = _bounds(value, offsets, a, b)
    count = np.diff(np.searchsorted(start, offsets[a:b + 1] - lo))
    low = np.zeros(n + 8, np.uint8)
    low[:n] = (value - _U(1)).astype(np.uint8)
    size = end - start
    return _word_hashes(low, start, size), count, *(_word_hashes(low, start, np.minimum(size, k)) for k in stems)


def places(data: np.ndarray, offsets: np.ndarray, a: int, b: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) in ``data`` of every word of documents a to b."""
    lo, hi = int(offsets[a]), int(offsets[b])
    start, end = _bounds(classes[data[lo:hi]], offsets, a, b) if hi > lo else (np.empty(0, np.int64),) * 2
    return start + lo, end + lo


def _bounds(value: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    lo, n = int(offsets[a]), len(value)
    inside = np.empty(n + 1, bool)
    np.not_equal(value, 0, out=inside[:n])
    inside[n] = False
    edge = np.zeros(n + 1, bool)  # a document's first byte begins a word whatever stands before
    edge[offsets[a:b] - lo] = True
    edge[n] = True
    begins = inside[:n].copy()
    begins[1:] &= ~inside[:n - 1] | edge[1:n]
    ends = inside[:n] & (~inside[1:] | edge[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def sequences(word: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``n`` words within a document, number of runs of each).

    A document of fewer words, but some, has one run: all its words.
    """
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.cumsum(count) - count
    start = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    size = np.repeat(np.minimum(count, n), runs)
    padded = np.concatenate([word, np.zeros(n, _U)])
    h = size.astype(_U)
    for k in range(n):
        h += np.where(k < size, padded[start + k], _U(0)) * _PARTS[k]
    return mix(h), runs


def pairs(word: np.ndarray, count: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every pair of words ``gap`` apart within a document, document of each pair)."""
    doc = np.repeat(np.arange(len(count)), count)
    if len(word) <= gap:
        return np.empty(0, _U), np.empty(0, np.int64)
    same = doc[:-gap] == doc[gap:]
    h = word[:-gap] * _PARTS[gap] + word[gap:] * _PARTS[gap + 3]
    return mix(h[same]), doc[:-gap][same]


@dataclass
class Lookup:
    """Open-addressing table from keys to their places."""

    keys: np.ndarray
    slots: np.ndarray = field(init=False)
    probes: int = field(init=False, default=1)

    def __post_init__(self):
        bits = max(8, int(4 * len(self.keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(self.keys), np.arange(len(self.keys))
        while len(left):
            free = self.slots[slot[left]] < 0
            _, first = np.unique(slot[left], return_index=True)
            place = np.zeros(len(left), bool)
            place[first] = True
            place &= free
            self.slots[slot[left[place]]] = left[place]
            left = left[~place]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        out = self.slots[slot]
        wrong = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        for _ in range(self.probes):
            if not len(wrong):
                break
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(self.keys[out[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        out[wrong] = -1
        return out
