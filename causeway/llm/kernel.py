"""Vectorised word splitting and hashing over Arrow string columns.

A whole Arrow batch is handled at once on its UTF-8 bytes: word bounds come from a byte-class table, and each word gets a
64-bit polynomial hash out of one running sum, so no Python object is made per word. Two different words share a hash with
a chance of about 2**-61. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is one piece.
PIECE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, and 3 modulo 8
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each value for each salt."""
    return mix(h ^ mix(np.array([salt + 1], np.uint64) * np.uint64(0xA24BAED4963EE407))[0])


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    values[65:91] = values[97:123]  # A-Z hash as a-z
    return values


BYTE_VALUES = _byte_values()
#: Word bytes: all but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: digits, letters and everything from 0x80 on.
WORD_LIKE = np.zeros(256, bool)
WORD_LIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n + 1:
        size = max(n + 1, PIECE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[k] = np.multiply.accumulate(steps)
    return _tables[0], _tables[1]


@dataclass
class Texts:
    """Consecutive texts as one byte array; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of some texts in order; those of text i are ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    running: np.ndarray

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        which = np.flatnonzero(self.ends - self.starts > size)
        start = self.starts[which]
        return which, salted((self.running[start + size] - self.running[start]) * _powers(0)[1][start], size)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string or binary column, nulls as empty texts, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(body, at - at[0])


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of whole rows, each of at most ``most`` text bytes or one row."""
    whole = texts_of(batch.column(column))
    start = 0
    while start < len(whole):
        stop = max(start + 1, int(np.searchsorted(whole.offsets, whole.offsets[start] + most, "right")) - 1)
        at = whole.offsets[start : stop + 1]
        yield batch.slice(start, stop - start), Texts(whole.data[at[0] : at[-1]], at - at[0])
        start = stop


def words_of(texts: Texts, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes within each text, with a hash that ignores the case of A-Z."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])  # a text ends within a run of word bytes
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), total)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, and the text each belongs to; a text of fewer words, but not none, is one run."""
    h, counts = words.hashes, words.counts
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = words.owner
    runs = max(0, n - size + 1)
    rolled = np.zeros(runs, np.uint64)
    for k in range(size):
        rolled = rolled * _BASE + h[k : k + runs]
    keep = own[:runs] == own[size - 1 : size - 1 + runs] if runs else np.zeros(0, bool)
    rolled, at = mix(rolled[keep]), own[:runs][keep]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        single = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = counts[few] > k
            single[has] = single[has] * _BASE + h[words.bounds[few[has]] + k]
        rolled = np.concatenate([rolled, salted(single, size)])
        at = np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        rolled, at = rolled[order], at[order]
    return rolled, at


def distinct_by(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), ordered; ``owner`` must be ascending."""
    if len(values) == 0:
        return owner, values
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


