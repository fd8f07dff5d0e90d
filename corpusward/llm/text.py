"""Array helpers for Arrow text batches, shared by the operators of this subpackage.

They work on the UTF-8 bytes of a whole Arrow column at once, cut into runs of rows
of a bounded number of bytes, so that a task never holds more than one run's arrays
(or one document's, where a single document is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once.
RUN_BYTES = 4 << 20

_SPACE = [0x20, *range(0x09, 0x0E)]
#: Bytes of words that white space parts.
VISIBLE = np.ones(256, bool)
VISIBLE[_SPACE] = False
#: ASCII capitals to small letters, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words of ASCII letters (already small), digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG_WORD = 1024
_U = np.uint64


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i has bytes[offsets[i]:offsets[i + 1]]; a null row has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each run of rows of a column."""
    data, offsets = column_bytes(column)
    for low, high in row_runs(offsets, most):
        at = offsets[low : high + 1]
        yield low, high, data[at[0] : at[-1]], at - at[0]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words as byte ranges; row i has the words first[i] to first[i + 1]."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range. Ranges of the same length up to 8 never collide."""
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    h = mixed((lanes[starts] & _LANE[np.minimum(size, 8)]) + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    done, left = 8, np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    while len(left):
        more = lanes[starts[left] + done] & _LANE[np.minimum(size[left] - done, 8)]
        h[left] = mixed(h[left] * _U(0xD6E8FEB86659FD93) + more)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


#: Odd radices of two hashes that know nothing of each other.
RADIX, OTHER_RADIX = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def window_hashes(words: np.ndarray, width: int, radix: np.uint64 = RADIX) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64 in an odd radix, of each `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= radix
        h += words[k : n + k]
    return mixed(h)


def window_rows(first: np.ndarray, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the windows that lie in one row, for the word ranges of find_words."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    if total < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.flatnonzero(row[: total - width + 1] == row[width - 1 :])
    return places, row[places]


def covered(total: int, starts: np.ndarray, width) -> np.ndarray:
    """Which of `total` words lie in a window that starts at `starts`; width: a number or one for each."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each row's values, for the ranges first[i] to first[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
