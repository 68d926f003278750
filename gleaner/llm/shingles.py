"""Sets of word shingles as sorted 64-bit hashes, many documents at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_mixed = np.random.default_rng(20240817)
#: A random number for every byte (upper-case ASCII as lower case) and place in a word.
BYTES = _mixed.integers(0, 1 << 64, 256, np.uint64)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
PLACES = _mixed.integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)
BREAK = np.zeros(256, bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True
BITS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other in ``data``, and each text's first word."""
    inside = ~BREAK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[starts < len(data)]
    first[at] = inside[at]
    begin = np.flatnonzero(first)
    word = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), word
    own = data[inside]
    where = np.flatnonzero(inside)
    length = np.diff(np.append(np.searchsorted(where, begin), len(where)))
    place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    value = BYTES[own] * PLACES[place & 4095]
    if length.max() > 4096:  # places beyond the table: the table again, spread by the lap
        value = mixed(value + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64)), word


def text_arrays(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Portions of about ``most`` bytes: index of the first text, bytes, and each text's start (and the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingle hashes of every text; fewer than ``n`` words make one shingle."""
    for base, data, starts in text_arrays(column):
        words, first = word_hashes(data, starts)
        joined = words.copy()
        for k in range(1, n):
            joined[:-k] = mixed(joined[:-k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
        for i in range(len(starts) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                yield base + i, np.unique(joined[a : b - n + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mixed(short * np.uint64(0x9E3779B97F4A7C15) + words[k])
                yield base + i, short
            else:
                yield base + i, words[:0]


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed 64-bit numbers."""
    digest = hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one of ``BITS`` bits: two sets' bitmaps differ in no more bits than the sets in tokens."""
    flips = np.bincount((tokens >> np.uint64(24)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def sized_bitmap(tokens: np.ndarray) -> bytes:
    """A parity bitmap with about three bits a token, for pairs that the small one cannot tell apart."""
    bits = 1 << min(max(len(tokens).bit_length() + 1, 8), 17)
    flips = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """In how many bits two sized bitmaps differ, the longer one folded to the shorter: no more than the sets do in tokens."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
