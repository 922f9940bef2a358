"""Words of many texts at once, as arrays: places and 64-bit hashes.

A batch's texts lie one after the other in one byte buffer.  A word's bytes make
four polynomials modulo primes, taken from running sums, so no Python code runs
per word; mixed together they give its hash, and mixed differently a second,
independent one.  (Modulo a power of two there are words, such as those of the
Thue-Morse sequence, that agree for every base.)  Buffers are worked through in
stretches of bounded size, cut between words, so memory stays a small multiple
of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 19
_STRETCH = 1 << 17
#: Primes below 2^31 and a base for each.
_CHANNELS = ((2147483647, 1103515245), (2147483629, 1664525017), (2147483587, 1013904223), (2147483579, 742938285))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte: whether it belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: ASCII letters to lower case, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words that space and \t to \r separate.
SPACED = byte_table(bytes([32, *range(9, 14)]))
#: Words of digits, ASCII letters and all beyond ASCII.
LETTERED = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    kept = _TABLES.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, _STRETCH * 2)
        kept = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        if size <= _STRETCH * 4:
            _TABLES[base] = kept
    return kept


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of the ranges ``[start, end)`` of an array."""
    power, inverse = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


_PRIME_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:  # each round doubles the powers that are known
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


def _prime_tables(channel: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _PRIME_TABLES.get(channel)
    if kept is None or len(kept[0]) < n:
        prime, base = _CHANNELS[channel]
        size = max(n, _STRETCH * 2)
        kept = _prime_powers(prime, base, size), _prime_powers(prime, pow(base, -1, prime), size)
        if size <= _STRETCH * 4:
            _PRIME_TABLES[channel] = kept
    return kept


def _polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, channel: int) -> np.ndarray:
    """Polynomials modulo the channel's prime of the ranges of an array of bytes."""
    prime = np.uint64(_CHANNELS[channel][0])
    power, inverse = _prime_tables(channel, len(values) + 1)
    terms = values * power[: len(values)]
    if len(values) > 1 << 24:  # sums of more such products need not fit 64 bits
        terms %= prime
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    return (sums[ends] - sums[starts]) % prime * inverse[starts] % prime


@dataclass
class Words:
    """Words of a slice: ``first[d]`` is the index of document d's first word.
    ``hash`` and ``check`` are two hashes of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    check: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last - 1``, joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[first:last], self.end[first:last]))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(bounds):
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Words of texts that lie one after the other, lower-cased in ASCII."""
    is_word = np.zeros(len(data) + 2, dtype=bool)
    is_word[1:-1] = table[data]
    change = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = change[0::2], change[1::2]
    inner = bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    split = inner[is_word[inner] & is_word[inner + 1]]
    if len(split):  # a word may not run on into the next text
        start = np.sort(np.concatenate([start, split]))
        end = np.sort(np.concatenate([end, split]))
    low = LOWER[data]
    channels = np.empty((4, len(start)), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _STRETCH, "right")))
        at = start[i]
        values = low[at : end[j - 1]].astype(np.uint64)
        values += np.uint64(1)
        for channel in range(4):
            channels[channel, i:j] = _polynomials(values, start[i:j] - at, end[i:j] - at, channel)
        i = j
    # a word's length and its four remainders: two numbers of 62 bits
    left = channels[0] << np.uint64(31) | channels[1]
    right = channels[2] << np.uint64(31) | channels[3]
    left = mixed(left + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    hashes = mixed(left * np.uint64(_MIX[0]) + mixed(right))
    checks = mixed(mixed(right * np.uint64(_MIX[1])) ^ left)
    return Words(low, start, end, np.searchsorted(start, bounds), hashes, checks)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, data, bounds)`` for runs of texts of ``SLICE_BYTES`` or one."""
    data, bounds = buffers(texts)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j
