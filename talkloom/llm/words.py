"""Word and window hashes of many texts at once, as numpy arrays inside tasks.

Words are runs of bytes of a given class in the UTF-8 text. A word's hash is a pair of polynomials over random values per
byte, modulo a prime and at two bases, mixed with its length; a window's hash is the same over its words' hashes. They come
from running sums, so their cost does not depend on the window's length. Two given sequences of n values have one hash with
a probability of (n / 2^31)^2 at most, whatever they hold.

A text is hashed as a whole, with some 40 bytes of arrays per byte; no table grows with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Texts are hashed together up to this many bytes; a longer text is hashed by itself.
CHUNK_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}

# Prime of the hashes, their bases, and how many powers of a base and of its inverse are kept (as powers of two).
PRIME = (1 << 31) - 1
BASES = (1_583_458_089, 784_558_817)
INVERSES = tuple(pow(base, -1, PRIME) for base in BASES)
TABLE_BITS, SMALL_BITS = 20, 16


def _class(excluded: Iterable[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


# Runs without blank, tab, line feed, vertical tab, form feed, carriage return.
SPACED = _class([0x20, *range(0x09, 0x0E)])
# Runs of ASCII letters, digits and all that is not ASCII.
ALPHANUMERIC = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

# Two numbers of 31 bits per byte are taken from each.
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_LOWER_CLASS = np.arange(256, dtype=np.uint8)
_LOWER_CLASS[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection on 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(base: int, n: int) -> np.ndarray:
    """Powers modulo 2^64, for cells of features; sequences whose equality matters are hashed by `Sums`."""
    if n > 2 * CHUNK_BYTES:
        return np.cumprod(np.concatenate(([1], np.full(n - 1, base, np.uint64))), dtype=np.uint64)
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo PRIME: below 2^32 for x below 2^62."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _rest(x: np.ndarray) -> np.ndarray:
    """Remainders modulo PRIME."""
    x = _fold(_fold(x))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


@lru_cache(maxsize=8)
def _table(base: int, bits: int) -> np.ndarray:
    powers = np.ones(1, np.uint64)
    while len(powers) < 1 << bits:
        powers = np.concatenate((powers, _rest(powers * np.uint64(pow(base, len(powers), PRIME)))))
    return powers.astype(np.uint32)


def _at(base: int, exponents: np.ndarray) -> np.ndarray:
    """Powers of the base modulo PRIME."""
    table = _table(base, SMALL_BITS)
    if not len(exponents) or (top := int(exponents.max()) >> SMALL_BITS) == 0:
        return table[exponents].astype(np.uint64)
    large = np.array([pow(base, i << SMALL_BITS, PRIME) for i in range(top + 1)], np.uint64)
    return _rest(large[exponents >> SMALL_BITS] * table[exponents & ((1 << SMALL_BITS) - 1)])


class Sums:
    """Running sums over a sequence of 64-bit values, for the hashes of its parts."""

    def __init__(self, values: np.ndarray):
        self.sums = [self._of_base(values, base, shift) for base, shift in zip(BASES, (0, 33), strict=True)]

    @staticmethod
    def _of_base(values: np.ndarray, base: int, shift: int) -> np.ndarray:
        sums, table = np.zeros(len(values) + 1, np.uint64), _table(base, TABLE_BITS)
        for at in range(0, len(values), len(table)):
            terms = values[at : at + len(table)] >> np.uint64(shift)
            terms &= np.uint64(PRIME)
            terms *= table[: len(terms)]
            if at:
                terms = _rest(terms) * np.uint64(pow(base, at, PRIME))
            high = terms >> np.uint64(31)
            terms &= np.uint64(PRIME)
            terms += high
            np.cumsum(terms, out=sums[at + 1 : at + 1 + len(terms)])
            sums[at + 1 : at + 1 + len(terms)] += sums[at]
        return sums

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two remainders, a column for each part from start to end."""
        return np.stack([_rest(_rest(s[end] - s[start]) * _at(i, start)) for s, i in zip(self.sums, INVERSES, strict=True)])


def followed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Remainders of the sequences `a`, of n values each, followed by `b`."""
    return np.stack([_rest(x + y * _at(base, n)) for x, y, base in zip(a, b, BASES, strict=True)])


def hashed(remainders: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Hashes of sequences of n values."""
    size = mix(np.asarray(n).astype(np.uint64).reshape(-1))
    return mix(((remainders[0] << np.uint64(31)) | remainders[1]) ^ size)


@dataclass
class Words:
    """Words of several texts, one after the other; text t has the words bounds[t] to bounds[t + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # bytes in `joined`
    ends: np.ndarray
    joined: bytes

    def of(self, t: int) -> slice:
        return slice(self.bounds[t], self.bounds[t + 1])


def words(texts: list[bytes | None], word_bytes: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts, None being a text without words. `lower`: A-Z count as a-z."""
    joined = b"\n".join(t or b"" for t in texts)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(joined, np.uint8)
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = word_bytes[_LOWER_CLASS[data] if lower else data]
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    hashes = hashed(Sums((_LOWER_VALUES if lower else _VALUES)[data]).of(starts, ends), ends - starts)
    return Words(hashes, np.searchsorted(starts, first), starts, ends, joined)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` words, by its first word; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return hashed(Sums(hashes).of(starts, starts + size), size)


def chunks(rows: Iterable[tuple], text: int = -1, limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Groups of rows whose texts have `limit` bytes together, or a single longer one."""
    held, size = [], 0
    for row in rows:
        n = len(row[text] or b"")
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
