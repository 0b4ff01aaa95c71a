"""Words of whole batches of texts as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import text_bytes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ASCII letters and digits in lower case and bytes of longer characters stand for themselves, all else for a space.
_PLAIN = np.array([ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)] + list(range(128, 256)), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        grown = []
        for base in (_BASE, _INVERSE):
            p = np.ones(size, np.uint64)
            p[1:] = base
            grown.append(np.cumprod(p, dtype=np.uint64))
        _powers = grown[0], grown[1]
    return _powers


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case (ASCII and the letters of Latin-1) with spaces for punctuation, and the rows' offsets."""
    flat, at = text_bytes(column)
    out = _PLAIN[flat]
    if len(flat) > 1:
        second = np.flatnonzero(flat[:-1] == 0xC3) + 1
        capital = second[(flat[second] >= 0x80) & (flat[second] <= 0x9E) & (flat[second] != 0x97)]
        out[capital] += 32
    return out, at


@dataclass
class Words:
    """``hash`` of each word, ``start`` and ``end`` in the bytes, and ``first``: the index of each row's first word (n + 1)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the words' first ``n`` bytes (of whole words where shorter)."""
        return _hashes(self.prefix, self.start, np.minimum(self.end, self.start + n))


def _hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


_LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])


def spaced(column: pa.Array) -> Words:
    """Words as bytes between ASCII white space, ASCII letters in lower case."""
    flat, at = text_bytes(column)
    prefix = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_LETTER[_LOWER[flat]] * powers(len(flat) + 1)[0][: len(flat)], out=prefix[1:])
    return _split(prefix, ~_SPACE[flat], at)


def words(column: pa.Array) -> Words:
    flat, at = lowered(column)
    prefix = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_LETTER[flat] * powers(len(flat) + 1)[0][: len(flat)], out=prefix[1:])
    return _split(prefix, flat != 32, at)


def _split(prefix: np.ndarray, letter: np.ndarray, at: np.ndarray) -> Words:
    """Words are runs of letters; a row's end ends its last word."""
    inside = np.zeros(len(letter) + 2, bool)
    inside[1:-1] = letter
    edge = inside[1:] & ~inside[:-1]
    over = inside[:-1] & ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(letter))]
    edge[cut] |= inside[cut + 1]
    over[cut] |= inside[cut]
    start, end = np.flatnonzero(edge), np.flatnonzero(over)
    return Words(_hashes(prefix, start, end), start, end, np.searchsorted(start, at), prefix)
