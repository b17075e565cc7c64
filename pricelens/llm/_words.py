"""Words of Arrow string batches as NumPy arrays: spans, hashes of words and of runs of words.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+``. A word's hash mixes its bytes eight at a time, so equal ones come from
unequal words by chance only (words of up to eight bytes and one length never have them). The hash
of a run of words is a polynomial of their hashes in an odd base modulo 2**64, mixed at the end, and
follows from two prefix sums; runs are far shorter than the 1024 words from which such polynomials
have equal values by construction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of text that are worked on at once (a longer text is worked on alone).
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < size."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(n).bit_length()))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which run_hash() takes the hash of any run of values."""
    p, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, stop) of the values behind prefix()."""
    _, inverse = powers(base, len(sums))
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(U64) * U64(0x9E3779B97F4A7C15))


GRAM_BASE, OTHER_BASE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
#: Words of more bytes are hashed one by one, by BLAKE2.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # of eight bytes, the first n


@dataclass
class Words:
    """Words of texts first .. first + len(bounds) - 2 of a batch."""

    first: int
    raw: np.ndarray  # the bytes
    start: np.ndarray  # of each word
    stop: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; those of different seeds are unrelated."""
        raw = np.zeros(len(self.raw) + 8, np.uint8)
        raw[:-8] = _LOWER[self.raw] if lower else self.raw
        eight = np.ndarray(len(self.raw) + 1, "<u8", raw, strides=(1,))
        size = self.stop - self.start
        out = mix(size.astype(U64) + U64((seed * 0xA24BAED4963EE407 + 0x9E3779B97F4A7C15) & (1 << 64) - 1))
        for k in range(0, min(LONG_WORD, int(size.max(initial=0))), 8):
            some = slice(None) if k == 0 else np.flatnonzero(size > k)
            left = np.minimum(size[some] - k, 8)
            out[some] = mix(out[some] ^ (eight[self.start[some] + k] & _KEEP[left]))
        for i in np.flatnonzero(size > LONG_WORD):
            word = raw[self.start[i] : self.stop[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        return out

    def of_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(texts: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of a string array, some texts at a time; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + slice_bytes, side="right")) - 1)
        yield _spans(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def _spans(first: int, raw: np.ndarray, at: np.ndarray) -> Words:
    solid = ~_BLANK[raw]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(raw))]
    start[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    begin = np.flatnonzero(start)
    return Words(first, raw, begin, np.flatnonzero(stop) + 1, np.searchsorted(begin, at))
