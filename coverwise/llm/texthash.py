"""Vectorised word and shingle hashes of whole texts (numpy, inside tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, A-Z lower-cased. A word's hash
is a polynomial of its bytes modulo 2**64, mixed with its length; differences of one
running sum give the hashes of all words at once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = np.uint64(base)
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def forget_powers(longest: int = 1 << 20) -> None:
    """Drop kept powers beyond this length; they are made anew where a long text asks for them."""
    for base in [b for b, have in _powers.items() if len(have) > longest]:
        del _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets); null is empty."""
    texts = texts.cast(pa.binary()).fill_null(b"").cast(pa.large_binary())
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts in it)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins or ends before this byte
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its word shingles. A text of fewer than ``width``
    words (and at least one) has one shingle of them all."""
    w, at = word_hashes(*text_bytes(texts))
    factors = [np.uint64(f | 1) for f in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
                                          0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8CB92BA72F3D8DD7, 0xA3B195354A39B70D)[:width]]
    count = max(len(w) - width + 1, 0)
    h = np.zeros(count, np.uint64)
    for k, f in enumerate(factors):
        h += w[k:k + count] * f
    h = mix(h)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(h[a:b - width + 1]))
        elif b > a:
            few = w[a:b] * np.array(factors[:b - a], np.uint64)
            out.append(mix(few.sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
