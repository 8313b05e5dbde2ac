"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of a batch of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A word's hash is a polynomial in its bytes, mixed
with its length; a shingle's hash mixes those of its words.  A text of fewer words than a shingle is one shingle, the
whole sequence; a text without words has none.  Bytes are hashed in slices that end between words, so that what is
held besides the texts is bounded by ``SLICE`` or the longest word, and nothing is kept between calls.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20  # bytes
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEAR = 1 << 12  # the powers of the base that are kept: those within so many bytes of a word's start


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS = _powers(_BASE, _NEAR)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _polynomials(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the words of one slice: the sum of (byte + 1) * base ** (place in the word)."""
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    byte = raw[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
    byte *= _POWERS[place & (_NEAR - 1)]
    if size.max() > _NEAR:
        far = _powers(pow(_BASE, _NEAR, 1 << 64), int(size.max()) // _NEAR + 1)
        byte *= far[place // _NEAR]
    return np.add.reduceat(byte, first)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = np.empty(len(joined) + 1, dtype=bool)
    space[0], space[1:] = True, _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cuts = [0]
    while cuts[-1] < len(start):  # words of at most a slice together, one word at least
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + SLICE, side="right"))))
    raw = np.concatenate([_polynomials(joined, start[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return mix(raw ^ mix((end - start).astype(np.uint64))), np.searchsorted(limits, start, side="right")


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, of = word_hashes([t.encode().lower() for t in texts])
    count = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(count) - count
    whole = np.zeros(0, np.uint64)
    if len(words) >= size:
        whole = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            whole += words[j : len(words) - size + 1 + j] * _ODD[j]
        whole = mix(whole)
    out = []
    for b, n in zip(begin.tolist(), count.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(whole[b : b + n - size + 1]))
        elif n:
            out.append(mix((words[b : b + n] * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + _ODD[63 - n : 64 - n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
