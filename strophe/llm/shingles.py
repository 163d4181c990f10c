"""Shingle sets of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_011)
#: Random stand-ins of the bytes, and odd multipliers.
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = _RNG.integers(0, 1 << 62, 1, np.uint64)[0] * np.uint64(4) + np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads every bit (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2**64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]), dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in order, and the number of words of each text.

    Words are runs of characters other than space and 09 to 0D; A to Z are lower-cased. A word's
    hash depends on its bytes only.
    """
    raw = [(t or "").encode() for t in texts]
    joined = b" ".join(raw) + b" "
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    longest = int((ends - starts).max(initial=0))
    hashes = np.full(len(starts), np.uint64(0))
    if longest <= 64:
        power = _powers(longest + 1)
        at = starts.copy()
        live = np.arange(len(starts))
        for place in range(longest):
            hashes[live] += _BYTES[data[at]] * power[place]
            at += 1
            going = at < ends[live]
            at, live = at[going], live[going]
            if not len(live):
                break
    else:
        # few very long words: the loop above serves the others
        usual = ends - starts <= 64
        power = _powers(longest)
        at, live = starts[usual].copy(), np.flatnonzero(usual)
        for place in range(64):
            hashes[live] += _BYTES[data[at]] * power[place]
            at += 1
            going = at < ends[live]
            at, live = at[going], live[going]
            if not len(live):
                break
        for i in np.flatnonzero(~usual):
            word = data[starts[i] : ends[i]]
            hashes[i] = (_BYTES[word] * power[: len(word)]).sum(dtype=np.uint64)
    borders = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, borders)]))
    return mix(hashes + (ends - starts).astype(np.uint64)), counts


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and how many each text has.

    A text of fewer than ``width`` words, but one at least, has its whole sequence as its only
    shingle; a text without words has none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return words, counts
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - (np.arange(len(words)) - first)  # words from here on
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    shingles = np.zeros(len(words), np.uint64)
    short = np.repeat(counts < width, counts)
    for place in range(width):
        term = mix(padded[place : place + len(words)] * _PLACES[place])
        shingles += np.where(left > place, term, np.uint64(0))
    keep = np.where(short, left == np.repeat(counts, counts), left >= width)
    # the number of words tells a short sequence from a shingle
    shingles = mix(shingles + np.where(short, np.repeat(counts, counts), width).astype(np.uint64))
    owner, shingles = owner[keep], shingles[keep]
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])])
    return shingles[new], np.bincount(owner[new], minlength=len(texts))
