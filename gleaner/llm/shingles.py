"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch of documents.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D after A-Z is lower-cased; these separators are
single bytes in UTF-8, so splitting bytes equals splitting characters.  Separator runs are first squeezed to one
space.  A shingle's hash is then the polynomial hash of the squeezed bytes from its first word's start to its last
word's end, which depends on the word sequence alone, and is read off one running sum over the batch.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_AS_IS = np.arange(256, dtype=np.uint8)
_AS_IS[[9, 10, 11, 12, 13]] = 32
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n + n // 4)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _squeeze(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space after every word, where words begin in them, their lengths, and the words of each text."""
    word = low != 32
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    cut = np.concatenate([[0], ends[:-1]])
    cut = cut[cut < len(low)]
    starts[cut] = word[cut]
    stops = np.ones(len(low), bool)
    stops[:-1] = ~word[1:] | starts[1:]
    stops &= word
    begin = np.flatnonzero(starts)
    length = np.flatnonzero(stops) + 1 - begin
    n_words = np.searchsorted(begin, ends) - np.searchsorted(begin, np.concatenate([[0], ends[:-1]]))
    place = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(place[-1]), 32, np.uint8)
    filled = np.ones(len(out), bool)
    filled[place[1:] - 1] = False
    out[filled] = low[word]
    return out, place[:-1], length, n_words


def hashes(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text (with repeats) and the bounds of each text's part.

    raw: the UTF-8 bytes of all texts; offsets: their bounds.  A text of fewer words than `words` has its whole word
    sequence as one shingle; one without words has none.
    """
    base = int(offsets[0])
    raw = raw[base : int(offsets[-1])]
    ends = np.asarray(offsets[1:], np.int64) - base
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    text, begin, length, n_words = _squeeze((_LOWER if lower else _AS_IS)[raw], ends)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_TABLE[text] * _power(_BASE, len(text)), out=sums[1:])
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    n_shingles = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n_shingles)]).astype(np.int64)
    index = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_shingles) + np.repeat(word_at[:-1], n_shingles)
    last = index + np.repeat(np.minimum(n_words, words), n_shingles) - 1
    start, stop = begin[index], begin[last] + length[last]
    value = (sums[stop] - sums[start]) * _power(_INVERSE, len(text))[start]
    return mix(value + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text and their bounds."""
    if not len(values):
        return values, bounds
    out = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    heads = bounds[:-1]
    fresh[heads[heads < len(out)]] = True
    count = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], count[bounds]
