"""Word shingles of whole texts as sets of 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

import numpy as np

from .common import byte_runs, keyed_hashes, mix
from .substrings import Hasher

_BASE = np.uint64(0x9FB21C651E98DF25)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def _blocked(text: np.ndarray, most: int):
    """(from, to) parts of a text, cut after white space so that no word is divided."""
    at, n = 0, len(text)
    while at < n:
        to = min(at + most, n)
        while to < n:
            part = text[at:to]
            gap = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(gap):
                to = at + int(gap[-1]) + 1
                break
            to = min(to + most, n)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each row, one row after another, and each row's number of words.

    Fast, for features: words can be made whose hashes are equal. See :func:`keyed_words`.
    """
    base = int(offsets[0])
    x = data[base : int(offsets[-1])]
    offs = offsets - base
    gap = (x == 32) | ((x >= 9) & (x <= 13))
    new = np.ones(len(x) + 1, bool)  # the byte before is a gap or another row's
    new[1:] = np.append(gap, True)[: len(x)]
    new[offs] = True
    starts = np.flatnonzero(~gap & new[:-1])
    end = np.ones(len(x), bool)
    end[:-1] = gap[1:]
    inner = offs[1:-1]
    end[inner[(inner > 0)] - 1] = True
    ends = np.flatnonzero(~gap & end)
    low = np.where((x >= 65) & (x <= 90), x + np.uint8(32), x)
    counts = np.diff(np.searchsorted(starts, offs))
    return Hasher(low, _BASE)(starts, ends + 1), counts


def keyed_words(data: np.ndarray, offsets: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`word_hashes` by a keyed cryptographic hash of each different word: equal hashes stand for equal words."""
    base = int(offsets[0])
    x = data[base : int(offsets[-1])]
    low = np.where((x >= 65) & (x <= 90), x + np.uint8(32), x)
    words, counts = byte_runs(low, offsets - base, ~((x == 32) | ((x >= 9) & (x <= 13))))
    coded = words.dictionary_encode()
    return keyed_hashes(coded.dictionary.to_pylist(), key)[coded.indices.to_numpy()], counts


def long_words(text: np.ndarray, most: int = 1 << 20, hashes=word_hashes) -> np.ndarray:
    """Like ``hashes`` for one long text, block by block."""
    return np.concatenate([np.zeros(0, np.uint64), *(hashes(text[a:b], np.array([0, b - a]))[0] for a, b in _blocked(text, most))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, key: bytes, width: int = 5, most: int = 1 << 20) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles; fewer words: of all words as one; none: empty.

    Words are hashed under ``key``, so two different shingles have equal hashes by chance only, once in 2**64.
    """
    from .common import spans

    hashes = lambda d, o: keyed_words(d, o, key)
    out: list[np.ndarray] = []
    for i, j in spans(offsets, most):
        if j == i + 1 and offsets[j] - offsets[i] > most:
            words = long_words(data[offsets[i] : offsets[j]], most, hashes)
            counts = np.array([len(words)])
        else:
            words, counts = hashes(data, offsets[i : j + 1])
        sums = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            sums = sums * _NEXT + mix(words[k : k + len(sums)])
        sums = mix(sums)
        at = 0
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(sums[at : at + n - width + 1]))
            elif n:
                whole = np.array([n], np.uint64)
                for k in range(at, at + n):
                    whole = whole * _NEXT + mix(words[k : k + 1])
                out.append(mix(whole))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out
