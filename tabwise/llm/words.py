"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that its powers can be undone modulo 2**64
_CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For word features: all of ASCII but letters, digits and the apostrophe parts words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord("'")]] = False

_powers: list = []


def _power_tables():
    if not _powers:
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(_CHUNK + 1, _BASE, np.uint64))
            down = np.cumprod(np.full(_CHUNK + 1, pow(_BASE, -1, 1 << 64), np.uint64))
        _powers.extend([up, down])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def word_bounds(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = SPACE):
    """``(starts, ends, first)``: byte bounds of all words; words of row ``i`` are ``first[i]:first[i + 1]``."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~parting[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    at_row = offsets[:-1][offsets[:-1] < len(data)]
    begins[at_row] = inside[at_row]
    starts = np.flatnonzero(begins)
    ends = inside[:-1] & ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: tuple = ()) -> np.ndarray:
    """64-bit hash of each span of bytes (ascending, not overlapping). Works chunk by chunk; a longer span is hashed in parts.

    With ``heads`` the result has a further column for the first ``k`` bytes of each span, for each ``k`` in it.
    """
    up, down = _power_tables()
    out = np.empty((len(starts), 1 + len(heads)), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = int(np.searchsorted(ends, lo + _CHUNK, "right"))
            if j <= i:  # one span longer than a chunk
                h = np.uint64(0)
                for at in range(lo, int(ends[i]), _CHUNK):
                    part = data[at:min(at + _CHUNK, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                    h = mix(h + np.sum(part * up[:len(part)], dtype=np.uint64))
                out[i, 0] = h + np.uint64(int(ends[i]) - lo)
                for c, k in enumerate(heads, 1):
                    out[i, c] = np.sum((data[lo:lo + k].astype(np.uint64) + np.uint64(1)) * up[:k], dtype=np.uint64)
                i += 1
                continue
            n = int(ends[j - 1]) - lo
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum((data[lo:lo + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            base, undo = total[a], down[a]
            out[i:j, 0] = (total[b] - base) * undo
            for c, k in enumerate(heads, 1):
                out[i:j, c] = (total[np.minimum(a + k, b)] - base) * undo
            i = j
    return mix(out) if heads else mix(out[:, 0])


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int):
    """``(hashes, row, place)`` of all runs of ``n`` neighbouring words within a row, given the words' hashes; place: of the first word."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(_BASE) + words[k:len(words) - n + 1 + k])
    whole = np.flatnonzero(rows[:len(h)] == rows[n - 1:])
    return h[whole], rows[whole], whole
