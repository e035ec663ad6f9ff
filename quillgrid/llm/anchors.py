"""Content-defined anchors: each window of a text names one of its places, by its content alone.

The windows of ``width`` bytes of a text are each assigned the place, within them, whose next ``gram`` bytes have
the least digest (the leftmost of several). Equal windows name the same place, so whatever repeats ``width`` bytes
repeats an anchor, and texts need only be compared around anchors that they share.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the passages that are removed; of the windows that anchors tell apart; of an anchor.
WIDTH, SHORT, GRAM = 400, 256, 64
_PLACE = 20
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def digests(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit digest of every run of ``gram`` bytes (a power of two)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    h ^= h >> np.uint64(29)
    step, turn = 1, 1
    while step < gram:
        h = h[:-step] * _ODD[turn % 8] + (h[step:] ^ (h[step:] >> np.uint64(31)))
        h ^= h >> np.uint64(32)
        step, turn = step * 2, turn + 1
    return h * _ODD[1]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    step, m = 1, values
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(text: bytes, width: int = SHORT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest of the anchor, first window, last window) of each run of windows with the same anchor.

    Texts are taken in slices of 2 ** 20 windows; a run is cut where a slice ends, by an offset that is no part of
    the content, so the anchor of the window at a cut is named in both slices alike.
    """
    n = len(text) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    data = np.frombuffer(text, np.uint8)
    out = []
    size = (1 << _PLACE) - width
    for at in range(0, n, size):
        part = data[at : min(at + size, n) + width - 1]
        h = digests(part, gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = least((h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | place, width - gram + 1)
        where = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        last = np.r_[first[1:] - 1, len(where) - 1]
        out.append((h[where[first]], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
