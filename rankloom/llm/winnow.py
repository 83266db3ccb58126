"""Content anchors: positions chosen by content alone, one at least in every window of a stated length.

Equal windows choose equal anchors at equal offsets, so windows that recur anywhere meet under one anchor
hash. Nothing is sampled: a window without an anchor cannot exist.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the mixing steps.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(v: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches the high bits."""
    v = v * MIX_A
    v ^= v >> np.uint64(29)
    v *= MIX_B
    v ^= v >> np.uint64(32)
    return v


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over a[i:i + width], for every i with a whole window."""
    done, have = a, 1
    while have * 2 <= width:
        done = op(done[:-have], done[have:])
        have *= 2
    return op(done[: len(done) - (width - have)], done[width - have :]) if have < width else done


def anchors(h: np.ndarray, gram: int, window: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (position, first and last start of the windows they serve) of items laid end to end in a buffer.

    h: a hash for each gram position; starts, lengths: of the items, in units. A window of ``window`` units is served by
    the positions of the least hash among its grams; each window that lies in one item is served.
    """
    n, width, most = len(h), window - gram + 1, np.iinfo(np.int32).max
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    low = (h >> np.uint64(33)).astype(np.int32)  # 31 bits order the grams
    item = np.repeat(np.arange(len(starts)), lengths)[:n]
    ends = starts + lengths
    bad = np.arange(n) + gram > ends[item]  # crosses into the next item
    low[bad] = most
    pad = np.full(width - 1, most, np.int32)
    least = sliding(np.minimum, np.concatenate([pad, low, pad]), width)  # least[i]: of the window that starts at i - width + 1
    p = np.flatnonzero((sliding(np.maximum, least, width) == low) & ~bad)
    lo, hi = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(least, width)
    for i in range(0, len(p), 65536):
        q = p[i : i + 65536]
        own = view[q] == low[q, None]  # a run: windows between two that p serves are served by p too
        lo[i : i + 65536] = q - width + 1 + own.argmax(1)
        hi[i : i + 65536] = q - own[:, ::-1].argmax(1)
    lo, hi = np.maximum(lo, starts[item[p]]), np.minimum(hi, ends[item[p]] - window)
    ok = lo <= hi
    return p[ok], lo[ok], hi[ok]


def byte_gram_hash(buf: np.ndarray, gram: int = 16) -> np.ndarray:
    """Hash of the 16 bytes from each position of a uint8 buffer."""
    n = len(buf) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    view = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    return mix(mix(view[:n].copy()) ^ view[8 : 8 + n])


def unit_gram_hash(units: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` 64-bit unit hashes."""
    n = len(units) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mix(units[:n].copy())
    for i in range(1, gram):
        h = mix(h ^ units[i : i + n])
    return h
