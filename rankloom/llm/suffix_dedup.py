"""Operator 8, substring dedup by suffix arrays, sorted in two stages.

recurrence.py brings together all places where a string of 50 bytes may recur. Here, for each block of such pieces,
a suffix array is built by two-stage sorting: only suffixes smaller than their successors (type B) are sorted
directly; the others (type A) are induced by scanning the buckets of first symbols in order, each suffix of a bucket
putting the one before it into that one's bucket. Adjacent common prefixes of 50 bytes or more then make runs of equal
strings, and the smallest document of a run is the one that keeps them.

Defined cases: null text is empty; texts under 50 bytes lose nothing; rows without an id neither lose nor take;
repeated ids don't count as smaller; matches never cross documents; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, written
from .recurrence import BYTES, WINDOW, Distinct, kept_parts, repeated_spans, with_spans

#: Symbols of a block (an anchor's pieces stay together).
BLOCK = 1_000_000


def suffix_array(s: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes of s (uint8; 0 is the least symbol) in order of their first ``depth`` symbols at least."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(s.astype(np.int16), append=-1))  # 1: smaller than the next symbol; the end is least of all
    turn = np.where(step != 0, np.arange(n), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # where the run of equal symbols ends
    smaller = step[turn] > 0  # type B
    b = np.flatnonzero(smaller)
    padded = np.concatenate([s, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[b]
    b = b[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    b_cuts = np.searchsorted(s[b], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[s[-1]].append(np.array([n - 1]))  # the last suffix precedes the end
    out = []
    for c in range(256):
        todo = induced[c]
        own = b[b_cuts[c] : b_cuts[c + 1]]
        while todo or len(own):
            now, last = (np.concatenate(todo), False) if todo else (own, True)
            todo, own = [], own[:0] if last else own
            out.append(now)
            before = now[now > 0] - 1
            symbol = s[before]
            if not last and len(same := before[(symbol == c)]):
                todo = [same]  # runs of the bucket's own symbol, in rounds
            before = before[up := symbol > c]
            symbol = symbol[up]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part, k in zip(np.split(before, cuts), symbol[np.concatenate([[0], cuts]).astype(int)] if len(symbol) else ()):
                induced[k].append(part)
    return np.concatenate(out)


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Length, up to depth, of the common prefix of each suffix and the one before it in order (0 for the first)."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.zeros(depth, np.uint8)]), depth)
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 100_000):
        j = np.arange(i, min(i + 100_000, len(order)))
        differ = view[order[j]] != view[order[j - 1]]
        out[j] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def first_documents(pieces: Distinct) -> np.ndarray:
    """The finder: smallest document for each window of each piece."""
    sizes = np.array([len(r) + 1 for r in pieces.raw], np.int64)
    out = np.full(int(pieces.windows.sum()), np.iinfo(np.int64).max)
    base = np.cumsum(pieces.windows) - pieces.windows
    ends = np.cumsum(sizes)
    starts_anchor = np.flatnonzero(np.concatenate([[True], np.diff(pieces.anchor) != 0])) if len(sizes) else np.zeros(0, np.int64)
    i = 0
    while i < len(sizes):
        # the last anchor that begins within BLOCK symbols, the next one at least
        limit = np.searchsorted(ends, ends[i] - sizes[i] + BLOCK)
        k = np.searchsorted(starts_anchor, limit, "right") - 1
        j = len(sizes) if limit >= len(sizes) else int(starts_anchor[k])
        if j <= i:
            k = np.searchsorted(starts_anchor, i, "right")
            j = int(starts_anchor[k]) if k < len(starts_anchor) else len(sizes)
        s = np.frombuffer(b"\xff".join(pieces.raw[i:j]) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: the end is 0
        piece = np.repeat(np.arange(i, j), sizes[i:j])
        offset = np.arange(len(s)) - (ends[piece] - sizes[piece] - (ends[i] - sizes[i]))
        order = suffix_array(s)
        order = order[offset[order] < pieces.windows[piece[order]]]  # starts of whole windows
        new = common_prefixes(s, order) < WINDOW
        cuts = np.flatnonzero(new)
        least = np.minimum.reduceat(pieces.first[piece[order]], cuts)
        out[base[piece[order]] + offset[order]] = np.repeat(least, np.diff(np.concatenate([cuts, [len(order)]])))
        i = j
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans) of what to remove, in bytes: see recurrence.repeated_spans."""
    return repeated_spans(docs, BYTES, first_documents, id_col, text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept: the remaining bytes, kept_sha256) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    joined = with_spans(docs, written(repeated(docs, id_col, text_col), "spans"), id_col, text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, runs, kept = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = text.encode()
            kept.append(b"".join(kept_parts(raw, spans)))
            n.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            runs.append(len(spans or b"") // 8)
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary()), pa.array(sha)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return arrow_map(joined, make, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
