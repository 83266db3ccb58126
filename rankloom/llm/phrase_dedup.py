"""Operator 10, substring dedup by repeated-phrase automata (pyahocorasick).

recurrence.py brings together all places where 50 words may recur. Here, for each shard of them, recurring passages
are confirmed (runs of windows that two documents or more have, by their hash), and an Aho-Corasick automaton is
compiled from them, over words as symbols. All pieces of the shard then stream through it; every occurrence of a
passage found by the automaton votes with its document, and the smallest document keeps the passage. Windows of a
passage that their smallest document has, but not unbroken, are compiled and voted on one by one.

Defined cases: null text has no words; texts under 50 words lose nothing; rows without an id neither lose nor take;
repeated ids don't count as smaller; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import winnow
from .common import arrow_map, written
from .recurrence import WINDOW, WORDS, Distinct, kept_parts, repeated_spans, with_spans

#: Words of the pieces that one automaton is compiled from and streams (an anchor's pieces stay together).
AUTOMATON_WORDS = 120_000
#: Occurrences that vote at a time.
OCCURRENCES = 32_768
#: Words of the phrases that one automaton is compiled from: fewer than the code points above the surrogates, the first
#: of which stands for every word that no phrase has.
PHRASE_WORDS, OTHER = 250_000, 0xE000


def _confirmed(flat: np.ndarray, starts: np.ndarray, windows: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(place of the first word, windows, smallest document) of the passages: runs of a piece's windows that have one smallest document, by hash."""
    h = winnow.unit_gram_hash(flat.astype(np.uint64), WINDOW)
    piece = np.repeat(np.arange(len(starts)), windows)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = starts[piece] + nth
    h = h[place]
    order = np.argsort(h, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    n = np.diff(np.concatenate([cuts, [len(order)]]))
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(first[piece[order]], cuts), n)
    new = np.concatenate([[True], (np.diff(piece) != 0) | (np.diff(least) != 0)])
    at = np.flatnonzero(new)
    return list(zip(place[at].tolist(), np.diff(np.concatenate([at, [len(piece)]])).tolist(), least[at].tolist()))


def _chunks(phrases: Iterable[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Phrases in lists of at most PHRASE_WORDS words (a phrase is shorter than two windows)."""
    out, words = [], 0
    for phrase in phrases:
        words += phrase[1] + WINDOW - 1
        if out and words > PHRASE_WORDS:
            yield out
            out, words = [], phrase[1] + WINDOW - 1
        out.append(phrase)
    if out:
        yield out


def _voted(phrases: list[tuple[int, int, int]], flat: np.ndarray, starts: np.ndarray, windows: np.ndarray, first: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Smallest document of each phrase, put to all windows of its occurrences in out."""
    at, size, _ = np.array(phrases, np.int64).T
    inside = np.zeros(len(flat) + 1, np.int32)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size + WINDOW - 1, -1)
    own = np.unique(flat[np.cumsum(inside[:-1], dtype=np.int32) > 0])
    letter = np.full(int(flat.max()) + 1, OTHER, np.uint32)
    letter[own] += np.arange(1, len(own) + 1, dtype=np.uint32)
    text = letter[flat].astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton()
    for k, (a, n, _) in enumerate(phrases):
        automaton.add_word(text[a : a + n + WINDOW - 1], k)
    automaton.make_automaton()
    found = array("q")
    for p, (a, n) in enumerate(zip(starts.tolist(), windows.tolist())):
        for end, k in automaton.iter(text[a : a + n + WINDOW - 1]):
            found.extend((k, p, end))
    key, piece, end = np.frombuffer(found, np.int64).reshape(-1, 3).T
    owner = np.full(len(phrases), np.iinfo(np.int64).max)
    np.minimum.at(owner, key, first[piece])
    base = np.cumsum(windows) - windows
    n = size[key]
    begin = base[piece] + end + 1 - (n + WINDOW - 1)  # first window of the occurrence
    for i in range(0, len(key), OCCURRENCES):
        m, b, o = n[i : i + OCCURRENCES], begin[i : i + OCCURRENCES], owner[key[i : i + OCCURRENCES]]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        np.minimum.at(out, np.repeat(b, m) + nth, np.repeat(o, m))
    return owner


def _block(raw: list[bytes], windows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Smallest document for each window of the pieces of one automaton."""
    code: dict[bytes, int] = {}
    spelt = array("I")
    for piece in raw:  # one piece's words at a time: a common anchor has very many pieces
        spelt.extend([code.setdefault(w, len(code)) for w in piece.split(b" ")])
    flat, sizes = np.frombuffer(spelt, np.uint32), windows + WINDOW - 1
    pieces = (flat, np.cumsum(sizes) - sizes, windows, first)
    words, width = flat.tobytes(), flat.itemsize
    out = np.full(int(windows.sum()), np.iinfo(np.int64).max)
    runs: dict[bytes, tuple[int, int, int]] = {}
    for at, n, least in _confirmed(*pieces):
        runs.setdefault(words[width * at : width * (at + n + WINDOW - 1)], (at, n, least))
    singles: dict[bytes, tuple[int, int, int]] = {}
    for phrases in _chunks(runs.values()):
        for (at, n, least), owner in zip(phrases, _voted(phrases, *pieces, out).tolist()):
            for k in range(at, at + n) if owner != least else ():  # its smallest document has it, but not unbroken
                singles.setdefault(words[width * k : width * (k + WINDOW)], (k, 1, least))
    for phrases in _chunks(singles.values()):
        _voted(phrases, *pieces, out)
    return out


def first_documents(pieces: Distinct) -> np.ndarray:
    """The finder: smallest document for each window of each piece."""
    out, i = [], 0
    raw = pieces.raw
    words = np.array([r.count(b" ") + 1 for r in raw], np.int64)
    ends = np.cumsum(words)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(pieces.anchor) != 0])) if raw else np.zeros(0, np.int64)
    while i < len(raw):
        limit = np.searchsorted(ends, ends[i] - words[i] + AUTOMATON_WORDS)
        j = len(raw) if limit >= len(raw) else int(begins[np.searchsorted(begins, limit, "right") - 1])
        if j <= i:
            k = np.searchsorted(begins, i, "right")
            j = int(begins[k]) if k < len(begins) else len(raw)
        out.append(_block(raw[i:j], pieces.windows[i:j], pieces.first[i:j]))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans) of what to remove, in words: see recurrence.repeated_spans."""
    return repeated_spans(docs, WORDS, first_documents, id_col, text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept: the remaining words joined by one space, kept_sha256) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    joined = with_spans(docs, written(repeated(docs, id_col, text_col), "spans"), id_col, text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = text.encode().split()
            left = [w for part in kept_parts(words, spans) for w in part]
            n.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(sha)], names=[id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    return arrow_map(joined, make, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
