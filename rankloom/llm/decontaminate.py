"""Operator 2, benchmark decontamination by q-gram lemma filtering.

Every benchmark passage gives overlapping segments on each of GRIDS: of 50 bytes, one every 10, so that any excerpt of 59
bytes or more holds a whole one, and of 80, one every 40, which may hold more edits. A passage shorter than 50 bytes is one
segment. A text region within k edits of a segment of m characters shares at least (m - q + 1) - k q of its q-grams, and they lie on
diagonals (position in the text less position in the segment) no more than k apart. So shared q-grams are counted in
bands of diagonals twice as wide as their distance, each overlapping the next by half: a region within the budget
lies wholly in one of them. Bands that reach the bound are verified by alignment in a band of diagonals, and what lies
within k edits is contamination.

Texts and passages are compared lower-cased with white space as single spaces; whole texts, many at a time in one
numpy buffer. The passages are a stated query set: they are read to the driver in blocks of at most BLOCK_BYTES, and
all documents pass each block, so what a task holds is bounded however large the benchmark.

Defined cases: null and empty texts match nothing, nor do null or empty passages. Edits are allowed in proportion to a
segment's length, as far as an unbroken q-gram must be left: two from 27 bytes on, one from 16 on, none below. A passage of
fewer than Q bytes, which has no q-gram, is found where it is the whole text.
Repeated documents repeat their matches; rows without an id are searched as any other. Of one passage the best region
(fewest edits, then leftmost) is given for each document. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, texts_of, unused

Q, EDITS = 8, 0.075
#: Bytes of a segment, and from one to the next.
GRIDS = ((50, 10), (80, 40))
#: Bytes of passages held by a task at a time, and shared q-grams counted at a time.
BLOCK_BYTES, HITS = 4 << 20, 1 << 22
BIT = 22


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().split())


def grams_of(buf: np.ndarray) -> np.ndarray:
    return np.ndarray((max(0, len(buf) - Q + 1),), "<u8", buffer=buf, strides=(1,)).copy() if len(buf) >= Q else np.zeros(0, np.uint64)


def slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIT)


class Index(NamedTuple):
    """Owners and offsets of q-grams, those of one q-gram together: times of them from first on. No offset is above shift."""

    owner: np.ndarray
    off: np.ndarray
    first: np.ndarray
    times: np.ndarray
    shift: int


def indexed(strings: list[bytes], longest: int) -> tuple[np.ndarray, Index]:
    """The distinct q-grams of some strings, in order, and where they occur."""
    grams = [grams_of(np.frombuffer(s, np.uint8)) for s in strings]
    gram, sizes = np.concatenate(grams), np.array([len(g) for g in grams])
    order = np.argsort(gram, kind="stable")
    owner, off = np.repeat(np.arange(len(grams)), sizes), np.concatenate([np.arange(n) for n in sizes])
    distinct, first, times = np.unique(gram[order], return_index=True, return_counts=True)
    return distinct, Index(owner[order], off[order].astype(np.int64), first, times, longest)


class Patterns:
    """Segments of passages (normalised, of Q bytes or more) on one grid, and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], segment: int, step: int) -> None:
        self.owner, self.segment, segments = [], segment, []
        for item, raw in items:
            for at in dict.fromkeys([*range(0, max(1, len(raw) - segment + 1), step), max(0, len(raw) - segment)]):
                self.owner.append((item, at))
                segments.append(raw[at : at + segment])
        self.sizes = np.array([len(s) for s in segments], np.int64)
        self.edits = np.minimum((self.sizes * EDITS).astype(np.int64), (self.sizes - Q) // Q)
        self.bound = self.sizes - Q + 1 - self.edits * Q
        self.bytes = np.zeros((len(segments), segment), np.uint8)
        for i, s in enumerate(segments):
            self.bytes[i, : len(s)] = np.frombuffer(s, np.uint8)
        self.gram, self.of_segments = indexed(segments, segment)
        _, self.of_passages = indexed([raw for _, raw in items], max((len(raw) for _, raw in items), default=0))  # the same q-grams
        self.width = int(1 << max(1, int(2 * self.edits.max(initial=1)).bit_length()))  # of half a band

    def regions(self, pos: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, lowest diagonal) of the bands that reach their segment's bound, from the q-grams that may be a passage's."""
        none = np.zeros(0, np.int64)
        # a band's q-grams begin within a stretch of the text: where no stretch has enough of any passage, none has of one
        reach, least = self.segment + 2 * self.width, int(self.bound.min(initial=1))
        i = np.searchsorted(pos, pos + reach)  # flagged positions up to reach on
        dense = i - np.arange(len(pos)) >= least
        if not dense.any():
            return none, none
        j = np.maximum.accumulate(np.where(dense, i, 0))  # positions before it lie in a dense stretch
        near = j > np.arange(len(pos))
        pos, gram = pos[near], gram[near]
        at = np.searchsorted(self.gram, gram)
        at[at == len(self.gram)] = 0
        pos, at = pos[ok := self.gram[at] == gram], at[ok]
        # first by diagonals of whole passages, of which a segment's are a part, in counters that several may share; then of segments
        size = 1 << max(10, int(self.of_passages.times[at].sum()).bit_length())
        count = np.zeros(size, np.int64)
        for *_, owner, band in self.shared(self.of_passages, pos, at):
            count += np.bincount(owner * 0x9E3779B1 + band & size - 1, minlength=size)
        enough = count + np.roll(count, -1) >= least
        enough |= np.roll(enough, 1)
        ok = np.zeros(len(pos), bool)
        for place, owner, band in self.shared(self.of_passages, pos, at):
            ok[place[enough[owner * 0x9E3779B1 + band & size - 1]]] = True
        key = self.reached(self.of_segments, pos[ok], at[ok], self.bound)
        return key >> 40, (key & (1 << 40) - 1) * self.width - self.of_segments.shift - self.width

    def shared(self, index: Index, pos: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in pos, owner, band) of the hits: what repeats itself shares many q-grams at each place, so they come in parts."""
        total, i = np.cumsum(index.times[at]), 0
        while i < len(pos):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + HITS, "right")))
            n = index.times[at[i:j]]
            hit = np.repeat(index.first[at[i:j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(np.arange(i, j), n)
            yield place, index.owner[hit], (pos[place] - index.off[hit] + index.shift + self.width) // self.width
            i = j

    def reached(self, index: Index, pos: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Owners and lower bands, in order, where two bands that adjoin have as many hits as the owner's bound."""
        parts = [np.unique(owner * (1 << 40) + band, return_counts=True) for _, owner, band in self.shared(index, pos, at)]
        if not parts:
            return np.zeros(0, np.int64)
        key, part = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        count = np.bincount(part, np.concatenate([c for _, c in parts]), len(key))
        after = np.append(key[1:] == key[:-1] + 1, False)
        both = count + np.where(after, np.append(count[1:], 0), 0)
        alone = key[np.append(True, ~after[:-1])] - 1  # the lower band has none, the upper one all
        few = count[np.append(True, ~after[:-1])]
        return np.sort(np.concatenate([key[both >= bound[key >> 40]], alone[few >= bound[alone >> 40]]]))

    def verified(self, buf: np.ndarray, seg: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end) of the best alignment of each segment along diagonals low .. low + 2 width, free at both ends of the text."""
        cols = 2 * self.width + 1
        pad = 4 * self.width + 2 * self.segment
        text = np.concatenate([np.zeros(pad, np.uint8), buf, np.zeros(pad, np.uint8)])
        best, end = np.zeros(len(seg), np.int32), np.zeros(len(seg), np.int64)
        for i in range(0, len(seg), 4096):
            s, lo = seg[i : i + 4096], low[i : i + 4096]
            cost = np.zeros((len(s), cols), np.int32)  # cost[d]: of the first j characters, ending at text position lo + d + j
            ramp = np.arange(cols, dtype=np.int32)
            for j in range(int(self.sizes[s].max(initial=0))):
                char = text[lo[:, None] + pad + j + ramp]
                new = cost + (char != self.bytes[s, j, None])
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a character of the segment is missing in the text
                new = np.minimum.accumulate(new - ramp, 1) + ramp  # characters of the text that the segment lacks
                cost = np.where((j < self.sizes[s])[:, None], new, cost)
            k = cost.argmin(1)
            best[i : i + 4096] = cost[np.arange(len(s)), k]
            end[i : i + 4096] = lo + k + self.sizes[s]
        return best, end

    def find(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text number, item) -> (edits, start, end) of the best region, offsets in the bytes of the normalised texts."""
        seg, low = self.regions(pos, gram)
        edits, end = self.verified(buf, seg, low)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in np.flatnonzero(edits <= self.edits[seg]):
            doc = int(np.searchsorted(starts, end[k] - 1, "right") - 1)  # ... so an alignment within the budget lies in one text
            stop = int(min(end[k] - starts[doc], sizes[doc]))
            _better(out, (doc, self.owner[seg[k]][0]), (int(edits[k]), max(0, stop - int(self.sizes[seg[k]])), stop))
        return out


def _better(out: dict, key: tuple[int, int], got: tuple[int, int, int]) -> None:
    if key not in out or got < out[key]:
        out[key] = got


class Passages:
    """All passages of a block: long ones by the segments of each grid, short ones whole, those without a q-gram by equality."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        raw = [(item, normal(text or "")) for item, text in items]
        least = min(GRIDS)[0]
        parts = [([x for x in raw if len(x[1]) >= size], size, step) for size, step in GRIDS]
        parts.append(([x for x in raw if Q <= len(x[1]) < least], least, least))  # apart, as short ones prune little
        self.patterns = [Patterns(*part) for part in parts if part[0]]
        self.flags = np.zeros(1 << BIT, bool)
        for patterns in self.patterns:
            self.flags[slot(patterns.gram)] = True
        self.tiny: dict[bytes, list[int]] = {}
        for item, x in raw:
            if 0 < len(x) < Q:
                self.tiny.setdefault(x, []).append(item)

    def find(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """See Patterns.find."""
        raw = [normal(t) for t in texts]
        out = {(k, item): (0, 0, len(r)) for k, r in enumerate(raw) for item in self.tiny.get(r, ())}
        gap = bytes(int(max(GRIDS)[0] * EDITS) + 1)  # more bytes than edits, none of them a segment's ...
        sizes = np.array([len(r) + len(gap) for r in raw], np.int64)
        buf = np.frombuffer(gap.join(raw) + gap, np.uint8)
        gram = grams_of(buf)
        pos = np.flatnonzero(self.flags[slot(gram)])
        gram = gram[pos]
        for patterns in self.patterns:
            for key, got in patterns.find(buf, np.cumsum(sizes) - sizes, sizes - len(gap), pos, gram).items():
                _better(out, key, got)
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of bounded size, streamed through the driver."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).filter(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, start, end): one row for each document and passage of which it holds a segment."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits int, start int, end int"
    bounded_batches(docs.sparkSession)
    out = None
    for block in blocks(benchmark, item_col, item_text):
        part = _searched(docs.select(id_col, text_col), block, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _searched(docs: DataFrame, block: list[tuple[int, str]], schema: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES and one passage
    id_col, text_col = docs.columns
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(held.value)
        for batch in batches:
            ids, texts = batch.column(id_col), texts_of(batch, text_col)
            found = passages.find(texts) if batch.num_rows else {}
            if found:
                rows = list(found)
                types = [ids.type, None, pa.int32(), pa.int32(), pa.int32()]
                cols = [ids.take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows]), *(pa.array([found[r][k] for r in rows], types[2]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark segment. Each row counts by its own text, whatever others have its id."""
    row = unused(docs, "row")
    rows = docs.withColumn(row, F.struct(F.col(id_col), F.xxhash64(text_col)))  # equal structs have equal or no ids
    found = contaminated(rows, benchmark, row, text_col).select(row).distinct()
    kept = rows.join(found, row, "left_anti")
    return kept.select(*docs.columns)
