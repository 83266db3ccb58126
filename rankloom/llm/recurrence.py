"""Windows that recur across documents: what substring dedup by suffix arrays and by automata have in common.

1 sketch   Anchors (winnow.py) of all documents, one hash for each document that has it, packed by hash prefix and
           shuffled. What two documents or more share sets a bit in a table of fixed size (at most MOST_BITS), one
           slice of it for each prefix.
2 pieces   Documents are read again. Around each anchor whose bit is set, the units of the windows it serves (a
           piece) go to the shard of the anchor's hash. A bit set by chance costs a piece, never a result.
3 shards   A shard holds every piece of its anchors, equal ones once. A finder (suffix array or automaton) gives for
           each window of each piece the smallest document that has it.
4 spans    Windows that a smaller document has too are merged into spans per document, and joined to the documents.

Equal windows choose equal anchors, so they meet in one shard: the result is exact. Rows are packed in binary columns,
so that the shuffles carry few, large rows. No group is expanded into pairs. A passage that very many documents hold
costs its shard 16 bytes a document beside its one copy.

Ids are integers. A row without an id takes no part: nothing is removed from it or because of it. Rows that repeat an
id are told apart by 32 bits of their texts' hash: of two different texts of one id, one pair in 2^32 would share spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .common import bounded_batches

WINDOW = 50
#: Anchors of a prefix, bytes of text of a shard, anchors and bytes that a task packs at a time, bits of the table.
PREFIX_ANCHORS, SHARD_BYTES, FLUSH_ANCHORS, FLUSH_BYTES, LEAST_BITS, MOST_BITS = 2_000_000, 4_000_000, 1_000_000, 16_000_000, 20, 31
KEPT_WORDS = 200_000
#: The bits of a text's hash that tell rows of one id apart.
TEXT_HASH = 0xFFFFFFFF
#: Places of a shard whose windows are laid out at a time.
PLACES = 16_384
_word_hash: dict[bytes, int] = {}


@dataclass(frozen=True)
class Units:
    """How a text is cut: into bytes, or into words (joined by spaces when they travel)."""

    name: str
    gram: int
    bytes_per_unit: int

    def laid_out(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(units of each text, starts, lengths, gram hashes) of texts laid end to end."""
        cut = [t.encode() for t in texts] if self.name == "bytes" else [t.encode().split() for t in texts]
        lengths = np.array([len(c) for c in cut], np.int64)
        starts = np.cumsum(lengths) - lengths
        if self.name == "bytes":
            return cut, starts, lengths, winnow.byte_gram_hash(np.frombuffer(b"".join(cut), np.uint8), self.gram)
        if len(_word_hash) > KEPT_WORDS:
            _word_hash.clear()
        for w in set().union(*cut).difference(_word_hash):
            _word_hash[w] = xxhash.xxh64_intdigest(w)
        flat = np.fromiter((_word_hash[w] for c in cut for w in c), np.uint64, int(lengths.sum()))
        return cut, starts, lengths, winnow.unit_gram_hash(flat, self.gram)

    def piece(self, units, a: int, b: int) -> bytes:
        return units[a:b] if self.name == "bytes" else b" ".join(units[a:b])


BYTES, WORDS = Units("bytes", 16, 1), Units("words", 8, 6)


def _log2(x: float) -> int:
    return max(0, int(np.ceil(np.log2(max(x, 1)))))


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob: a head of sizes and their bytes."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays.values()]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw))


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which take fewer bytes once they are compressed; cumsum gives the numbers back."""
    return np.diff(ordered, prepend=np.uint32(0))


def _unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(types))
    at = 8 * len(types) + np.cumsum(sizes) - sizes
    return [np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, int(i)) for t, n, i in zip(types, sizes, at)]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    """Ids and texts of the rows that have an id."""
    ids = batch.column(0)
    if ids.null_count:
        batch = batch.filter(ids.is_valid())
    return np.asarray(batch.column(0)).astype(np.int64), [t or "" for t in batch.column(1).to_pylist()]


def _by_key(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, rows) in stable order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(key[rows[0]]), rows


def _grouped(df: DataFrame, parts: int, work: Callable[[int, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(key, blobs) for each key of (key, blob), dealt to ``parts`` partitions, one key in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if held:
                        yield from work(now, held)
                    now, held = key, []
                held.append(blob)
        if held:
            yield from work(now, held)

    return df.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def shared_bits(docs: DataFrame, units: Units, prefix: int, bits: int) -> bytes:
    """The table: bit i is set if two documents or more have one anchor hash that begins with i (of ``bits`` bits)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
            h, n = np.unique(h[new], return_counts=True)
            low = (h << np.uint64(prefix) >> np.uint64(32)).astype("<u4")
            rows = [(k, _packed(one=_steps(low[i][n[i] == 1]), more=_steps(low[i][n[i] > 1]))) for k, i in _by_key((h >> np.uint64(64 - prefix)).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])

        seen = 0
        for batch in batches:
            ids, texts = _texts(batch)
            if not len(ids):
                continue
            _, starts, lengths, h = units.laid_out(texts)
            p, _, _ = winnow.anchors(h, units.gram, WINDOW, starts, lengths)
            held.append((h[p], seen + np.searchsorted(starts, p, "right")))
            seen += len(ids) + 1
            if sum(len(x[0]) for x in held) >= FLUSH_ANCHORS:
                yield flush()
                held.clear()
        if any(len(x[0]) for x in held):
            yield flush()

    def slices(key: int, blobs: list) -> Iterator[pa.RecordBatch]:
        one, more = zip(*((np.cumsum(x, dtype=np.uint32) for x in _unpacked(b, "<u4", "<u4")) for b in blobs))
        low, n = np.unique(np.concatenate(one), return_counts=True)
        shared = np.concatenate([low[n > 1], *more])
        table = np.zeros(1 << bits - prefix, bool)
        table[shared >> np.uint32(32 - (bits - prefix))] = True
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["key", "blob"])

    schema = "key bigint, blob binary"
    table = bytearray(1 << bits - 3)
    step = 1 << bits - prefix - 3
    for row in _grouped(docs.mapInArrow(sketch, schema), 1 << prefix, slices, schema).toLocalIterator():  # a slice at a time
        table[row["key"] * step : (row["key"] + 1) * step] = row["blob"]
    return bytes(table)


def pieces(docs: DataFrame, units: Units, table: bytes, bits: int, shards: int) -> DataFrame:
    """(key: shard, blob): hash, document, start and size of each piece around an anchor whose bit is set, and its bytes."""
    held_table = docs.sparkSession.sparkContext.broadcast(table)  # at most 2 ** MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(held_table.value, np.uint8)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, doc_id, doc_hash, start, windows = (np.concatenate([x[k] for x in held]) for k in range(5))
            raw = [r for x in held for r in x[5]]
            rows = []
            for k, i in _by_key((h & np.uint64(shards - 1)).astype(np.int64)):
                parts = [raw[j] for j in i.tolist()]
                # half a hash will do: anchors that meet by chance cost comparisons, never a result
                rows.append((k, _packed(h=(h[i] >> np.uint64(32)).astype("<u4"), id=doc_id[i], th=doc_hash[i], start=start[i], windows=windows[i], size=np.array([len(r) for r in parts], "<u4"), raw=np.frombuffer(b"".join(parts), np.uint8))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])

        for batch in batches:
            ids, texts = _texts(batch)
            if not len(ids):
                continue
            cut, starts, lengths, h = units.laid_out(texts)
            p, lo, hi = winnow.anchors(h, units.gram, WINDOW, starts, lengths)
            slot = h[p] >> np.uint64(64 - bits)
            on = (flags[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            p, lo, hi = p[on], lo[on], hi[on]
            if not len(p):
                continue
            doc = np.searchsorted(starts, p, "right") - 1
            # an empty text begins where the next one does; searchsorted gives the last of them, which has the units
            own = np.array([xxhash.xxh64_intdigest(texts[d], 42) & TEXT_HASH for d in np.unique(doc)], "<u4")
            doc_hash = own[np.searchsorted(np.unique(doc), doc)]
            start = lo - starts[doc]
            raw = [units.piece(cut[d], a, b) for d, a, b in zip(doc.tolist(), start.tolist(), (hi - starts[doc] + WINDOW).tolist())]
            held.append((h[p], ids[doc], doc_hash, start.astype("<u4"), (hi - lo + 1).astype("<u2"), raw))
            size += sum(map(len, raw))
            if size >= FLUSH_BYTES:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "key bigint, blob binary")


@dataclass
class Distinct:
    """The distinct pieces of anchors that two documents or more share, ordered by anchor; first: the smallest id."""

    raw: list[bytes]
    anchor: np.ndarray
    windows: np.ndarray
    first: np.ndarray


#: Smallest id for each window of each distinct piece, end to end in the order of the pieces.
Finder = Callable[[Distinct], np.ndarray]


def _first_ids(blobs: list, finder: Finder) -> tuple[np.ndarray, ...]:
    """(id, text hash, start, end) of the runs of windows that a smaller document has too."""
    index: dict[tuple[int, bytes], int] = {}
    cols: list[list[np.ndarray]] = []
    blobs.reverse()
    while blobs:  # each is let go once it is read
        blob = blobs.pop()
        h, doc_id, doc_hash, start, windows, size, raw = _unpacked(blob, "<u4", "<i8", "<u4", "<u4", "<u2", "<u4", "u1")
        text, ends = raw.tobytes(), np.cumsum(size.astype(np.int64))
        which = [index.setdefault(k, len(index)) for k in zip(h.tolist(), (text[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())))]
        cols.append([np.array(which, np.int64), h, doc_id, doc_hash, start, windows])
    which, h, doc_id, doc_hash, start, windows = (np.concatenate(x) for x in zip(*cols))
    del cols
    most = np.iinfo(np.int64).max
    first, last = np.full(len(index), most), np.full(len(index), -most)
    np.minimum.at(first, which, doc_id)
    np.maximum.at(last, which, doc_id)
    anchor, n_windows = np.empty(len(index), np.uint32), np.empty(len(index), np.int64)
    anchor[which], n_windows[which] = h, windows
    order = np.argsort(anchor, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchor[order])) + 1]).astype(np.int64)
    low, high = np.minimum.reduceat(first[order], cuts), np.maximum.reduceat(last[order], cuts)
    shared = np.repeat(low < high, np.diff(np.concatenate([cuts, [len(order)]])))
    keep = order[shared]  # pieces of shared anchors, an anchor's together
    keys = list(index)
    found = finder(Distinct([keys[i][1] for i in keep.tolist()], anchor[keep], n_windows[keep], first[keep]))
    at = np.full(len(index), -1, np.int64)
    at[keep] = np.cumsum(n_windows[keep]) - n_windows[keep]
    out = []
    rows = np.flatnonzero((at[which] >= 0) & (doc_id > low[np.searchsorted(anchor[order][cuts], h)]))
    for i in range(0, len(rows), PLACES):
        r = rows[i : i + PLACES]
        n = windows[r].astype(np.int64)
        total = np.cumsum(n)
        nth = np.arange(total[-1]) - np.repeat(total - n, n)
        gone = np.flatnonzero(found[np.repeat(at[which[r]], n) + nth] < np.repeat(doc_id[r], n))
        if not len(gone):
            continue
        owner = np.repeat(r, n)[gone]
        new = np.concatenate([[True], (np.diff(gone) > 1) | (np.diff(owner) != 0)])
        end = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(gone) - 1]])
        o, s, e = owner[new], nth[gone[new]], nth[gone[end]]
        out.append((doc_id[o], doc_hash[o].astype(np.int64), start[o].astype(np.int64) + s, start[o].astype(np.int64) + e + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def merged(key: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each key: (index of a row of the key, start, end), touching ones joined."""
    order = np.lexsort((s, key))
    key, s, e = key[order], s[order], e[order]
    group = np.cumsum(np.concatenate([[0], np.diff(key) != 0])).astype(np.int64)
    big = int(e.max()) + 2
    reach = np.maximum.accumulate(e + group * big) - group * big  # furthest end so far in the key
    new = np.concatenate([[True], (np.diff(group) != 0) | (s[1:] > reach[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return order[new], s[new], reach[last]


def repeated_spans(docs: DataFrame, units: Units, finder: Finder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): for each document with something to remove, its text's hash and the removed spans, as little-endian
    32-bit pairs (start, end) in units, in order and apart."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = 2 * total / units.bytes_per_unit / (WINDOW - units.gram + 2)
    prefix = max(6, _log2(anchors / PREFIX_ANCHORS))
    bits = min(MOST_BITS, max(LEAST_BITS, _log2(4 * anchors)))
    shards = 1 << max(6, _log2(total / SHARD_BYTES))
    table = shared_bits(texts, units, min(prefix, bits - 3), bits)

    def in_shard(key: int, blobs: list) -> Iterator[pa.RecordBatch]:
        ids, hashes, s, e = _first_ids(blobs, finder)
        if len(ids):
            both = winnow.mix(ids.view(np.uint64)) ^ hashes.view(np.uint64)
            i, s, e = merged(both.view(np.int64), s, e)
            ids, hashes = ids[i], hashes[i]
            rows = [(k, _packed(id=ids[j], th=hashes[j], s=s[j].astype("<u4"), e=e[j].astype("<u4"))) for k, j in _by_key((winnow.mix(ids.view(np.uint64)) >> np.uint64(32) & np.uint64(shards - 1)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])

    def of_documents(key: int, blobs: list) -> Iterator[pa.RecordBatch]:
        ids, hashes, s, e = (np.concatenate(x) for x in zip(*(_unpacked(b, "<i8", "<i8", "<u4", "<u4") for b in blobs)))
        both = winnow.mix(ids.view(np.uint64)) ^ hashes.view(np.uint64)
        i, s, e = merged(both.view(np.int64), s.astype(np.int64), e.astype(np.int64))
        ids, hashes = ids[i], hashes[i]
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(hashes) != 0)) + 1, [len(ids)]])
        flat = np.stack([s, e], 1).astype("<u4")
        spans = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), pa.array(hashes[cuts[:-1]]), pa.array(spans, pa.binary())], names=["id", "th", "spans"])

    blobs = _grouped(pieces(texts, units, table, bits, shards), shards, in_shard, "key bigint, blob binary")
    return _grouped(blobs, shards, of_documents, "id bigint, th bigint, spans binary")


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) of every document: each row is joined to its own spans, null if there are none. Spans grow with the
    documents, so the join is a merge join at every size."""
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text").bitwiseAND(F.lit(TEXT_HASH)))
    return texts.join(spans.withColumnRenamed("id", "_id").hint("merge"), (F.col(id_col) == F.col("_id")) & (texts["th"] == spans["th"]), "left").select(id_col, "text", "spans")


def kept_parts(units, spans: bytes | None) -> list:
    """What the spans leave of a document's units."""
    pairs = np.frombuffer(spans or b"", "<u4").tolist()
    return [units[a:b] for a, b in zip([0, *pairs[1::2]], [*pairs[::2], len(units)])]
