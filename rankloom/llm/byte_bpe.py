"""Operator 4, byte-level BPE encoding and decoding with numpy matrices.

The distinct pieces of a batch lie in padded matrices, one for each bucket of lengths, a row for each piece. In every
round each row merges its leftmost pair of minimum rank (one round for all rows); ranks come from an open-addressing
hash table over token pairs; the row then closes up (compaction), and rows without a mergeable pair leave the matrix.
Only the two pairs beside a merge are looked up again. A piece longer than MATRIX_BYTES is a matrix of its own, wrapped
into rows of that width, and a round merges the leftmost pair of minimum rank of all its rows.

A worker keeps the codes of pieces it has met, up to KEPT_PIECES (then it starts anew): memory is bounded.

Defined cases: null text is empty: no ids, and the digest of nothing. Repeated rows give repeated results; an empty
table an empty result; only the id and the text are read. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, texts_of

MATRIX_BYTES, KEPT_PIECES, MATRIX_ROWS = 512, 600_000, 65_536
NONE = np.int32(0x7FFFFFFF)
DEFAULT = "byte_bpe_50k.tiktoken"


class PairTable:
    """(left id, right id) -> rank of their merger, NONE if there is none: linear probing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(len(rank) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = key[todo[free]]  # the last of those that want a slot gets it
            won = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; an id below 0 (padding) has no pair."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1) & (key >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
            hit = self.keys[slot[todo]] == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (self.keys[slot[todo]] != -1)]
        return out


class ByteBPE:
    """A vocabulary of ranks (a tiktoken file) and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        lines = map(bytes.split, Path(path).read_bytes().splitlines())
        self.ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
        self.cut = regex.compile(pattern).findall
        self.tokens = {r: t for t, r in self.ranks.items()}
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*np.array(splits, np.int32).reshape(-1, 3).T.copy())
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Codes of pieces of like length, by rounds of one merge a row."""
        size = np.array([len(p) for p in pieces])
        wide = int(size.max())
        ids = np.full((len(pieces), wide + 1), -1, np.int32)
        filled = np.arange(wide + 1) < size[:, None]
        ids[filled] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out = [b""] * len(pieces)
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), wide)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(row)), at]
            go = best != NONE
            if not go.all():
                flat, step = ids[~go].astype("<i4").tobytes(), 4 * ids.shape[1]
                for i, (k, n) in enumerate(zip(row[~go].tolist(), size[~go].tolist())):
                    out[k] = flat[i * step : i * step + 4 * n]
                row, ids, rank, at, best, size = row[go], ids[go], rank[go], at[go], best[go], size[go]
            if not len(row):
                break
            size = size - 1
            wide = int(size.max())
            # compaction: what stands after the merged pair moves one place to the left
            col = np.arange(wide + 1)
            take = np.minimum(col + (col > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take, 1)
            n = np.arange(len(row))
            ids[n, at] = best
            ids[:, -1] = np.where(size > wide, ids[:, -1], -1)
            take = np.minimum(np.arange(wide) + (np.arange(wide) > at[:, None]), rank.shape[1] - 1)
            rank = np.take_along_axis(rank, take, 1)
            here = at < wide
            rank[n[here], at[here]] = self.pairs.get(ids[n[here], at[here]], ids[n[here], at[here] + 1])
            left = at > 0
            rank[n[left], at[left] - 1] = self.pairs.get(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        return out

    def merged_wide(self, piece: bytes) -> bytes:
        """Code of one long piece, whose ids lie in rows of MATRIX_BYTES: only the rows beside a merge close up."""
        rows = -(-len(piece) // MATRIX_BYTES)
        ids, rank = np.full((rows, MATRIX_BYTES), -1, np.int32), np.full((rows, MATRIX_BYTES), NONE, np.int32)
        flat = ids.reshape(-1)[: len(piece)]
        flat[:] = self.of_byte[np.frombuffer(piece, np.uint8)]
        rank.reshape(-1)[: len(piece) - 1] = self.pairs.get(flat[:-1], flat[1:])  # the last of a row is paired with the next row's first
        size, least = (ids >= 0).sum(1).tolist(), rank.min(1)
        after, before = list(range(1, rows + 1)), list(range(-1, rows - 1))  # the rows beside that have ids left
        while True:
            r = int(least.argmin())
            best = least[r]
            if best == NONE:
                return ids[ids >= 0].astype("<u4").tobytes()
            c = int(rank[r].argmin())
            q, d = (r, c + 1) if c + 1 < size[r] else (after[r], 0)
            ids[r, c] = best
            ids[q, d:-1], ids[q, -1] = ids[q, d + 1 :], -1
            rank[q, d:-1], rank[q, -1] = rank[q, d + 1 :], NONE
            size[q] -= 1
            if not size[q]:
                after[r] = after[q]
                if after[q] < rows:
                    before[after[q]] = r
            p, e = (r, c - 1) if c else (before[r], size[before[r]] - 1)
            s, f = (r, c + 1) if c + 1 < size[r] else (after[r], 0)
            beside = np.array([ids[p, e] if p >= 0 else -1, best, ids[s, f] if s < rows else -1], np.int32)
            both = self.pairs.get(beside[:2], beside[1:])
            if p >= 0:
                rank[p, e] = both[0]
                least[p] = rank[p].min()
            rank[r, c] = both[1]
            least[r], least[q] = rank[r].min(), rank[q].min()

    def learn(self, pieces: set[str]) -> None:
        """Put the codes of pieces into known."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if raw in self.ranks:
                self.known[p] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.known[p] = self.merged_wide(raw)
            else:
                buckets.setdefault(max(4, len(raw) + 3 & ~3), []).append((p, raw))
        for width, items in buckets.items():
            step = max(1, MATRIX_ROWS * 8 // width)
            for i in range(0, len(items), step):
                part = items[i : i + step]
                self.known.update(zip((p for p, _ in part), self.merged([raw for _, raw in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        done = 0
        while done < len(texts):
            cut, n = [], 0
            while done + len(cut) < len(texts) and n < 2_000_000:  # pieces held at a time
                cut.append(self.cut(texts[done + len(cut)]))
                n += len(cut[-1])
            if len(self.known) > KEPT_PIECES:
                self.known.clear()
            self.learn(set().union(*cut).difference(self.known))
            out += [b"".join(map(self.known.__getitem__, c)) for c in cut]
            done += len(cut)
        return out

    def decode(self, codes: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(codes, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit). The vocabulary is a path that every worker has; None: the default's."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary or public_tokenizers.path(DEFAULT), pattern)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(bpe.encode(texts_of(batch, text_col)), pa.binary())], names=[id_col, "ids"])

    return arrow_map(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids binary")


def decoded(codes: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """codes with the column decoded (binary), from ids."""
    schema = codes.schema

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary or public_tokenizers.path(DEFAULT), pattern)
        back = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, "decoded"])

    return arrow_map(codes, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "decoded binary"]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, and decoded from the ids alone."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary or public_tokenizers.path(DEFAULT), public_tokenizers.PATTERN)
        codes = bpe.encode(texts_of(batch, text_col))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array([sha(c) for c in codes], pa.string()), pa.array([sha(bpe.decode(c)) for c in codes], pa.string())],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return arrow_map(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
