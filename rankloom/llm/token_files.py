"""Operator 12, token ids in ORC files: integers run-length encoded, row indexes and Bloom filters on document ids.

``write_tokens`` deals the texts by ranges of the document id and sorts them, encodes them in that order, and writes one
file a range: the document id, its ids (array of integers, which ORC run-length encodes), their number, and ``through``,
the number of ids in the file up to the document's end. A stripe holds about STRIPE_BYTES, so that several tasks read one
file; each STRIDE rows have an entry in the row index (least and greatest value of each column) and a Bloom filter of
document ids. So a reader of some ids or of some stretch skips stripes and row groups by their metadata.

Files lie in ascending order of ids: the n-th name holds the n-th range. Where a document starts in the whole sequence is
``through - n_tokens`` and the ids of all files before, which are the greatest ``through`` of each file: a table of one
row a file, for which only that column is read. Nobody encodes twice.

Defined cases: a null text is empty and has the end id alone. Null ids come first. Rows that share an id lie in the order
of their texts' hashes and then of their ids' numbers; equal rows are alike, so their order doesn't matter. A hot id is
dealt over several ranges by the text's hash, and copies of one text by a number that a row's place in the input gives.
No rows: no documents. Other columns are not read. A text is encoded whole, in memory of its own size.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, shared_folder, texts_of, unused

#: Vocabulary and the id that ends each document.
DEFAULT, END = "byte_bpe_50k.json", 2
#: Bytes of a stripe; rows of an entry of the row index; the Bloom filters' share of false positives.
STRIPE_BYTES, STRIDE, FALSE_SHARE = 16 << 20, 1000, 0.01
#: Texts are encoded in lots of about so many characters; a table of one row a file is broadcast up to so many files (about 10 MB).
LOT, MOST_FILES = 1 << 20, 50_000
#: Pieces that a worker keeps; characters of words cut at a time; a space that doesn't stand before something else than white space.
KEPT_PIECES, CHAIN, APART = 600_000, 1 << 17, r" (?:[\s\v\x1c-\x1f\x{85}\p{Z}]|\z)"
#: Bytes of text that are encoded at a time; ids of a batch that goes to the writer.
BLOCK, OUT = 8 << 20, 1 << 20
SCHEMA = "n_tokens bigint, through bigint, ids array<int>"


@lru_cache(maxsize=2)
def tokenizer(path: str, plain: bool = False):
    """plain: strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


def lots(texts: list[str], most: int = LOT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to most characters; a longer text is a range of its own."""
    start = n = 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > most:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters for themselves, the other bytes in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def chained(words: list[str], ids_of, lengths: np.ndarray) -> list[bytes] | None:
    """Ids of each word, with a space before it, as bytes, from the ids of all words in one chain: ids_of(chain), lengths:
    bytes of each id. None if a word's end isn't a token's."""
    ids = np.asarray(ids_of(words), np.uint32)
    ends = np.cumsum(lengths[ids])
    at = np.cumsum([len(w.encode()) + 1 for w in words])
    k = np.searchsorted(ends, at)
    if len(ends) == 0 or k[-1] != len(ends) - 1 or (ends[k] != at).any():
        return None
    raw, cut = ids.astype("<u4").tobytes(), [0, *(4 * (k + 1)).tolist()]
    return [raw[i:j] for i, j in zip(cut, cut[1:])]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] numbers for each i."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - start, n)


class Kept:
    """What was found by word, in two halves: the older one goes when the younger one is full, but for what was used since."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def lacking(self, words: set[str]) -> list[str]:
        """Those that must be put in; the others are in ``young`` from here on."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        new = words.difference(self.young)
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        return list(new.difference(again))


class Words:
    """Ids of whole texts, from what the library's model makes of each distinct piece.

    The byte-level pattern begins a new piece at each space that stands before something else than white space, whatever is
    before it, and merges never leave a piece. So a text in which each space stands before something else is the chain of
    its words, each with the space before it: of a block of texts each distinct word is cut into pieces once, and pieces that
    were met aren't encoded again. Other texts, and those that hold the string of a special token, are encoded whole."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.pieces = self.tokenizer.model, {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)  # that of every byte-level vocabulary of the library
        self.letters = {b: c for c, b in byte_letters().items()}
        kind = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.by_words = type(kind[0]).__name__ == "ByteLevel" and kind[0].use_regex and not kind[0].add_prefix_space and kind[1] is None

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in lots(texts):
            out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        return out

    def _by_pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it: cut into pieces, of which the library's model sees the new ones."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        out: list[bytes] = []
        for a, b in lots(words, CHAIN):
            part = words[a:b]
            pieces = self.pattern.findall(" " + " ".join(part))
            for x in set(pieces).difference(self.pieces):
                self.pieces[x] = np.array([t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
            ids = list(map(self.pieces.__getitem__, pieces))
            # pieces end where words end: sums of letters find the last piece of each
            last = np.searchsorted(np.cumsum(list(map(len, pieces))), np.cumsum(list(map(len, part))) + np.arange(1, len(part) + 1))
            ends = [0, *np.cumsum(list(map(len, ids)))[last].tolist()]
            raw = b"".join(ids)
            out += [raw[i:j] for i, j in zip(ends, ends[1:])]
        return out

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each text's followed by ``end``, and how many each has; a null is empty. Words are numbered
        by Arrow, so that Python sees each distinct one once."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, APART)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        units, n = cut.flatten(), cut.value_lengths().to_numpy()
        first = np.zeros(len(units), bool)
        first[np.cumsum(n) - n] = True  # has no space before it
        numbered = units.filter(pa.array(~first)).dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        # what the texts are made of: words, first words, odd texts as one, the end
        alone = [*units.filter(pa.array(first)).to_pylist(), *texts.filter(pa.array(odd)).to_pylist()]
        ids = [*self._by_pieces(distinct), *self._ids(alone), b"" if end is None else np.array([end], "<u4").tobytes()]
        part = np.empty(len(units), np.int32)
        part[~first] = numbered.indices.to_numpy()
        part[first] = len(distinct) + np.arange(len(n))
        count = np.ones(len(texts), np.int64)
        count[~odd] = n
        ends = np.cumsum(count + 1) - 1
        of = np.full(len(units) + int(odd.sum()) + len(texts), len(ids) - 1, np.int32)
        inner = np.ones(len(of), bool)
        inner[ends] = False
        whole = np.zeros(len(of), bool)
        whole[ends[odd] - 1] = True
        of[inner & ~whole] = part
        of[whole] = len(distinct) + len(n) + np.arange(int(odd.sum()))
        size = np.array(list(map(len, ids)), np.int32) // 4
        flat, long = np.frombuffer(b"".join(ids), "<u4"), size[of]
        reach = np.cumsum(long, dtype=np.int64)
        return flat[spread((np.cumsum(size) - size).astype(np.int64)[of], long)], np.diff(reach[ends], prepend=0)


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    return Words(path)


def gathered(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK bytes of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text_col).nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_bytes(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of numbers with a sum of up to most; a larger one is a range of its own."""
    start = total = 0
    for i, x in enumerate(n.tolist()):
        if i > start and total + x > most:
            yield start, i
            start, total = i, 0
        total += x
    if start < len(n):
        yield start, len(n)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """ORC files of (id, n_tokens, through, ids) at path, in ascending order of id. files: how many at most; None: spark.sql.shuffle.partitions, or as adaptive execution joins them."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col), F.col(text_col))
    th, place = unused(plain, "th", "place")
    keyed = plain.withColumns({th: F.xxhash64(text_col), place: F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))})
    keys = [F.col(id_col).asc_nulls_first(), F.col(th), F.col(place)]
    dealt = keyed.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through = 0
        encoder = words(vocabulary or public_tokenizers.path(DEFAULT))
        for batch in gathered(batches, text_col):
            ids, n = encoder.encode(batch.column(text_col), end)
            ends = np.cumsum(n)
            for a, b in by_bytes(n, OUT):
                base = int(ends[a - 1]) if a else 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends[a:b] - base), pa.int32()), pa.array(ids[base : ends[b - 1]].view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), pa.array(n[a:b]), pa.array(ends[a:b] + through), lists], names=[id_col, "n_tokens", "through", "ids"])
            through += int(n.sum())

    options = {"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": FALSE_SHARE, "orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE_BYTES, "orc.rows.between.memory.checks": 50, "compression": "zstd", "maxRecordsPerFile": 0}
    dealt.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, {SCHEMA}").write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def lookup(spark: SparkSession, path: str, ids: list, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids) of some documents: stripes and row groups without them are skipped by their least and greatest ids and by Bloom filters."""
    return spark.read.orc(path).filter(F.col(id_col).isin(ids)).select(id_col, "n_tokens", "ids")


def file_starts(stored: DataFrame) -> DataFrame:
    """(file, base, total): the ids before each file and in it. Of the files only ``through`` is read."""
    per_file = stored.select(F.col("_metadata.file_path").alias("file"), "through").groupBy("file").agg(F.max("through").alias("total"))
    number = F.regexp_extract("file", r"part-([0-9]+)[^/]*$", 1).cast("long")  # beyond 99999 names are not in order
    ahead = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return per_file.select("file", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"), "total")


def _with_start(stored: DataFrame, base: DataFrame) -> DataFrame:
    own = [c for c in stored.columns if c not in ("n_tokens", "through", "ids")]
    base = F.broadcast(base) if len(stored.inputFiles()) <= MOST_FILES else base  # else the rows are dealt by their file
    placed = stored.withColumn("file", F.col("_metadata.file_path")).join(base.select("file", "base"), "file")
    return placed.select(*own, (F.col("base") + F.col("through") - F.col("n_tokens")).alias("start"), "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of the files at path; start: the ids of all documents before it."""
    stored = spark.read.orc(path)
    return _with_start(stored, file_starts(stored))


def stretch(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(id, start, n_tokens, ids) of the documents that have a place in start <= place < stop of the whole sequence, their ids
    cut to it. Only files that have such places are opened for more than the column ``through``."""
    stored = spark.read.orc(path)
    base = file_starts(stored).filter((F.col("base") < stop) & (F.col("base") + F.col("total") > start))
    files = [r["file"] for r in base.select("file").collect()]
    if not files:
        return _with_start(stored, base).limit(0)
    some = _with_start(spark.read.schema(stored.schema).orc(files), base).filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skip, last = F.greatest(F.lit(start) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    own = [c for c in some.columns if c not in ("start", "n_tokens", "ids")]
    return some.select(*own, (F.col("start") + skip).alias("start"), (last - skip).alias("n_tokens"), F.slice("ids", (skip + 1).cast("int"), (last - skip).cast("int")).alias("ids"))


def checksums(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of rows as read_tokens gives them: the checksum over little-endian unsigned 32-bit ids."""
    kind = rows.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return arrow_map(rows.select(id_col, "start", "ids"), make, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def filed(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every whole text, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/rankloom/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, id_col=id_col, text_col=text_col)
    return checksums(read_tokens(spark, path), id_col)
