"""Operator 11, alignment of two tokenizers over the same bytes.

Both tokenizers encode the text with a leading space: A as given, B adds the space itself. Where tokens of both end at one
byte the text is cut; what lies between two cuts is a group, and each A token of a group is linked with each B token of it.

A lot of texts is one stretch of bytes: the documents' bytes follow each other, so the running sum of all token lengths
gives ends with the documents' offsets already in them. The ends of A and of B are counted by byte once (bincount), a byte
where both counts are above nought is a cut, and a document's end always is. Running sums of cuts number the groups, and
of groups, tokens and products of tokens give, by differences at the documents' ends, what each document has.

An id pair's count is the number of documents that hold it linked, over the whole corpus:
1. a map writes each document's numbers and its distinct pairs with how often they are linked;
2. Spark counts documents by pair, and finds the highest count of each A id;
3. pairs in more than a 2^-HOT_BITS part of all (document, pair) rows are at most 2^HOT_BITS in number, whatever the corpus:
   their counts go to all tasks as arrays, and a map adds them up within each document. The others meet their counts by
   a join, in which no key has more than that part of the rows.

Defined cases: texts null, empty, or whose joined A or B bytes differ from space and text (as where B's normaliser changes
it) have no tokens: zeros, and '' as digest. Rows count one by one: repeated rows and ids stay, null ids too, and
each counts as a document. An empty table gives an empty result. Other columns are not read. A text is encoded whole, in
memory of its own size; its pairs are made and written in parts of PAIRS, so that a long stretch without a cut, where all A
ids meet all B ids, needs no more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, texts_of, written
from .token_files import Kept, byte_letters, chained, lots, spread, tokenizer

#: Vocabularies.
DEFAULT_A, DEFAULT_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of a part; bits of the number of pairs whose counts go to all tasks.
PAIRS, HOT_BITS = 1 << 21, 17
#: Words of each half of what a worker keeps; characters of words encoded in one chain; a space that doesn't stand between two characters that are no white space.
KEPT_WORDS, CHAIN, CROWDED = 400_000, 1 << 15, re.compile(r"\s |\A | (?:\s|\Z)")
#: A pair is one number: the A id above so many bits, the B id below.
LOW = 32


class Pair:
    """Two tokenizers: ids of texts, the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = tokenizer(path_a, plain=True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_letters()
        self.bytes_a = [bytes(map(byte.__getitem__, self.a.id_to_token(i) or "")) for i in range(self.a.get_vocab_size())]
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # what a token adds to a document's listing, by its separator; B's follow A's
        name = lambda mark, n: [f"{i}{mark}".encode() for i in range(n)]
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.listing = name(",", n_a) + name("|", n_a) + name(",", n_b) + name(";", n_b)
        self.kept = Kept(KEPT_WORDS)
        kind = self.a.pre_tokenizer, self.a.normalizer
        inside = any("▁" in piece(i).lstrip("▁") for i in range(n_b))
        self.by_words = type(kind[0]).__name__ == "ByteLevel" and kind[0].use_regex and kind[1] is None and not inside

    def _ids(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B; None for a text that either doesn't give back."""
        out: list[tuple[bytes, bytes] | None] = []
        for i, j in lots(texts):
            a = self.a.encode_batch_fast([" " + t for t in texts[i:j]], add_special_tokens=False)
            b = self.b.encode(texts[i:j], num_threads=1)
            for t, x, y in zip(texts[i:j], a, b):
                raw, ids = b" " + t.encode(), x.ids
                fits = t and b"".join(map(self.bytes_a.__getitem__, ids)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw
                out.append((np.array(ids, "<u4").tobytes(), np.array(y, "<u4").tobytes()) if fits else None)
        return out

    def _learn(self, words: list[str]) -> None:
        """Words without white space at their ends in chains, others one by one."""
        alone = [w for w in words if w[0].isspace() or w[-1].isspace()]
        rest = list(set(words).difference(alone)) if alone else words
        chain_a = lambda part: self.a.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids
        chain_b = lambda part: self.b.encode(" ".join(part))
        for i, j in lots(rest, CHAIN):
            part = rest[i:j]
            a, b = chained(part, chain_a, self.len_a), chained(part, chain_b, self.len_b)
            raw = (" " + " ".join(part)).encode()
            same = lambda tokens, x: b"".join(map(tokens.__getitem__, np.frombuffer(b"".join(x), "<u4").tolist())) == raw
            fits = a and b and same(self.bytes_a, a) and same(self.bytes_b, b)
            self.kept.young.update(zip(part, zip(a, b) if fits else self._ids(part)))
        self.kept.young.update(zip(alone, self._ids(alone)))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of A and B as little-endian unsigned 32-bit integers; none for a text that either doesn't give back.

        Where each space stands between two characters that are no white space, A begins a new piece at each of them, and
        no piece of B goes on over one (none of its vocabulary has a space after another letter). So a text is the chain
        of its words, each with the space before it, and a word that was met is not encoded again. Other texts, and those with a
        word that isn't given back, are encoded whole."""
        cut = {i: t.split(" ") for i, t in enumerate(texts) if t and self.by_words and not CROWDED.search(t)}
        self._learn(self.kept.lacking(set().union(*cut.values())))
        known = self.kept.young.__getitem__
        found: list[tuple[bytes, bytes] | None] = [None] * len(texts)
        whole = []
        for i in range(len(texts)):
            pairs = list(map(known, cut[i])) if i in cut else [None]
            if None in pairs:
                whole.append(i)
            else:
                found[i] = b"".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])
        for i, x in zip(whole, self._ids([texts[i] for i in whole])):
            found[i] = x
        a, b = zip(*((x or (b"", b"")) for x in found))
        return list(a), list(b)


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _cuts(ends_a: np.ndarray, ends_b: np.ndarray, total: int, block: int = 1 << 22) -> np.ndarray:
    """The bytes where tokens of both end, ascending; ends are counted in blocks of bytes."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, total + 1, block):
        a, b = (e[np.searchsorted(e, lo) : np.searchsorted(e, lo + block)] - lo for e in (ends_a, ends_b))
        out.append(np.flatnonzero((np.bincount(a, minlength=block) > 0) & (np.bincount(b, minlength=block) > 0)) + lo)
    return np.concatenate(out)


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct (group, id), in order."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def aligned(pair: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray | list], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Numbers and digests of each text, and its distinct pairs: (place of the text, pair, how often linked) in parts of about PAIRS."""
    a, b = pair.encode(texts)
    n_a, n_b = (np.array([len(x) // 4 for x in y], np.int64) for y in (a, b))
    a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
    ends_a, ends_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    cuts = _cuts(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    last = np.concatenate([[0], np.cumsum(n_a)])  # of each document among A's tokens
    groups = np.concatenate([[0], group_a + 1])[last] if len(a) else np.zeros(len(texts) + 1, np.int64)
    links = np.concatenate([[0], np.cumsum(in_a * in_b)])[groups]
    # the listing: in each group A's tokens, then B's
    code = np.empty(len(a) + len(b), np.int64)
    size_a, size_b = len(pair.bytes_a), len(pair.bytes_b)
    ends = np.append(group_a[1:] != group_a[:-1], [True] * bool(len(a)))
    code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + size_a * ends
    ends = np.append(group_b[1:] != group_b[:-1], [True] * bool(len(b)))
    code[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * size_a + b + size_b * ends
    at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    code = code.tolist()
    digest = [hashlib.sha256(b"".join(map(pair.listing.__getitem__, code[i:j]))[:-1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]
    numbers = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": np.diff(links), "groups_sha256": digest}

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ga, ia, ca = _distinct(group_a, a, size_a)
        gb, ib, cb = _distinct(group_b, b, size_b)
        per = np.bincount(gb, minlength=len(cuts))
        first = np.cumsum(per) - per
        doc = np.searchsorted(groups, ga, side="right") - 1
        order = np.argsort(doc * size_a + ia, kind="stable")  # all of a document's A id together, so that no pair is in two parts
        ga, ia, ca, doc = (x[order] for x in (ga, ia, ca, doc))
        n = per[ga]
        through = np.cumsum(n)
        fresh = np.flatnonzero(np.diff(doc * size_a + ia)) + 1  # where parts may begin
        i = 0
        while i < len(n):
            reach = int(np.searchsorted(through, (through[i - 1] if i else 0) + PAIRS, side="right"))
            k = np.searchsorted(fresh, max(reach, i + 1), side="right") - 1
            j = int(fresh[k]) if k >= 0 and fresh[k] > i else int(next(iter(fresh[np.searchsorted(fresh, i, side="right") :]), len(n)))
            j = len(n) if reach >= len(n) else j
            take = spread(first[ga[i:j]], n[i:j])
            rep = np.repeat(np.arange(i, j), n[i:j])
            key = (doc[rep] * size_a + ia[rep]) * size_b + ib[take]
            links = ca[rep] * cb[take]
            by = np.argsort(key, kind="stable")
            key, links = key[by], links[by]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key = key[new]
            rest = key // size_b
            yield rest // size_a, (rest % size_a) << LOW | key % size_b, np.add.reduceat(links, new)
            i = j

    return numbers, pairs() if len(a) else iter(())


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def measured(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<bigint>, links array<bigint>): a row for each document, and
    more with null numbers, only to hold pairs, where it has very many of them. row tells documents apart."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "row bigint, id " + kind + ", " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", groups_sha256 string, pairs array<bigint>, links array<bigint>"
    names = ["row", "id", *NUMBERS, "groups_sha256", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(vocabulary_a or public_tokenizers.path(DEFAULT_A), vocabulary_b or public_tokenizers.path(DEFAULT_B))
        for batch in batches:
            texts = texts_of(batch, text_col)
            for i, j in lots(texts):
                numbers, parts = aligned(pair, texts[i:j])
                row, ids = batch.column("row").slice(i, j - i), batch.column(id_col).slice(i, j - i)
                told = [*(pa.array(numbers[c], pa.int64()) for c in NUMBERS), pa.array(numbers["groups_sha256"], pa.string())]
                seen = False
                for doc, key, n in parts:
                    at = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (key, n)]
                    if seen:  # only the documents of this part
                        here = pa.array(np.unique(doc), pa.int64())
                        none = [pa.nulls(len(here), x.type) for x in told]
                        yield pa.RecordBatch.from_arrays([row.take(here), ids.take(here), *none, *(x.take(here) for x in lists)], names=names)
                    else:
                        yield pa.RecordBatch.from_arrays([row, ids, *told, *lists], names=names)
                    seen = True
                if not seen:
                    empty = pa.array([[]] * (j - i), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([row, ids, *told, empty, empty], names=names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text_col))
    return written(numbered.mapInArrow(run, schema), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each id pair linked, and whether no other pair of its A id is in more."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    most = Window.partitionBy(F.shiftright("pair", LOW))  # at most as many rows as B has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(most))


def _summed(found: DataFrame, hot: list) -> DataFrame:
    """(row, pair, links, n_best, count_sum): for each row of found the sums over its hot pairs, with a null pair; and its other
    pairs one by one, with null sums."""
    keys = np.array([r["pair"] for r in hot], np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], np.array([r["n"] for r in hot], np.int64)[order]
    best = np.array([r["best"] for r in hot], bool)[order]
    shared = found.sparkSession.sparkContext.broadcast((keys, counts, best))
    names = ["row", "pair", "links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, lists = batch.column("row"), batch.column("pairs")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            pair, links = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "links"))
            at = np.searchsorted(keys, pair)
            at[at == len(keys)] = 0
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            ends = np.concatenate([[0], np.cumsum(n)])
            part = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]), pa.int64())
            of_hot = lambda x: np.where(known, links * x[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([row, none, none, part(of_hot(best.astype(np.int64))), part(of_hot(counts))], names=names)
            rest = np.flatnonzero(~known)
            if len(rest):
                of = np.repeat(row.to_numpy(zero_copy_only=False), n)
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(of[rest]), pa.array(pair[rest]), pa.array(links[rest]), none, none], names=names)

    return found.select("row", "pairs", "links").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def alignment(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text."""
    found = measured(docs, vocabulary_a, vocabulary_b, id_col, text_col)
    counts = written(pair_counts(found), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = total >> HOT_BITS
    hot = counts.filter(F.col("n") > floor).collect()  # fewer than 2^HOT_BITS
    parts = written(_summed(found, hot), "sums")
    rare = parts.filter("pair is not null").select("row", "pair", "links").join(counts.filter(F.col("n") <= floor), "pair")
    sums = parts.filter("pair is null").select("row", "n_best", "count_sum").unionByName(rare.select("row", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum")))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = found.filter("n_a is not null").select("row", F.col("id").alias(id_col), *NUMBERS, "groups_sha256")
    return told.join(sums, "row").select(id_col, *NUMBERS, "n_best", "count_sum", "groups_sha256")
