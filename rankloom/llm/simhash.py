"""Operator 9, SimHash near-duplicates by covering locality-sensitive hashing.

Bit masks from a linear code: bit i gets a nonzero vector phi(i) of r + 1 bits, and mask v (one for each nonzero
vector) keeps bit i if phi(i).v is odd. The differing bits of a pair within radius r span at most r dimensions, so
some v is orthogonal to all of them: that mask drops every differing bit and the pair meets there, without fail.

Equal fingerprints are one node from the start. A bucket is never expanded into its pairs: each task emits a spanning
forest of the links it finds. Buckets above BUCKET_ROWS are dealt anew by finer masks (the free bits in r + 1 blocks,
of which one must agree), so that what meets in one task is bounded by the bits left free, not by the data.

The pipeline's stage takes these links, of any size of text, and adds those of similar_components to texts of a similarity of
0.8 or more, beyond the reach of any radius: MinHash proposes, whole texts confirm.

Defined cases: null or wordless text has fingerprint 0 and links like any other; fewer than three words are one
shingle; repeated rows and ties share a component. A row without an id links like any other, also between rows that have
one, but never names a component unless no row of it has an id (then null). An empty table gives an empty result. Columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, texts_of, unused, written
from .components import components

RADIUS, BITS = 3, 64
#: Words of a shingle of operator 9's fingerprints.
NEAR_SHINGLE = 3
#: For texts of this similarity or more. SimHash does not bring them together: at 0.8, 64-bit fingerprints differ in about 10
#: bits, beyond any radius that masks can cover. MinHash proposes the pairs: BANDS keys of BAND_ROWS minima each, of which a
#: pair at 0.8 shares one with a chance of 0.99993.
SIMILARITY, BANDS, BAND_ROWS = 0.8, 24, 5
#: Texts, and shingles of them, of a slot: the part of a bucket that one group of a task holds, about.
SLOT_TEXTS, SLOT_SHINGLES = 512, 200_000
#: Distinct fingerprints of a bucket that one task compares as they stand.
BUCKET_ROWS = 2000


def shingle_hashes(text: str, size: int = 3) -> list[int]:
    words = text.encode().lower().split()  # bytes: only A-Z, and only the six spaces
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    flat = b" ".join(words)
    ends, at = [], 0
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest, starts = xxhash.xxh64_intdigest, [0, *ends]
    return [digest(flat[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts_of(batch, text_col)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps)], names=["id", "fp"])

    return arrow_map(docs.select(id_col, text_col), make, f"id {kind}, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS, parts: int = 1) -> list[int]:
    """One mask for each part of the bits and each nonzero v of radius // parts + 1 bits: of the bits in which a pair
    differs, one of the parts holds no more than radius // parts. One part has the longest keys, more have fewer masks."""
    n, out = 1 << (radius // parts + 1), []
    for part in range(parts):
        phi = {i: k % (n - 1) + 1 for k, i in enumerate(range(part, bits, parts))}
        out += [sum(1 << i for i in phi if (phi[i] & v).bit_count() & 1) for v in range(1, n)]
    return out


def finer_masks(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The mask with one of radius + 1 blocks of its free bits each: a pair within the radius agrees on one of them."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return sorted({mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within the radius, each node expanded once; an edge goes to its tree's first node."""
    left = np.arange(len(fp))
    while len(left):
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            now = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[now]) <= radius
            for j in left[near]:
                yield first, j
                todo.append(j)
            left = left[~near]


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """rows (mask, key, fp) -> links (a, b) of fingerprints, from rows dealt and sorted by (mask, key)."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, at = [], None

        def flush() -> pa.RecordBatch | None:
            fp = np.concatenate(kept)
            edges = list(_spanning(fp.view(np.uint64), radius))
            return pa.RecordBatch.from_arrays([pa.array(fp[[e[k] for e in edges]]) for k in (0, 1)], names=["a", "b"]) if edges else None

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (np.asarray(batch.column(c)) for c in ("mask", "key", "fp"))
            cuts = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1), len(mask)]
            for i, j in zip(cuts, cuts[1:]):
                if at != (mask[i], key[i]):
                    if kept and (out := flush()) is not None:
                        yield out
                    kept, at = [], (mask[i], key[i])
                kept.append(fp[i:j].astype(np.int64))
        if kept and (out := flush()) is not None:
            yield out

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a bigint, b bigint")


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, levels: int = 3) -> DataFrame:
    """nodes (fp), distinct -> links (a, b) of fingerprints that connect whatever is connected within the radius."""
    masks = [_signed(m) for m in covering_masks(radius)]
    rows = nodes.select(F.explode(F.array(*(F.lit(m) for m in masks))).alias("mask"), "fp")
    found = None
    known = set(covering_masks(radius))
    for level in range(levels):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = written(rows.join(sizes, ["mask", "key"]), "buckets")
        last = level == levels - 1
        here = bucket_links(met.filter(F.lit(True) if last else F.col("n") <= bucket_rows).drop("n"), radius)
        found = here if found is None else found.union(here)
        hot = met.filter(F.col("n") > bucket_rows)
        if last or hot.isEmpty():
            break
        finer = {m: finer_masks(m, radius) for m in known}
        known = {x for v in finer.values() for x in v}
        choice = F.create_map(*(x for m, v in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in v)))))
        rows = hot.select(F.explode(F.element_at(choice, F.col("mask"))).alias("mask"), "fp")
    return found


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = written(near_links(nodes.select("fp"), radius, bucket_rows), "links")
    named = _named(nodes, "fp", components(links))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), _hexed(F.col("fp")).alias("fingerprint"), "component_id")


def _hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _named(nodes: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, component_id): nodes (key, least id) take the least id of their component."""
    rooted = nodes.join(roots.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("root", key).alias("root"))
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")  # a table, so that a large component's rows can be split
    return rooted.join(names, "root").select(key, "component_id")


_rng = np.random.default_rng(42)
_SEEDS, _FACTORS = (_rng.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32) for _ in range(2))
_FACTORS |= np.uint32(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: hashes of BAND_ROWS minima each, over 32 bits of the hashes. No shingles have no keys."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max)
    for i in range(0, len(half), 1024):
        np.minimum(least, ((half[i : i + 1024] ^ _SEEDS) * _FACTORS).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), band) for band, m in enumerate(least.reshape(BANDS, -1))], np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, linked: int | None = None) -> DataFrame:
    """(id, th, fp, content, size, keys, near) of every whole text: th is the text's hash, content a hash of its set of shingles, of
    which there are size, keys are its bands, near is the fingerprint by shingles of ``linked`` words, if any."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, content, size, keys, near = [], [], [], [], []
        for text in texts_of(batch):
            near.append(None if linked is None else int(np.uint64(fingerprint(shingle_hashes(text, linked))).view(np.int64)))
            h = shingle_hashes(text, shingle)
            own = np.unique(np.array(h, np.uint64))
            fps.append(fingerprint(h))
            content.append(xxhash.xxh64_intdigest(own.tobytes()))
            size.append(len(own))
            keys.append(band_keys(own))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, content)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *longs, pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(near, pa.int64())], names=["id", "th", "fp", "content", "size", "keys", "near"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"id {kind}, th bigint, fp bigint, content bigint, size bigint, keys array<bigint>, near bigint")


def fingerprint_links(rows: DataFrame, radius: int) -> DataFrame:
    """rows (content, near) -> links (a, b) of contents that connect what has equal fingerprints or some within the radius."""
    rows = written(rows.distinct(), "prints")
    nodes = written(rows.groupBy(F.col("near").alias("fp")).agg(F.min("content").alias("node")), "nodes")
    named = lambda c: nodes.select(F.col("fp").alias(c), F.col("node").alias(f"of_{c}"))
    equal = rows.join(named("near"), "near").select(F.col("of_near").alias("a"), F.col("content").alias("b"))
    close = near_links(nodes.select("fp"), radius).join(named("a"), "a").join(named("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return equal.union(close).filter("a <> b").distinct()


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """For each sorted set in left, which sets in right have this Jaccard similarity or more: shared members are counted
    over an index of right."""
    sizes = np.array([len(x) for x in right], np.int64)
    flat, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    value, first, times = np.unique(flat[order], return_index=True, return_counts=True)
    for x in left:
        shared = np.zeros(len(right), np.int64)
        if len(value) and len(x):
            at = np.searchsorted(value, x)
            at[at == len(value)] = 0
            at = at[value[at] == x]
            n = times[at]
            shared = np.bincount(owner[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(right))
        yield shared >= similarity * (len(x) + sizes - shared)


def slot_links(rows: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """rows (key, slot, other, asks, content, root) -> links (a, b). In each group (key, slot, other) the texts that ask are held
    against the rest by their sets of shingles; texts of one root are not, and one link for each two roots is enough."""
    bounded_batches(rows.sparkSession)

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        sets: dict[int, np.ndarray] = {c: np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for _, c, _, t in group}
        ask, rest = ([(c, r) for a, c, r, _ in group if a == own] for own in (True, False))
        if not ask or not rest:
            return []
        root: dict[int, int] = {r: r for _, _, r, _ in group}

        def find(r: int) -> int:
            while root[r] != r:
                root[r] = r = root[root[r]]
            return r

        out = []
        for (a, of_a), near in zip(ask, alike([sets[c] for c, _ in ask], [sets[c] for c, _ in rest], similarity)):
            for k in np.flatnonzero(near).tolist():
                b, of_b = rest[k]
                if (x := find(of_a)) != (y := find(of_b)):
                    root[x] = y
                    out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(group) > 1 and (found := links(group)):
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, slot, other, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, slot, other) != at:
                    yield from flush()
                    at, group = (key, slot, other), []
                group.append(tuple(row))
        yield from flush()

    held = rows.join(texts, "content").select("key", "slot", "other", "asks", "content", "root", "text")
    return held.repartition("key", "slot", "other").sortWithinPartitions("key", "slot", "other").mapInArrow(run, "a bigint, b bigint")


def _slots(n: Column, shingles: Column, slot_texts: int) -> Column:
    return F.greatest(F.ceil(n / slot_texts), F.ceil(shingles / SLOT_SHINGLES)).cast("int")


def _slot(slots: Column) -> Column:
    return F.pmod(F.xxhash64("content", F.lit(5)), slots).cast("int")


def _every(slots: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), slots - 1))


def buckets(contents: DataFrame) -> DataFrame:
    """contents (content, size, keys) -> (key, content, size) of the buckets of two or more; of buckets with the same members, one."""
    rows = contents.select(F.explode("keys").alias("key"), "content", "size")
    members = [F.bit_xor(F.xxhash64("content", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *members).filter("n > 1").groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    return rows.join(keys.select("key"), "key")


def similar_links(met: DataFrame, texts: DataFrame, same: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, slot_texts: int = SLOT_TEXTS) -> DataFrame:
    """met (key, content, size) of buckets and texts (content, text) -> (node, root): what pairs in the buckets connect whose
    sets of shingles have the similarity or more, or same (a, b), links that hold anyway.

    First each bucket's texts are held against one of them. Then, where a bucket of three or more is still in pieces, the
    texts outside its largest piece are held against all of it, in slots of bounded size on either side. So every pair
    of a bucket is tested unless it is connected already, and what a task holds does not grow with a bucket."""
    sums = (F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    centres = met.groupBy("key").agg(*sums, F.min("content").alias("centre")).withColumn("slots", _slots(F.col("n"), F.col("shingles"), slot_texts))
    rest = met.join(centres, "key").filter("content <> centre").select("key", _slot(F.col("slots")).alias("slot"), F.lit(0).alias("other"), F.lit(False).alias("asks"), "content", F.col("content").alias("root"))
    ask = centres.select("key", _every(F.col("slots")).alias("slot"), F.lit(0).alias("other"), F.lit(True).alias("asks"), F.col("centre").alias("content"), F.col("centre").alias("root"))
    roots = components(same.union(slot_links(rest.union(ask), texts, similarity, shingle)))

    now = met.join(centres.filter("n > 2").select("key", "n", "shingles", "slots"), "key").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    now = written(now, "rooted")
    parts = now.groupBy("key", "root", "n", "shingles").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("own"))
    open_ = parts.groupBy("key", "n", "shingles").agg(F.max(F.struct("m", "own", "root")).alias("top")).filter("n > top.m")
    open_ = open_.select("key", F.col("top.root").alias("major"), _slots(F.col("n") - F.col("top.m"), F.col("shingles") - F.col("top.own"), slot_texts).alias("asking"))
    both = now.join(open_, "key")
    rest = both.select("key", _slot(F.col("slots")).alias("slot"), _every(F.col("asking")).alias("other"), F.lit(False).alias("asks"), "content", "root")
    ask = both.filter("root <> major").select("key", _every(F.col("slots")).alias("slot"), _slot(F.col("asking")).alias("other"), F.lit(True).alias("asks"), "content", "root")
    links = written(slot_links(rest.union(ask), texts, similarity, shingle), "links")
    return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = 5, slot_texts: int = SLOT_TEXTS, radius: int | None = None) -> DataFrame:
    """(id, th, fp, component) of every row, as a table: th is the text's hash, component one number for the rows whose texts a
    chain of pairs of this similarity or more connects. Equal fingerprints are linked, unverified; with a radius also those of
    near_components within it."""
    rows = written(sketches(docs, id_col, text_col, shingle, None if radius is None else NEAR_SHINGLE), "sketches")
    of_content = rows.groupBy("content").agg(F.min(F.struct("id", "th")).alias("row"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    contents = written(of_content, "contents")
    nodes = contents.groupBy("fp").agg(F.min("content").alias("a"))
    same = contents.join(nodes, "fp").select("a", F.col("content").alias("b")).filter("a <> b")
    if radius is not None:
        same = same.union(fingerprint_links(rows.select("content", "near"), radius))
    met = written(buckets(contents), "buckets")
    wanted = contents.join(met.select("content").distinct(), "content", "left_semi").select("row", "content")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("row"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, "row").groupBy("content").agg(F.first("text").alias("text"))
    roots = similar_links(met, written(texts, "linked"), same, similarity, shingle, slot_texts)
    return written(rows.join(roots.withColumnRenamed("node", "content"), "content", "left").select("id", "th", "fp", F.coalesce("root", "content").alias("component")), "components")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = 5, slot_texts: int = SLOT_TEXTS) -> DataFrame:
    """(id, fingerprint, component_id) as near_components, but of texts whose sets of shingles have this similarity or more."""
    rows = similar_rows(docs, id_col, text_col, similarity, shingle, slot_texts)
    names = written(rows.groupBy("component").agg(F.min("id").alias("component_id")), "names")
    return rows.join(names, "component").select(F.col("id").alias(id_col), _hexed(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = 5, radius: int | None = None) -> DataFrame:
    """One row of docs for each component of similar_rows: that with the smallest id (of several with it, one), or without an
    id where none has one. All columns stay."""
    row = unused(docs, "row")
    rows = similar_rows(docs, id_col, text_col, similarity, shingle, radius=radius).select("component", F.struct(F.col("id").isNull().alias("none"), "id", "th").alias("row"))
    best = written(rows.groupBy("component").agg(F.min("row").alias("best")), "best")  # a table, so that a large component's rows can be split
    lost = rows.join(best, "component").filter("row <> best").select(F.col("row").alias(row)).distinct()
    twice = written(rows.groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(row), "repeated")
    keyed = docs.withColumn(row, F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(text_col).alias("th")))
    left = keyed.join(lost, row, "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, row, "left_anti").union(left.join(twice, row, "left_semi").dropDuplicates([row]))
    return left.select(*docs.columns)
