"""Nearest neighbours by cosine over an inverted file: vectors lie in cells around trained centres, a search looks into few cells.

train      centres by k-means over a sample of at most SAMPLE vectors, chosen by the hash of the id: the only bounded step
index      every vector, as a unit vector with its cell; kept as a table
search     the k nearest of each query: first in the ``probes`` cells nearest to it, then, if exact, in each cell that can still
           hold a nearer one: the angle to a cell's centre less the cell's widest angle bounds the angle to all in it. Without
           exact, that is done only for queries that found fewer than k
within     everything of at least a similarity, from all cells that can hold it

A cell's vectors and queries are dealt into slots of SLOT and QUERIES rows and meet slot by slot in matrix products, so a crowded
cell is no large task. Scores are rounded to DIGITS, ties go to the smaller id.

Vectors that are null, of another length, zero, or hold a null or non-finite number have no row in the index; such queries
find nothing. A query never finds its own id. Other columns can be kept, to search among rows that pass a filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import kept

SAMPLE, ROUNDS, MOST_CELLS, SLOT, QUERIES, DIGITS = 20_000, 8, 4096, 4096, 1024, 6


def units(df: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """df with unit vectors (array<double>) for those that have a direction; other rows go."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    sound = F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0)
    df = df.filter(sound if dims is None else sound & (F.size(vector) == dims))
    return df.withColumn(vector, F.transform(v, lambda x: x / norm))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def train(vectors: DataFrame, id_col: str, vector: str, cells: int | None = None) -> np.ndarray:
    """Unit centres. cells: how many; None: the root of the number of vectors, up to MOST_CELLS. Vectors of the most frequent
    length count (ties: the shortest)."""
    of = vectors.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if of is None:
        return np.zeros((0, 0))
    n = of["count"]
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    rows = units(vectors.filter(share), vector, of["d"]).select(id_col, vector).limit(2 * SAMPLE).collect()  # twice the share at most, whatever the hash does
    x = np.array([r[vector] for r in sorted(rows, key=lambda r: (str(r[id_col]), r[vector]))]).reshape(-1, of["d"])
    if not len(x):
        return np.zeros((0, of["d"]))
    cells = min(cells or max(1, min(MOST_CELLS, round(n**0.5))), len(x))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        best = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, best, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


@dataclass(frozen=True)
class Index:
    """rows: (id, vector, cell, side: cosine to the centre, other columns kept)."""

    rows: DataFrame
    centres: np.ndarray

    def where(self, condition: Column) -> Index:
        return Index(self.rows.filter(condition), self.centres)


def index(vectors: DataFrame, centres: np.ndarray, id_col: str, vector: str, keep: tuple[str, ...] = ()) -> Index:
    dims = centres.shape[1]
    own = units(vectors, vector, dims).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def place(batches):
        for b in batches:
            if b.num_rows and len(centres):
                product = _matrix(b.column("vector"), dims) @ centres.T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(product.argmax(1), pa.int32()), pa.array(product.max(1))], names=[*b.schema.names, "cell", "side"])

    return Index(kept(own.mapInArrow(place, f"{schema}, cell int, side double"), "index"), centres)


def _reach(found: Index) -> tuple[np.ndarray, np.ndarray]:
    """By cell: the widest angle, and how many vectors; -1 and 0 for an empty one."""
    wide, n = np.full(len(found.centres), -1.0), np.zeros(len(found.centres), np.int64)
    for r in found.rows.groupBy("cell").agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        wide[r["cell"]], n[r["cell"]] = np.arccos(np.clip(r["side"], -1, 1)) + 1e-9, r["n"]
    return wide, n


def _chosen(queries: DataFrame, found: Index, choose) -> DataFrame:
    """(query_id, q, cell): choose(cosines to the centres, batch) -> mask of the cells that each query looks into."""
    centres = found.centres
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows or not len(centres):
                continue
            q = b.column("q")
            row, cell = np.nonzero(choose(_matrix(q, centres.shape[1]) @ centres.T, b))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), q.take(take), pa.array(cell, pa.int32())], names=["query_id", "q", "cell"])

    return queries.mapInArrow(run, f"query_id {kind}, q array<double>, cell int")


def _met(asked: DataFrame, found: Index, k: int | None, least: float | None) -> DataFrame:
    """(query_id, id, score) of queries and the vectors of their cells: of each slot the k best, or all of at least ``least``."""
    asked = kept(asked, "asked")
    n_q = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
    n_v = {r["cell"]: r["count"] for r in found.rows.groupBy("cell").count().collect()}
    slots = [(c, -(-n_v[c] // SLOT), -(-n // QUERIES)) for c, n in n_q.items() if c in n_v]
    spark, dims = asked.sparkSession, found.centres.shape[1]
    deal = F.broadcast(spark.createDataFrame(slots, "cell int, slots int, qslots int"))  # a row a cell, MOST_CELLS at most
    of = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(deal, "cell").select("cell", every("slots").alias("slot"), of("query_id", "qslots").alias("qslot"), "query_id", "q")
    right = found.rows.select("cell", "id", "vector").join(deal, "cell").select("cell", of("id", "slots").alias("slot"), every("qslots").alias("qslot"), "id", "vector")
    kinds = asked.schema["query_id"].dataType.simpleString(), found.rows.schema["id"].dataType.simpleString()
    names = ["query_id", "id", "score"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        score = np.round(_matrix(a.column("q"), dims) @ _matrix(b.column("vector"), dims).T, DIGITS) + 0.0 if a.num_rows and b.num_rows else np.zeros((a.num_rows, 0))
        q_ids, v_ids = a.column("query_id").to_pylist(), b.column("id").to_pylist()
        by_id = np.array(sorted(range(len(v_ids)), key=lambda i: (v_ids[i] is None, v_ids[i])), np.int64)
        out: list[tuple] = []
        for i, q in enumerate(q_ids):
            s = score[i][by_id] if len(by_id) else score[i]
            if least is not None:
                near = np.flatnonzero(s >= least)
            else:
                floor = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -2.0
                near = np.flatnonzero(s >= floor)
                near = near[np.argsort(-s[near], kind="stable")]
            got = [(q, v_ids[by_id[j]], float(s[j])) for j in near if v_ids[by_id[j]] != q]
            out += got if least is not None else got[:k]
        arrays = [pa.array([r[c] for r in out], a.schema.field("query_id").type if c == 0 else b.schema.field("id").type if c == 1 else pa.float64()) for c in range(3)]
        return pa.Table.from_arrays(arrays, names=names)

    keys = ["cell", "slot", "qslot"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _queries(queries: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    return kept(units(queries, vector, dims).select(F.col(id_col).alias("query_id"), F.col(vector).alias("q")), "queries")


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(found: Index, queries: DataFrame, id_col: str, vector: str, k: int = 10, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest of each query."""
    own = _queries(queries, id_col, vector, found.centres.shape[1])
    wide, n = _reach(found)

    def probed(product: np.ndarray) -> np.ndarray:
        inside = np.where(n > 0, product, -3.0)
        order = np.argsort(-inside, axis=1, kind="stable")[:, :probes]
        mask = np.zeros(product.shape, bool)
        np.put_along_axis(mask, order, True, axis=1)
        return mask & (n > 0)

    first = kept(_top(_met(_chosen(own, found, lambda product, b: probed(product)), found, k, None), k), "first")
    worst = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("s"))
    state = own.join(worst, "query_id", "left").select("query_id", "q", F.when(F.col("m") >= k, F.col("s")).alias("kth"))
    if not exact:
        state = state.filter("kth is null")

    def others(product: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        kth = np.nan_to_num(b.column("kth").to_numpy(zero_copy_only=False).astype(float), nan=-3.0)
        angle = np.arccos(np.clip(product, -1, 1)) - wide
        most = np.cos(np.clip(angle, 0, np.pi)) + 10.0**-DIGITS  # rounding
        return (n > 0) & ~probed(product) & (most >= kth[:, None])

    more = _met(_chosen(state, found, others), found, k, None)
    return _top(first.drop("rank").unionByName(more), k)


def recall(some: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that some has too; 1 where there are none."""
    hit = exact.select("query_id", "id").join(some.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hit")).first()
    return (hit["hit"] or 0) / hit["n"] if hit["n"] else 1.0


def probes_for(found: Index, queries: DataFrame, id_col: str, vector: str, k: int = 10, goal: float = 0.9, most_queries: int = 200) -> int:
    """The number of cells to look into for a recall of goal, doubled until up to most_queries of the queries reach it against the
    exact search. How many a table needs hangs on its vectors: without structure nearly all."""
    some = kept(queries.orderBy(F.xxhash64(F.col(id_col).cast("string"))).limit(most_queries), "sample")
    exact = kept(search(found, some, id_col, vector, k), "exact")
    probes = 1
    while probes < len(found.centres) and recall(search(found, some, id_col, vector, k, probes, exact=False), exact) < goal:
        probes *= 2
    return min(probes, max(1, len(found.centres)))


def within(found: Index, queries: DataFrame, id_col: str, vector: str, least: float) -> DataFrame:
    """(query_id, id, score) of all that is at least so similar."""
    own = _queries(queries, id_col, vector, found.centres.shape[1])
    wide, n = _reach(found)

    def near(product: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return (n > 0) & (np.cos(np.clip(np.arccos(np.clip(product, -1, 1)) - wide, 0, np.pi)) + 10.0**-DIGITS >= least)

    return _met(_chosen(own, found, near), found, None, least)


def nearest_rounded(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, digits: int) -> DataFrame:
    """(query_id, id, cosine, rank): of every query against every row the k best by the cosine as rounded to ``digits``, ties to the
    smaller id. All pairs are held against each other, in matrix products of SLOT rows by QUERIES queries, of which only the k best of
    each query go on; a zero vector's cosine is 0. Ids are numbers; rows without one, or whose vector is null or holds
    a null, take no part, and only vectors of one length meet."""
    sound = lambda df: df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    own = sound(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = sound(queries).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    slots, qslots = -(-own.count() // SLOT) or 1, -(-asked.count() // QUERIES) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.size("q").alias("dims"), every(slots).alias("slot"), deal("query_id", qslots).alias("qslot"), "query_id", "q")
    right = own.select(F.size("v").alias("dims"), deal("id", slots).alias("slot"), every(qslots).alias("qslot"), "id", "v")

    def unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
        flat = column.combine_chunks()
        m = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [], [], []
        if a.num_rows and b.num_rows and len(a.column("q")[0]):
            ids, q_ids = b.column("id").to_numpy(), a.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            score = np.round(unit(a.column("q"), a.num_rows) @ unit(b.column("v"), b.num_rows)[order].T, digits) + 0.0
            for q, s in zip(q_ids, score):
                s = np.where(ids == q, -np.inf, s)
                near = np.flatnonzero(s >= np.partition(s, max(len(s) - k, 0))[max(len(s) - k, 0)])
                near = near[np.argsort(-s[near], kind="stable")][:k]
                near = near[np.isfinite(s[near])]
                for part, x in zip(out, (np.full(len(near), q), ids[near], s[near])):
                    part.append(x)
        whole = [np.concatenate(x) if x else [] for x in out]
        return pa.Table.from_arrays([pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int64()), pa.array(whole[2], pa.float64())], names=["query_id", "id", "cosine"])

    found = left.groupBy("dims", "slot", "qslot").cogroup(right.groupBy("dims", "slot", "qslot")).applyInArrow(meet, "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
