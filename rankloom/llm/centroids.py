"""Operator 13, centroid clustering: Lloyd's rounds over integer vectors, with results that are exact and alike on any cluster.

Vectors become integers (floor of 1024 times each component), centroids stay integers (floor of the exact mean). A task
screens its vectors by one float32 matrix product a block. For x and a centroid c let s(c) = |c|^2 - 2 x.c, which orders
centroids as the squared distance does. With u = 2^-24 the product of two rounded vectors of d components, summed in any
order, with or without fused operations, is off by at most g |x| |c|, g = (d + 2) u / (1 - (d + 2) u); so each s(c) lies
in an interval that is known. A centroid whose interval begins above the end of another one is out. Where one centroid is
left, it is the nearest for certain; where intervals overlap, those centroids are held against the vector once more in
64-bit integers, and the smallest number wins a tie.

Each round a task gives one row for each centroid (count and sums), Spark adds them up, and the driver gets k rows. A
common vector is no key of any shuffle. Vectors are written once as integers and read in each round.

Defined cases: a vector counts if it has exactly ``dims`` components, none null or non-finite; others have no row in the
result. Fewer kept vectors than k: as many centroids. No vector: no row. Repeated rows and ids stay, each on its own; of
rows with one id the first seed is the one whose components come first in order. A null id hashes to null: it comes last
as a seed. A centroid without vectors stays where it is. Components beyond LARGEST raise an error: their squared
distances do not fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bounded_batches, written

#: Parts of a unit; the largest integer component, 64 squares of twice of which stay under 2^63.
SCALE, LARGEST = 1024, 1 << 27
#: Vectors of a block of the screen.
BLOCK = 20 * BATCH_ROWS


def integers(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<int>) of the vectors that count."""
    v = F.col(vector_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = (F.size(v) == dims) & ~F.exists(v, odd)
    part = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))
    small = lambda x: F.when(F.abs(part(x)) <= LARGEST, part(x).cast("int")).otherwise(F.raise_error(F.lit("a component beyond 131072: squared distances would not fit 64 bits")).cast("int"))
    return vectors.filter(v.isNotNull() & whole).select(F.col(id_col).alias("id"), F.transform(v, small).alias("v"))


def seeds(kept: DataFrame, k: int, salt: str = "3:") -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    first = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row's nearest centroid, exactly, and how many rows needed integers. x and centroids: int64."""
    d = x.shape[1]
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    square = np.square(centroids).sum(1).astype(np.float64)
    norm = np.sqrt(np.square(x).sum(1).astype(np.float64))
    # the last term covers the float64 steps: squares of up to 2^63, each rounded by a part in 2^53 at most
    slack = 2 * g * (1 + 1e-9) * norm[:, None] * np.sqrt(square) + 2.0**-48 * (square + 2 * np.abs(product))
    s = square - 2 * product
    open_ = s - slack <= (s + slack).min(1)[:, None]
    best = s.argmin(1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    rows, js = np.nonzero(open_[unsure])
    if len(rows):
        exact = np.full((len(unsure), len(centroids)), np.iinfo(np.int64).max)
        step = 1 << 16
        for i in range(0, len(rows), step):
            r, j = rows[i : i + step], js[i : i + step]
            exact[r, j] = np.square(x[unsure[r]] - centroids[j]).sum(1)
        best[unsure] = exact.argmin(1)  # the first of equal distances
    return best, len(unsure)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, int64 matrix) of up to about BLOCK rows."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[pa.Array, np.ndarray]:
        ids, v = (pa.concat_arrays([h.column(c) for h in held]) for c in ("id", "v"))
        return ids, v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids."""
    dims = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x in _blocks(batches, dims):
            best, _ = nearest(x, centroids)
            order = np.argsort(best, kind="stable")
            there, at = np.unique(best[order], return_index=True)
            total[there] += np.add.reduceat(x[order], at, axis=0)
            n += np.bincount(best, minlength=len(centroids))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there], pa.int64()), pa.array(total[there].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = kept.mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in added.collect():  # k x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def _assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance)."""
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, centroids.shape[1]):
            best, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(np.square(x - centroids[best]).sum(1), pa.int64())], names=["id", "cluster", "distance"])

    return kept.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector. An inertia beyond 64 bits is null."""
    bounded_batches(vectors.sparkSession)
    kept = written(integers(vectors, dims, id_col, vector_col), "vectors")
    centroids = seeds(kept, k, salt)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)  # for no rows
    for _ in range(rounds):
        moved = _moved(kept, centroids)
        if (moved == centroids).all():  # and so for ever
            break
        centroids = moved
    rows = written(_assigned(kept, centroids), "assigned")
    long = lambda c: F.expr(f"try_cast({c} as bigint)")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(r["cluster"], r["part"], sum(x["part"] for x in sums), digest(centroids[r["cluster"]])) for r in sums]
    of_cluster = vectors.sparkSession.createDataFrame(known, "cluster int, part decimal(38,0), whole decimal(38,0), centroid_sha256 string")
    of_cluster = of_cluster.select("cluster", long("part").alias("cluster_inertia"), long("whole").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
