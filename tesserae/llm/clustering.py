"""Centroid clustering of integer vectors with partial-distance search.

Components become integers, so every sum, distance and tie is exact and no result depends on the order of rows. A vector
meets the centroids over the dimensions of largest variance first; a centroid whose part of the squared distance is
strictly above the best whole distance so far is abandoned, and the others go through all dimensions.

Each round is one scan: tasks assign their vectors and return one sum per centroid, which Spark adds up. The driver holds
the centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize

#: Dimensions between two looks at the partial distance, and vectors that are compared at once.
STEP, BLOCK = 8, 2048
#: Squared distances of components within this bound fit a long.
LARGEST = 1 << 27


def kept(vector: str, dims: int):
    """Vectors of exactly `dims` components, none of them null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def quantised(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components as floor(scale * x))."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(x[fine] * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} in units of 1/{scale}: squared distances would not fit a long")
    return rows[fine], x.astype(np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; of equally near ones the smaller number."""
    v, c = v[:, order], centroids[:, order]
    part = np.square(v[:, None, :step] - c[None, :, :step]).sum(axis=2)
    guess = part.argmin(axis=1)
    best = np.square(v - c[guess]).sum(axis=1)
    row, at = np.nonzero(part <= best[:, None])
    part = part[row, at]
    for lo in range(step, v.shape[1], step):
        part = part + np.square(v[row, lo : lo + step] - c[at, lo : lo + step]).sum(axis=1)
        go = part <= best[row]
        row, at, part = row[go], at[go], part[go]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    best = np.minimum.reduceat(part, starts) if len(row) else best  # the guess itself always gets here
    hit = np.flatnonzero(part == best[row])
    return at[hit[np.unique(row[hit], return_index=True)[1]]], best


def _blocks(batches, vector: str, dims: int, scale: int):
    for b in batches:
        rows, v = quantised(b.column(vector), dims, scale)
        for lo in range(0, len(rows), BLOCK):
            yield b, rows[lo : lo + BLOCK], v[lo : lo + BLOCK]


def _spread(vector: str, dims: int, scale: int):
    """Rows, sums and sums of squares of each dimension, one row per task and dimension."""

    def total(batches):
        n, s, ss = 0, np.zeros(dims), np.zeros(dims)
        for _, rows, v in _blocks(batches, vector, dims, scale):
            n, s, ss = n + len(rows), s + v.sum(axis=0), ss + np.square(v.astype(np.float64)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, float(n))), pa.array(s), pa.array(ss)], ["dim", "n", "s", "ss"])

    return total


def _summer(vector: str, dims: int, scale: int, centroids: np.ndarray, order: np.ndarray):
    """Rows and sums of each centroid's vectors, one row per task, centroid and dimension."""

    def total(batches):
        n, s = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, _, v in _blocks(batches, vector, dims, scale):
            at = nearest(v, centroids, order)[0]
            n += np.bincount(at, minlength=len(n))
            for k in np.unique(at):
                s[k] += v[at == k].sum(axis=0)
        k = np.repeat(np.flatnonzero(n), dims)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (k, np.tile(np.arange(dims), len(k) // dims), n[k], s[n > 0].ravel()))], ["cluster", "dim", "n", "s"])

    return total


def _assigner(vec_id: str, vector: str, dims: int, scale: int, centroids: np.ndarray, order: np.ndarray):
    def assign(batches):
        for b, rows, v in _blocks(batches, vector, dims, scale):
            at, far = nearest(v, centroids, order)
            yield pa.RecordBatch.from_arrays([b.column(vec_id).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return assign


def first_centroids(vectors: DataFrame, n: int, vec_id: str, vector: str, dims: int, scale: int, seed: int) -> np.ndarray:
    """The n kept vectors of the smallest sha256 of `seed:<vec_id>`; null ids come last, equal ids by their components."""
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(kept(vector, dims)).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256).alias("h"), ints.alias("v"))
    return np.array([r["v"] for r in rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(n).collect()], np.int64).reshape(-1, dims)


def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid.

    Vectors of another length or with a null, NaN or infinite component are left out, null vectors as well. Components are
    floor(scale * x). Centroids start as `first_centroids`; a round replaces every non-empty one by the floor of its
    vectors' mean. With fewer kept vectors than clusters there are as many centroids as vectors; equal centroids stay
    apart and the smaller number takes the vectors. An empty table gives no rows. Repeated ids are vectors of their own;
    other columns are not read. Components beyond 2**27 are refused with an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    shape = ("embedding", dims, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, clusters, "vec_id", *shape, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    spread = rows.select("embedding").mapInArrow(_spread(*shape), "dim long, n double, s double, ss double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).collect()
    wide = {r["dim"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in spread}
    order = np.array(sorted(wide, key=lambda d: (-wide[d], d)), np.int64)
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_summer(*shape, centroids, order), "cluster long, dim long, n long, s long")
        sums = sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in sums.collect():  # clusters * dims
            centroids[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    assigned = materialize(rows.mapInArrow(_assigner("vec_id", *shape, centroids, order), f"vec_id {kind}, cluster int, distance long"), "assigned-vectors")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(k, inertia.get(k, 0), sum(inertia.values()), digest(c), c) for k, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
