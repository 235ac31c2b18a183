"""Residual vector quantisation codebooks, learned level by level.

A level needs the residuals of the one before, so there is one small result per level on the driver (the codebook) and
one aggregation or selection over the residuals; the residuals themselves stay distributed. Training reads a sample of
bounded size, drawn by hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.arrays import draw, grid, midpoints, morton, significant_1d, significant_3d
from tesserae.functions.order import drawn, quantiles
from tesserae.functions.rounding import half_away
from tesserae.sources.shared import written

TRAIN_CAP = 500_000
#: Rows that one task orders.
TASK_ROWS = 1_000_000
#: Of a last digit: what keeps a half from depending on a sum's last bit.
HALF_UP = 0.17


@dataclass(frozen=True)
class Levels1D:
    """Centroids (ascending) and boundaries per level."""

    centroids: tuple[tuple[float, ...], ...]
    bounds: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Levels3D:
    vectors: tuple[tuple[tuple[float, float, float], ...], ...]


def sample_exact(df: DataFrame, key: str, n: int | None, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement by a hash of `key` (all, if there are no more)."""
    return df if n is None else df.where(drawn(df, key, n, seed))


def quantile_centroids(df: DataFrame, column: str, size: int, digits: int = 9) -> list[float]:
    """One level's centroids: zero, and quantiles of what is not near zero; or quantiles of everything if too little is not.

    Halves of the last digit, which interpolation often meets, go up: HALF_UP is added before rounding.
    """
    rows = df.select(F.col(column).alias("r"))
    up = lambda found: [round(x + HALF_UP * 10**-digits, digits) for x in found]
    big = rows.where(significant_1d(F.col("r")))
    less = quantiles(big, "r", [(j + 0.5) / (size - 1) for j in range(size - 1)], least=max(size - 1, 1))[()][0]
    if less:
        return sorted([0.0, *up(less)])
    return up(quantiles(rows, "r", [(j + 0.5) / size for j in range(size)])[()][0] or [0.0] * size)


def scalar_codes(x: np.ndarray, book: Levels1D, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all levels, residual) of a vector. A value on a bound falls to the lower bucket, NaN to the last."""
    codes, r = np.empty((len(x), len(book.centroids)), np.int32), np.array(x, float)
    for level, (c, b) in enumerate(zip(book.centroids, book.bounds, strict=True)):
        codes[:, level] = np.searchsorted(np.array(b, float), r)
        r = half_away(r - np.array(c, float)[codes[:, level]], digits)
    return codes, r


def _coded(column: str, book: Levels1D, residuals: bool) -> Column:
    """A struct of the codes c0, c1, ... and the last residual r: a binary search per value and level, in one Arrow function."""
    levels = len(book.centroids)

    @F.arrow_udf(", ".join([*(f"c{k} int" for k in range(levels)), "r double"]))
    def coded(x: pa.Array) -> pa.Array:
        values, missing = x.to_numpy(zero_copy_only=False).astype(float), x.is_null().to_numpy(zero_copy_only=False)
        if residuals:
            codes, r = scalar_codes(values, book)
        else:
            codes, r = np.column_stack([np.searchsorted(np.array(b, float), values) for b in book.bounds]).astype(np.int32), values
        return pa.StructArray.from_arrays([*(pa.array(codes[:, k], mask=missing) for k in range(levels)), pa.array(r, mask=missing)], [*(f"c{k}" for k in range(levels)), "r"])

    return coded(F.col(column).cast("double"))


def train_1d(df: DataFrame, column: str, levels: int, size: int, key: str | None = None, cap: int | None = None, seed: int = 0) -> Levels1D:
    """Quantile codebooks of a scalar column."""
    rows = (sample_exact(df, key, cap, seed) if key else df).select(F.col(column).alias("r")).where("r IS NOT NULL AND NOT isnan(r)").persist()
    centroids, bounds = [], []
    now, before = rows, None
    for level in range(levels):
        c = quantile_centroids(now, "r", size)  # its first job fills the cache of `now`
        if before:
            before.unpersist()
        b = midpoints(c)
        centroids.append(tuple(c))
        bounds.append(tuple(b))
        if level < levels - 1:
            now, before = now.select(_coded("r", Levels1D((tuple(c),), (tuple(b),)), True)["r"].alias("r")).persist(), now
    now.unpersist()
    return Levels1D(tuple(centroids), tuple(bounds))


def encode_1d(df: DataFrame, column: str, book: Levels1D, prefix: str = "c", residual: str | None = None) -> DataFrame:
    """`df` with one code column per level (and the last residual). Null stays null."""
    out = df.withColumn("__e", _coded(column, book, True))
    out = out.withColumns({f"{prefix}{level}": F.col(f"__e.c{level}") for level in range(len(book.centroids))})
    return (out.withColumn(residual, F.col("__e.r")) if residual else out).drop("__e")


def encode_1d_plain(df: DataFrame, column: str, book: Levels1D, prefix: str = "c") -> DataFrame:
    """Every level's code of the raw value, without taking residuals."""
    out = df.withColumn("__e", _coded(column, book, False))
    return out.withColumns({f"{prefix}{level}": F.col(f"__e.c{level}") for level in range(len(book.bounds))}).drop("__e")


def decode_1d(codes: list[Column], book: Levels1D) -> Column:
    parts = [F.get(F.array(*(F.lit(x) for x in c)), code) for code, c in zip(codes, book.centroids, strict=True)]
    return sum(parts[1:], parts[0])


def with_morton(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Rows with their place `mc` on the Morton curve through the bounding box of all rows, which is one broadcast row."""
    box = df.agg(*(f(c).alias(f"__{n}{c}") for c in (x, y, z) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cell = lambda c: grid(F.col(c), F.lit(box[f"__lo{c}"]), F.lit(box[f"__hi{c}"]))
    return df.withColumn("mc", morton(cell(x), cell(y), cell(z)))


def pick_ranks(df: DataFrame, order: list[str], ranks: list[int], spread: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows at the given ranks (from 0) of the order, with column `rank`. The order columns together are taken to be unique.

    The first order column (a long) is cut into cells; their counts tell which cells hold a wanted rank, and only those
    rows go on. They are dealt by ranges of the whole order, so equal values of its first columns are split as well: a
    task orders about `task_rows` rows, however many share a cell.
    """
    spark = df.sparkSession
    cell = (F.col(order[0]) if spread is None else F.floor(F.col(order[0]) / spread)).alias("__cell")
    cells = df.withColumn("__cell", cell)
    counts = cells.groupBy("__cell").agg(F.count("*").alias("n"))
    starts = counts.select("__cell", (F.sum("n").over(Window.orderBy("__cell")) - F.col("n")).alias("__s"), "n")
    wanted = spark.createDataFrame([(r,) for r in sorted(set(ranks))], "rank long")
    # A codebook's ranks at most: K rows.
    hit = starts.join(F.broadcast(wanted), (F.col("rank") >= F.col("__s")) & (F.col("rank") < F.col("__s") + F.col("n"))).groupBy("__cell").agg(F.first("__s").alias("s"), F.first("n").alias("n"), F.collect_list("rank").alias("ranks"))
    places, inside = {}, 0  # place among the rows of hit cells -> rank
    hits = hit.orderBy("__cell").collect()
    for h in hits:
        places.update({inside + r - h["s"]: r for r in h["ranks"]})
        inside += h["n"]
    if not hits:
        return df.withColumn("rank", F.lit(0).cast("long")).limit(0)
    dealt = cells.where(F.col("__cell").isin([h["__cell"] for h in hits])).drop("__cell").repartitionByRange(-(-inside // task_rows), *order).sortWithinPartitions(*order)
    # Numbers say which partition a row is in and where; written once, they cannot change between the two reads.
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked-rows")
    at, found = 0, {}
    for part, n in sorted(tuple(r) for r in dealt.groupBy(F.shiftright("__at", 33)).count().collect()):  # a row per task
        found.update({(part << 33) + place - at: rank for place, rank in places.items() if at <= place < at + n})
        at += n
    picked = spark.createDataFrame(list(found.items()), "__at long, rank long")
    return dealt.join(F.broadcast(picked), "__at").drop("__at")


def morton_vectors(df: DataFrame, size: int, ties: list[str]) -> list[tuple[float, float, float]]:
    """One level's vectors: zero first, then the rows at even quantiles of the Morton order of what is not near zero."""
    big = df.where(significant_3d(F.col("x"), F.col("y"), F.col("z")))
    n, total = big.count(), None
    if n < size - 1:
        big, total, count = df, df.count(), size
        n = total
    else:
        count = size - 1
    if not n:
        return [(0.0, 0.0, 0.0)] * size
    ranks = [int((j + 0.5) / count * (n - 1)) for j in range(count)]
    rows = {r["rank"]: (r["x"], r["y"], r["z"]) for r in pick_ranks(with_morton(big), ["mc", *ties], ranks, 4096).collect()}  # `size` rows
    picked = [rows[r] for r in ranks]
    return picked if total is not None else [(0.0, 0.0, 0.0), *picked]


def _closest(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the closest codeword by squared distance, the lowest index on ties; blocks stay in the processor's cache."""
    out, rows = np.empty(len(vectors), np.int32), max(1, (1 << 16) // max(len(book), 1))
    for k in range(0, len(vectors), rows):
        v = vectors[k : k + rows]
        d = np.zeros((len(v), len(book)))
        for axis in range(book.shape[1]):
            step = v[:, axis, None] - book[None, :, axis]
            d += step * step
        out[k : k + rows] = d.argmin(axis=1)
    return out


class CodeCells:
    """An exact index over a codebook of 3-vectors: boxes of its bounding box, each with the codes that can be closest inside.

    A code whose least distance to a box is beyond another's greatest distance cannot win there. Codes of a box are in
    ascending order, so ties go to the lowest as without the index. Vectors outside all boxes meet the whole book.
    """

    def __init__(self, book: np.ndarray, cells: int = 12):
        self.book, self.cells = book, cells
        low, high = book.min(axis=0), book.max(axis=0)
        pad = np.maximum((high - low) / cells, 1e-9)
        self.low, self.step = low - pad, (high - low + 2 * pad) / cells
        nearest, farthest = [], []
        for axis in range(3):
            a = self.low[axis] + self.step[axis] * np.arange(cells)[:, None]
            c = book[None, :, axis]
            nearest.append(np.square(np.maximum(np.maximum(a - c, c - a - self.step[axis]), 0)))
            farthest.append(np.square(np.maximum(np.abs(a - c), np.abs(a + self.step[axis] - c))))
        box = lambda d: (d[0][:, None, None] + d[1][None, :, None] + d[2][None, None]).reshape(cells**3, -1)
        least, most = box(nearest), box(farthest)
        # A margin for rounding, and for vectors that the division below puts one box off.
        self.able = least <= most.min(axis=1, keepdims=True) * (1 + 1e-6) + 1e-12

    def closest(self, v: np.ndarray) -> np.ndarray:
        at = np.floor((v - self.low) / self.step)
        inside = ((at >= 0) & (at < self.cells)).all(axis=1)
        number = np.where(inside, (np.nan_to_num(at[:, 0], posinf=0, neginf=0) * self.cells + np.nan_to_num(at[:, 1], posinf=0, neginf=0)) * self.cells + np.nan_to_num(at[:, 2], posinf=0, neginf=0), -1).astype(np.int64)
        order = np.argsort(number, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(number[order])) + 1, len(v)]
        out = np.empty(len(v), np.int32)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own, cell = order[lo:hi], number[order[lo]]
            codes = np.flatnonzero(self.able[cell]) if cell >= 0 else np.arange(len(self.book))
            out[own] = codes[_closest(v[own], self.book[codes])]
        return out


@lru_cache(maxsize=64)
def _cells_of(raw: bytes, size: int) -> CodeCells:
    return CodeCells(np.frombuffer(raw).reshape(size, 3))


def nearest(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the closest codeword by squared distance, the lowest index on ties. Large books of 3-vectors are searched through cells."""
    if book.ndim == 2 and book.shape[1] == 3 and len(book) >= 64 and len(vectors) >= 1024 and np.isfinite(book).all():
        return _cells_of(np.ascontiguousarray(book, float).tobytes(), len(book)).closest(vectors)
    return _closest(vectors, book)


def encode_vectors(v: np.ndarray, books: list[np.ndarray], digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all levels, residual) of an (n, 3) array."""
    codes, r = np.empty((len(v), len(books)), np.int32), np.array(v, float)
    for level, book in enumerate(books):
        codes[:, level] = nearest(r, book)
        r = half_away(r - book[codes[:, level]], digits)
    return codes, r


def encode_3d(df: DataFrame, book: Levels3D, keep_residual: bool = False, keep_squares: bool = False) -> DataFrame:
    """`df` (columns x, y, z) with `codes`, one per level; if asked, the last residual in rx, ry, rz, and `squares`, each level's squared residual.

    One Arrow batch function for all levels.
    """
    books = [np.array(b, float) for b in book.vectors]
    levels = len(books)

    @F.arrow_udf("codes array<int>, rx double, ry double, rz double, squares array<double>")
    def coded(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        v = np.column_stack([a.to_numpy(zero_copy_only=False).astype(float) for a in (x, y, z)])
        codes, r, squares = np.empty((len(v), levels), np.int32), v, np.empty((len(v), levels))
        for k in range(levels):
            one, r = encode_vectors(r, books[k : k + 1])
            codes[:, k], squares[:, k] = one[:, 0], (r * r).sum(axis=1)
        ends = pa.array(np.arange(0, len(v) * levels + 1, levels, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(a.reshape(-1))) for a in (codes, squares)]
        return pa.StructArray.from_arrays([lists[0], *(pa.array(r[:, i]) for i in range(3)), lists[1]], ["codes", "rx", "ry", "rz", "squares"])

    out = df.withColumn("__e", coded("x", "y", "z")).withColumn("codes", F.col("__e.codes"))
    if keep_residual:
        out = out.withColumns({c: F.col(f"__e.{c}") for c in ("rx", "ry", "rz")})
    return (out.withColumn("squares", F.col("__e.squares")) if keep_squares else out).drop("__e")


def train_3d(df: DataFrame, levels: int, size: int, ties: list[str], cap: int | None = None, seed: int = 0, method: str = "quantile") -> Levels3D:
    """Codebooks of 3-vectors (columns x, y, z; `ties` break equal curve places): Morton quantiles or k-means."""
    rows = df if cap is None else sample_exact(df, ties[0], cap, seed)
    now = rows.select("x", "y", "z", *ties).persist()
    books: list[tuple] = []
    for level in range(levels):
        book = morton_vectors(now, size, ties) if method == "quantile" else kmeans_vectors(now, ["x", "y", "z"], size, seed + level)
        books.append(tuple(map(tuple, book)))
        if level == levels - 1:
            break
        after = encode_3d(now, Levels3D((books[-1],)), keep_residual=True).select(F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rz").alias("z"), *ties).persist()
        after.count()
        now.unpersist()
        now = after
    now.unpersist()
    return Levels3D(tuple(books))


def decode_3d(codes: Column, book: Levels3D) -> Column:
    """The sum of a row's codewords as array<double>."""
    axis = lambda level, i: F.array(*(F.lit(float(v[i])) for v in book.vectors[level]))
    return F.array(*(sum((F.get(axis(level, i), F.get(codes, F.lit(level))) for level in range(1, len(book.vectors))), F.get(axis(0, i), F.get(codes, F.lit(0)))) for i in range(3)))


def _points(columns: list[str]):
    return lambda b: np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _lloyd(columns: list[str], centres: dict[int, np.ndarray], far: int):
    """Per task, run and code: rows, whole nine-digit sums and cost; and the `far` rows that lie farthest from their centre (code -1)."""
    points, dims = _points(columns), len(columns)

    def step(batches):
        n = {r: np.zeros(len(c), np.int64) for r, c in centres.items()}
        sums = {r: np.zeros((len(c), dims), np.int64) for r, c in centres.items()}
        cost = dict.fromkeys(centres, 0.0)
        apart: dict[int, tuple] = {r: (np.zeros(0), np.zeros((0, dims))) for r in centres}
        for b in batches:
            v = points(b)
            whole = np.round(v * 1e9).astype(np.int64)
            for r, c in centres.items():
                code = nearest(v, c)
                d = np.square(v - c[code]).sum(axis=1)
                n[r] += np.bincount(code, minlength=len(c))
                for i in range(dims):
                    np.add.at(sums[r][:, i], code, whole[:, i])
                cost[r] += float(d.sum())
                d, w = np.r_[apart[r][0], d], np.r_[apart[r][1], v]
                keep = np.lexsort((*w.T[::-1], -d))[:far]
                apart[r] = d[keep], w[keep]
        for r, c in centres.items():
            d, w = apart[r]
            rows = {"run": np.full(len(c) + len(d), r), "code": np.r_[np.arange(len(c)), np.full(len(d), -1)], "n": np.r_[n[r], np.zeros(len(d), np.int64)], "cost": np.r_[[cost[r]], np.zeros(len(c) - 1), d]}
            rows |= {f"s{i}": np.r_[sums[r][:, i], np.round(w[:, i] * 1e9).astype(np.int64)] for i in range(dims)}
            yield pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in rows.items()})

    return step


def lloyd_step(points: DataFrame, columns: list[str], centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One step of several k-means runs in one job: each run's next centres (nine digits) and the cost of its present ones.

    A centre without rows moves to the row that lies farthest from its own centre, the next one to the next such row.
    Sums are whole numbers, so a step does not depend on how rows are dealt.
    """
    size, dims = max(map(len, centres.values())), len(columns)
    sums = ", ".join(f"s{i} long" for i in range(dims))
    made = points.select(*columns).mapInArrow(_lloyd(columns, centres, size), f"run long, code long, n long, cost double, {sums}")
    near = made.where("code >= 0").groupBy("run", "code").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
    # The farthest rows of each task are `size` at most; of them the farthest `size` of all are kept.
    last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("cost"), *(f"s{i}" for i in range(dims))))
    far = made.where("code < 0").withColumn("nth", last).where(F.col("nth") <= size).select("run", (-F.col("nth")).alias("code"), F.lit(0).cast("long").alias("n"), "cost", *(F.col(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(dims)))
    found: dict[tuple[int, int], tuple] = {(r["run"], r["code"]): r for r in near.unionByName(far).collect()}  # 2 * runs * size rows
    out = {}
    for run, c in centres.items():
        after, nth = np.array(c, float), 0
        for code in range(len(c)):
            r = found.get((run, code))
            if r and r["n"]:
                after[code] = [round(int(r[f"s{i}"]) / r["n"] / 1e9, 9) for i in range(dims)]
            else:
                nth += 1
                if (other := found.get((run, -nth))) and other["cost"] > 0:
                    after[code] = [int(other[f"s{i}"]) / 1e9 for i in range(dims)]
        out[run] = after, sum(r["cost"] for (x, code), r in found.items() if x == run and code >= 0)
    return out


def digest_seeds(df: DataFrame, columns: list[str], key: list[str], size: int, seed: int, restarts: int) -> dict[int, np.ndarray]:
    """Start centres: for each run the `size` rows whose keys have the smallest seeded digests. A top-k per run, no order of all rows."""
    out = {}
    for r in range(restarts):
        first = df.orderBy(draw(F.concat_ws(":", *key), seed + r)).limit(size).select(*columns).collect()
        out[r] = np.array([tuple(x) for x in first], float).reshape(-1, len(columns))
    return out


def _farness(columns: list[str], centres: dict[int, np.ndarray], seed: int, take: int):
    """Per task and run the `take` rows that win a race of exponential draws over their squared distance: D-squared sampling."""
    points = _points(columns)

    def race(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        best: dict[int, tuple] = {r: (np.zeros(0), np.zeros((0, len(columns)))) for r in centres}
        for b in batches:
            v = points(b)
            for r, c in centres.items():
                d = np.square(v - c[nearest(v, c)]).sum(axis=1) if len(c) else np.ones(len(v))
                with np.errstate(divide="ignore"):
                    t = np.where(d > 0, rng.exponential(size=len(v)) / d, np.inf)
                t, w = np.r_[best[r][0], t], np.r_[best[r][1], v]
                keep = np.argsort(t, kind="stable")[:take]
                keep = keep[np.isfinite(t[keep])]
                best[r] = t[keep], w[keep]
        for r, (t, w) in best.items():
            yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(t), r)), "t": pa.array(t), **{f"s{i}": pa.array(w[:, i]) for i in range(len(columns))}})

    return race


def spread_seeds(points: DataFrame, columns: list[str], size: int, seed: int, restarts: int, rounds: int = 4) -> dict[int, np.ndarray]:
    """Start centres of all runs in a few passes: each adds rows drawn by their squared distance from those before; twice as many as needed are then thinned out.

    Draws follow the seed and the task, so equal inputs in equal partitions start alike.
    """
    names, take = [f"s{i}" for i in range(len(columns))], max(1, -(-2 * size // rounds))
    chosen = {r: np.zeros((0, len(columns))) for r in range(restarts)}
    for k in range(rounds + 1):
        n = 1 if k == 0 else take
        rows = points.select(*columns).mapInArrow(_farness(columns, chosen, seed * 1000 + k, n), f"run long, t double, {', '.join(f'{c} double' for c in names)}")
        nth = F.row_number().over(Window.partitionBy("run").orderBy("t", *names))
        got = rows.withColumn("nth", nth).where(F.col("nth") <= n).collect()  # restarts * take rows
        chosen = {r: np.unique(np.r_[c, np.array([[x[s] for s in names] for x in got if x["run"] == r]).reshape(-1, len(columns))], axis=0) for r, c in chosen.items()}
    out = {}
    for r, c in chosen.items():
        weights, rng = np.ones(len(c)), np.random.default_rng([seed, r])
        picked: list[int] = []
        while len(picked) < min(size, len(c)):  # k-means++ over a few hundred rows
            d = np.square(c[:, None] - c[picked][None]).sum(axis=2).min(axis=1) * weights if picked else weights
            picked.append(int(rng.choice(len(c), p=d / d.sum())))
        out[r] = c[picked]
    return out


def kmeans_vectors(df: DataFrame, columns: list[str], size: int, seed: int, restarts: int = 10, steps: int = 20, seeds: dict[int, np.ndarray] | None = None) -> list[tuple[float, ...]]:
    """Cluster centres of the best of several k-means runs, `size` of them: with fewer distinct points the last one repeats (and is never chosen).

    All runs take each step together, in one job; a run that no longer changes sits out. Without rows all centres are zero.
    """
    points = df.select(*columns).persist()
    centres = seeds if seeds is not None else spread_seeds(points, columns, size, seed, restarts)
    moving, cost = {r: c for r, c in centres.items() if len(c)}, {}
    for _ in range(steps):
        if not moving:
            break
        after = lloyd_step(points, columns, moving)
        cost.update({r: x for r, (_, x) in after.items()})
        centres = centres | {r: c for r, (c, _) in after.items()}
        moving = {r: c for r, (c, _) in after.items() if not np.array_equal(c, moving[r])}
    if moving:
        cost.update({r: x for r, (_, x) in lloyd_step(points, columns, moving).items()})
    points.unpersist()
    if not cost:
        return [(0.0,) * len(columns)] * size
    best = [tuple(map(float, c)) for c in centres[min(cost, key=lambda r: (round(cost[r], 6), r))]]
    return best + best[-1:] * (size - len(best))


def train_1d_kmeans(df: DataFrame, column: str, levels: int, size: int, key: str | None = None, cap: int | None = None, seed: int = 0, restarts: int = 10) -> Levels1D:
    """Scalar codebooks by k-means: centres in ascending order, from a sample of at most `cap` rows drawn by `key`."""
    now = (sample_exact(df, key, cap, seed) if key else df).select(F.col(column).cast("double").alias("r")).where("r IS NOT NULL AND NOT isnan(r)")
    centroids, bounds = [], []
    for level in range(levels):
        c = sorted(x[0] for x in kmeans_vectors(now, ["r"], size, seed + level, restarts))
        b = midpoints(c)
        centroids.append(tuple(c))
        bounds.append(tuple(b))
        now = now.select(_coded("r", Levels1D((tuple(c),), (tuple(b),)), True)["r"].alias("r"))
    return Levels1D(tuple(centroids), tuple(bounds))


def codebook_table(spark: SparkSession, channels: dict[str, Levels1D | Levels3D]) -> DataFrame:
    """Codebooks as rows (channel, level, code, vec): levels * size rows per channel."""
    rows = []
    for name, book in channels.items():
        levels = book.vectors if isinstance(book, Levels3D) else [[(c,) for c in level] for level in book.centroids]
        rows += [(name, i, k, [float(x) for x in v]) for i, level in enumerate(levels) for k, v in enumerate(level)]
    return spark.createDataFrame(rows, "channel string, level int, code int, vec array<double>")


def load_codebooks(table: DataFrame) -> dict[str, Levels1D | Levels3D]:
    """The codebooks of a table of codebook_table: a few thousand rows, read by the driver and sent with the functions that use them."""
    found: dict[str, dict[int, list]] = {}
    for r in table.orderBy("channel", "level", "code").collect():
        found.setdefault(r["channel"], {}).setdefault(r["level"], []).append(tuple(r["vec"]))
    out = {}
    for name, levels in found.items():
        ordered = [tuple(levels[i]) for i in sorted(levels)]
        if len(ordered[0][0]) == 3:
            out[name] = Levels3D(tuple(ordered))
        else:
            flat = tuple(tuple(v[0] for v in level) for level in ordered)
            out[name] = Levels1D(flat, tuple(tuple(midpoints(c)) for c in flat))
    return out
