"""Exact order statistics of distributed numbers.

Counts of equal-width cells tell which cells hold the wanted ranks; only those are cut again, until few rows are left.
A few thousand counts and at most COLLECTED values reach the driver, however many rows there are, and no task orders
or keeps the whole column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.arrays import draw

CELLS, COLLECTED = 4096, 50_000
#: Bits of a digest that a draw looks at first.
PLACE_BITS = 60
#: Size of a quantile sketch, and how far in rank its answers are taken to be off (about its 99 % bound; a miss is noticed).
SKETCH, SKETCH_ERROR = 65_535, 1.5e-4


def order_values(df: DataFrame, column: str, ranks: Callable[[int], Iterable[int]], by: Iterable[str] = ()) -> dict[tuple, tuple[int, dict[int, tuple]]]:
    """Per group of `by`: how many numbers `column` has, and for each wanted rank (from 0; `ranks` of that count) its value and how many are smaller.

    Nulls are left out; NaN counts as larger than any number. Groups are a bounded few: a row of each reaches the driver.
    """
    by = list(by)
    group = [f"__g{i}" for i in range(len(by))]
    now = df.select(*(F.col(c).alias(g) for c, g in zip(by, group, strict=True)), F.col(column).alias("__x")).where("__x IS NOT NULL").persist()
    # A NaN cannot be cut into cells: it keeps its place above all others by its count alone.
    finite = now.where(~F.isnan(F.col("__x").cast("double")))
    total = {tuple(r[:-4]): r[-4:] for r in now.groupBy(*group).agg(F.count("*"), F.count(F.when(~F.isnan(F.col("__x").cast("double")), 1)), F.min("__x"), F.max(F.when(~F.isnan(F.col("__x").cast("double")), F.col("__x")))).collect()}
    out: dict[tuple, tuple[int, dict]] = {g: (n, {}) for g, (n, *_) in total.items()}
    # Open cells: path (group and cell numbers so far) -> (rows, smallest, largest, rows below, wanted ranks).
    cells = {}
    for g, (n, real, lo, hi) in total.items():
        wanted = sorted(set(ranks(n)))
        out[g][1].update({r: (float("nan"), real) for r in wanted if r >= real})
        if wanted and wanted[0] < real:
            cells[g] = real, lo, hi, 0, [r for r in wanted if r < real]
    path, rows = list(group), finite
    while cells:
        for p, (_, lo, hi, below, wanted) in list(cells.items()):
            if lo == hi:
                out[p[: len(by)]][1].update({r: (lo, below) for r in wanted})
                del cells[p]
        if not cells:
            break
        level = f"__c{len(path)}"
        few = sum(c[0] for c in cells.values()) <= COLLECTED or all(float(c[1]) == float(c[2]) for c in cells.values())
        if not path:
            (_, lo, hi, *_), = cells.values()
            inside = rows.withColumns({"__lo": F.lit(float(lo)), "__span": F.lit(float(hi) - float(lo))})
        elif few and not by and len(path) == 1:
            inside = rows.where(F.col(path[0]).isin([p[0] for p in cells]))
        else:
            kinds = ", ".join([*(f"{n}_ {rows.schema[n].dataType.simpleString()}" for n in path), "__lo double", "__span double"])
            table = df.sparkSession.createDataFrame([(*p, float(c[1]), float(c[2]) - float(c[1])) for p, c in cells.items()], kinds)
            inside = rows.join(F.broadcast(table), [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in path]).drop(*(f"{n}_" for n in path))  # a row per open cell
        if few:
            counts = inside.groupBy(*path, F.col("__x").alias("__k")).agg(F.count("*").alias("n"), F.first("__x").alias("lo"), F.first("__x").alias("hi")).collect()
        else:
            at = F.least(F.lit(CELLS - 1), F.floor(F.try_divide(F.col("__x").cast("double") - F.col("__lo"), F.col("__span")) * CELLS)).cast("int")
            rows = inside.withColumn(level, F.coalesce(at, F.lit(0))).drop("__lo", "__span")
            counts = rows.groupBy(*path, level).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")).collect()
        held: dict[tuple, list] = {}
        for r in counts:
            held.setdefault(tuple(r[: len(path)]), []).append(tuple(r[len(path) :]))
        after = {}
        for p, (_, _, _, below, wanted) in cells.items():
            left = list(wanted)
            for k, n, lo, hi in sorted(held.get(p, ()), key=lambda c: c[2]):
                own = [r for r in left if r < below + n]
                if own:
                    after[(*p, k)] = n, lo, hi, below, own
                    left = left[len(own) :]
                below += n
        cells = after
        if not few:
            path = [*path, level]
    now.unpersist()
    return out


def _between(values: list[float], place: float, low: int) -> float:
    """The quantile at `place` between the values of ranks low and low + 1."""
    return values[0] if place == low else (low + 1 - place) * values[0] + (place - low) * values[-1]


def _bracketed(brackets: dict[int, np.ndarray]):
    """Counts of what lies in or between a group's brackets (ascending ends, from, to, from, to...): values inside keep their own row."""

    def count(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            group, x = b.column("g").to_numpy(), b.column("x").to_numpy()
            for g, ends in brackets.items():
                own = np.sort(x[group == g])
                if len(own):
                    cuts = np.r_[0, np.stack([np.searchsorted(own, ends[0::2], "left"), np.searchsorted(own, ends[1::2], "right")], 1).ravel(), len(own)]
                    held.setdefault(g, []).append(np.diff(cuts)[::2])  # what lies before, between and behind the brackets
                    inside = np.concatenate([own[lo:hi] for lo, hi in zip(cuts[1::2], cuts[2::2], strict=False)])
                    value, n = np.unique(inside, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), g)), pa.nulls(len(value), pa.int64()), pa.array(value), pa.array(n)], ["g", "gap", "x", "n"])
        for g, parts in held.items():
            n = np.sum(parts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g)), pa.array(np.arange(len(n))), pa.nulls(len(n), pa.float64()), pa.array(n)], ["g", "gap", "x", "n"])

    return count


def quantiles(df: DataFrame, column: str, at: list[float], by: Iterable[str] = (), least: int = 1, also: Iterable[Column] = ()) -> dict[tuple, tuple[list[float] | None, tuple]]:
    """Per group the exact quantiles, between two values by their distance, and the aggregates `also`; None instead of quantiles for a group of fewer than `least` numbers.

    Two jobs: one aggregation makes `also` and a KLL sketch that brackets every wanted rank; one pass counts exactly what
    lies between the brackets and keeps the values inside. A rank that its bracket misses, or brackets that hold too
    many rows for the driver, fall back on `order_values`. Nulls are left out; NaN counts as larger than any number.
    """
    by, at, also = list(by), list(at), list(also)
    x = F.col(column).cast("double")
    real = F.when(~F.isnan(x), x)
    sketch = F.kll_sketch_agg_double(real, SKETCH)
    ends = [e for p in sorted(at) for e in (max(p - SKETCH_ERROR, 0.0), min(p + SKETCH_ERROR, 1.0))]
    found = df.groupBy(*by).agg(F.count(x).alias("__n"), F.count(real).alias("__real"), sketch.alias("__s"), *also)
    probes = F.when(F.col("__real") > COLLECTED, F.kll_sketch_get_quantile_double("__s", F.array(*map(F.lit, ends)))) if at else F.lit(None)
    first = [tuple(r) for r in found.withColumn("__s", probes).collect()]  # a row per group
    out: dict[tuple, tuple[list[float] | None, tuple]] = {}
    todo, brackets, groups = {}, {}, {}
    for r in first:
        g, n, finite, probed, rest = r[: len(by)], *r[len(by) : len(by) + 3], r[len(by) + 3 :]
        out[g] = None, rest
        if n >= max(least, 1) and at:
            k = len(todo)
            todo[g] = k, n, finite
            groups[k] = g
            edges = np.array(probed if probed is not None else [-np.inf, np.inf])
            joined: list[float] = []  # brackets that meet are one
            for lo, hi in zip(edges[0::2], edges[1::2], strict=True):
                if joined and lo <= joined[-1]:
                    joined[-1] = max(joined[-1], hi)
                else:
                    joined += [lo, hi]
            brackets[k] = np.array(joined)
    if not todo:
        return out
    wide = sum(min(finite, 2 * SKETCH_ERROR * len(at) * finite) if finite > COLLECTED else finite for _, _, finite in todo.values())
    counts: dict[int, list] = {k: [] for k in groups}
    if wide <= 4 * COLLECTED:
        number = F.coalesce(*(F.when(F.lit(True) if not by else reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g, strict=True))), F.lit(k)) for k, g in groups.items()), F.lit(-1))
        rows = df.select(number.cast("long").alias("g"), real.alias("x")).where("x IS NOT NULL AND g >= 0")
        for g, gap, value, n in rows.mapInArrow(_bracketed(brackets), "g long, gap long, x double, n long").groupBy("g", "gap", "x").agg(F.sum("n")).collect():
            # Gap i lies before bracket i, so it sorts by that bracket's lower end, ahead of the values inside.
            counts[g].append((float(brackets[g][2 * gap]) if gap is not None and 2 * gap < len(brackets[g]) else np.inf if gap is not None else value, gap is None, n))
    missed = []
    for g, (k, n, finite) in todo.items():
        own = sorted(counts[k])
        upto = np.cumsum([c[2] for c in own]) if own else np.zeros(0)

        def ranked(r: int, own=own, upto=upto, finite=finite) -> float | None:
            if r >= finite:
                return float("nan")
            i = int(np.searchsorted(upto, r, "right"))
            return own[i][0] if i < len(own) and own[i][1] else None

        made: list[float] = []
        for p in at:
            place, low = (n - 1) * p, int((n - 1) * p)
            values = [ranked(low), ranked(min(low + 1, n - 1))]
            if values[0] is None or (values[1] is None and place != low):
                missed.append(g)
                break
            made.append(float(_between(values, place, low)))
        else:
            out[g] = made, out[g][1]
    if missed:
        ranks = lambda n: [int((n - 1) * p) for p in at] + [min(int((n - 1) * p) + 1, n - 1) for p in at] if n else []
        for g, (n, values) in order_values(df, column, ranks, by).items():
            if g in missed:
                places = [((n - 1) * p, int((n - 1) * p)) for p in at]
                out[g] = [float(_between([values[low][0], values[min(low + 1, n - 1)][0]], place, low)) for place, low in places], out[g][1]
    return out


def drawn(df: DataFrame, key: str, n: int, seed: int = 0) -> Column:
    """Whether a row is among the n that come first by the seeded digest of their key: a filter, whatever n is.

    All rows, where there are no more than n. Keys are taken to be unique; rows of one key stand or fall together.
    Digests spread evenly, so the counts of their first bits are known cells of about equal size: one job counts them
    (and all rows with them), and one takes what is left of n from the cell that holds the n-th.
    """
    if n < 1:
        return F.lit(False)
    digest = draw(F.col(key), seed)
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    cell = lambda bits: F.shiftright(place, PLACE_BITS - bits)
    rows, bits, rest = df.select(F.col(key)), CELLS.bit_length() - 1, n
    while True:
        counts = sorted(tuple(r) for r in rows.groupBy(cell(bits).alias("c")).agg(F.count("*")).collect())
        for at, held in counts:
            if rest <= held:
                break
            rest -= held
        else:
            return F.lit(True)
        rows = rows.where(cell(bits) == at)
        if held <= COLLECTED or bits == PLACE_BITS:
            break
        bits = min(bits + CELLS.bit_length() - 1, PLACE_BITS)
    # The last one drawn: a part of one cell is ordered, or rows that agree in 60 bits, which are a handful.
    last = rows.select(place.alias("p"), digest.alias("d"), F.col(key).alias("k")).orderBy("d", "k").limit(rest).agg(F.max(F.struct("d", "k", "p")).alias("l")).first()["l"]
    own = F.struct(digest.alias("d"), F.col(key).alias("k")) <= F.struct(F.lit(last["d"]).alias("d"), F.lit(last["k"]).alias("k"))
    return (place < last["p"]) | ((place == last["p"]) & own)
