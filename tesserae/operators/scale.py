"""Centring and scaling: statistics over all atoms or molecules, and the expressions that apply them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.arrays import positive_or_one
from tesserae.functions.rounding import half_away


@dataclass(frozen=True)
class Scales:
    position: float
    force: float
    energy_shift: float
    energy: float

    def row(self) -> dict[str, float]:
        return asdict(self)


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(sizes, values as rows of three, the array) of an Arrow array of vector lists; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(pc.list_flatten(lists)).to_numpy(zero_copy_only=False).astype(float)
    if len(values) != 3 * sizes.sum():
        raise ValueError("a vector has not three components")
    return sizes, values.reshape(-1, 3), lists


def as_lists(values: np.ndarray, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    """Rows of three as vector lists of the given sizes; null where `like` is."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(values) + 1, 3, dtype=np.int32)), pa.array(values.reshape(-1)))
    out = pa.ListArray.from_arrays(pa.array(ends), inner)
    return pc.if_else(like.is_valid(), out, pa.nulls(len(out), out.type)) if like.null_count else out


def centre(values: np.ndarray, sizes: np.ndarray, digits: int = 9) -> np.ndarray:
    """Rows of three less the mean of their molecule: one pass over the atoms."""
    if not len(values):
        return values
    of = np.repeat(np.arange(len(sizes)), sizes)
    mean = np.column_stack([np.bincount(of, values[:, i], len(sizes)) for i in range(3)]) / np.maximum(sizes, 1)[:, None]
    return half_away(values - mean[of], digits)


def with_centred(molecules: DataFrame) -> DataFrame:
    """`molecules` with each one's positions centred inside its row (no shuffle), at nine digits, so that sums in another order end alike."""

    @F.arrow_udf("array<array<double>>")
    def centred(positions: pa.Array) -> pa.Array:
        sizes, values, like = flat(positions)
        return as_lists(centre(values, sizes), sizes, like)

    return molecules.withColumn("positions", centred("positions"))


def with_moments(molecules: DataFrame) -> DataFrame:
    """Per molecule the square sums of the centred positions (p) and of the forces (f), how many components they have (np, nf), and its energy."""

    @F.arrow_udf("p double, np long, f double, nf long")
    def moments(positions: pa.Array, forces: pa.Array) -> pa.Array:
        out = []
        for column, move in ((positions, centre), (forces, lambda v, _: v)):
            sizes, values, _ = flat(column)
            square = (move(values, sizes) ** 2).sum(axis=1)
            out += [pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), square, len(sizes))), pa.array(3 * sizes)]
        return pa.StructArray.from_arrays(out, ["p", "np", "f", "nf"])

    return molecules.select(moments("positions", "forces").alias("m"), "energy").select("m.*", "energy")


def fit_scales(molecules: DataFrame) -> Scales:
    """Root mean squares over all components of the centred positions and of the forces; mean and deviation of the energies.

    One aggregation over whole molecules: nothing is exploded. A scale that is not positive is 1; all are kept to nine digits.
    """
    r = with_moments(molecules).agg(
        positive_or_one(F.sqrt(F.try_divide(F.sum("p"), F.sum("np")))).alias("p"), positive_or_one(F.sqrt(F.try_divide(F.sum("f"), F.sum("nf")))).alias("f"),
        F.avg("energy").alias("m"), positive_or_one(F.stddev_pop("energy")).alias("e"),
    ).first()
    return Scales(*(round(r[c], 9) if r[c] is not None else 0.0 for c in "pfm"), round(r["e"], 9) or 1.0)


def scale_frame(molecules: DataFrame) -> DataFrame:
    """The scales as a one-row table."""
    s = fit_scales(molecules)
    return molecules.sparkSession.createDataFrame([(s.position, s.force, s.energy_shift, s.energy)], "position_scale double, force_scale double, energy_shift double, energy_scale double")


def apply_scales(molecules: DataFrame, scales: Scales) -> DataFrame:
    """Molecules in scaled units: centred positions and forces over their scales, energies shifted and scaled; nine digits."""

    @F.arrow_udf("p array<array<double>>, f array<array<double>>")
    def scaled(positions: pa.Array, forces: pa.Array) -> pa.Array:
        (n, p, p_like), (m, f, f_like) = flat(positions), flat(forces)
        p, f = half_away(centre(p, n) / scales.position), half_away(f / scales.force)
        return pa.StructArray.from_arrays([as_lists(p, n, p_like), as_lists(f, m, f_like)], ["p", "f"])

    rows = molecules.withColumn("__s", scaled("positions", "forces"))
    energy = F.round((F.col("energy") - F.lit(scales.energy_shift)) / F.lit(scales.energy), 9)
    return rows.withColumns({"positions": F.col("__s.p"), "forces": F.col("__s.f"), "energy": energy}).drop("__s")
