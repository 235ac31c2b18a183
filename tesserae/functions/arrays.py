"""Column functions over numbers and arrays that the operators build on. All of them are expressions Catalyst can see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTORS = "array<array<double>>"


def parse_vectors(text: Column) -> Column:
    """A JSON list of number lists, as CSV files carry it; null where the text is not one."""
    return F.from_json(text, VECTORS)


def parse_numbers(text: Column, kind: str = "int") -> Column:
    return F.from_json(text, f"array<{kind}>")


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def significant_1d(x: Column, floor: float = 1e-4) -> Column:
    return F.abs(x) >= floor


def significant_3d(x: Column, y: Column, z: Column, floor: float = 1e-4) -> Column:
    return norm(x, y, z) >= floor


def positive_or_one(scale: Column) -> Column:
    """A scale, or 1 where it is not a positive number (Spark takes NaN for larger than 0)."""
    return F.when((scale > 0) & ~F.isnan(scale), scale).otherwise(F.lit(1.0))


def midpoints(centroids: Sequence[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centroids, centroids[1:], strict=False)]


def grid(x: Column, low: Column, high: Column, cells: int = 1024) -> Column:
    """x on an integer grid between low and high, cut off and not rounded; a span of 0 counts as 1."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    top = cells - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), ((x - low) / span * top).cast("int"))).cast("long")


#: Fixed values: (shift, mask) pairs that spread the low ten bits of a number to every third bit.
SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def spread_bits(x: Column) -> Column:
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """Three ten-bit numbers on one curve."""
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1)).bitwiseOR(F.shiftleft(spread_bits(z), 2))


def json_if_nested(column: str, kind: str) -> Column:
    """Lists, structs and maps as JSON text, anything else as it is."""
    return F.to_json(column).alias(column) if kind.startswith(("array", "struct", "map")) else F.col(column)


def draw(key: Column, seed: int) -> Column:
    """A pseudo-random text that orders rows the same way on every engine and every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
