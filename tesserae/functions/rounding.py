"""Rounding of NumPy arrays as SQL rounds."""

from __future__ import annotations

import numpy as np


def half_away(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """x at `digits` decimals, halves away from zero (np.round takes them to the even neighbour). NaN, and what is too large to scale, stay."""
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.abs(x) * scale
        low = np.floor(y)
        out = np.copysign((low + (y - low >= 0.5)) / scale, x)
    return np.where(np.isfinite(out), out, x)
