"""Molecules to token sequences and back.

Both directions are one Arrow function over a batch's flat buffers: the atoms (or tokens) of all its molecules are one
array, and offsets say where a molecule ends. Nothing crosses molecules, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.arrays import draw
from tesserae.functions.rounding import half_away
from tesserae.operators.codebook import Levels1D, Levels3D, encode_vectors, scalar_codes
from tesserae.operators.scale import Scales, as_lists, centre, flat
from tesserae.operators.vocab import (
    ATOMS, ATOMS_END, BOS, ENERGY, ENERGY_END, EOS, FIRST_ATOM, FORCE, FORCE_END, N_ATOMS, NEWLINE, POS, POS_END, Space,
)

CODES = "pos array<array<int>>, fx array<array<int>>, fy array<array<int>>, fz array<array<int>>, en array<int>"
DECODED = "atomic_numbers array<int>, positions array<array<double>>, forces array<array<double>>, energy double, error boolean"
ROUND_TRIP = "positions array<array<double>>, back_positions array<array<double>>, back_forces array<array<double>>, back_energy double, error boolean"
SECTIONS = ("atoms", "pos", "force", "energy")
#: Tokens, and atoms, whose arrays a task holds at once, beside what one molecule has: a batch may be many times larger.
TOKENS_AT_ONCE, ATOMS_AT_ONCE = 1 << 16, 1 << 13


def space_of(books: dict[str, Levels1D | Levels3D]) -> Space:
    return Space(len(books["position"].vectors[0]), len(books["position"].vectors), len(books["energy"].centroids))


def _coder(books: dict[str, Levels1D | Levels3D]):
    """A function of scaled positions, forces and energies to a dict of code matrices, a row per atom or molecule."""
    pos = [np.array(v, float) for v in books["position"].vectors]

    def code(p: np.ndarray, f: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
        out = {"pos": encode_vectors(p, pos)[0]}
        for axis, name in enumerate(("fx", "fy", "fz")):
            out[name] = scalar_codes(f[:, axis], books[f"force_{'xyz'[axis]}"])[0]
        return out | {"en": scalar_codes(e, books["energy"])[0]}

    return code


def _same_sizes(*sizes: np.ndarray) -> None:
    if any(not np.array_equal(sizes[0], s) for s in sizes[1:]):
        raise ValueError("positions, forces and atomic numbers differ in length")


def _ends(sizes) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))


def _piecewise(make, most: int, sizes: np.ndarray, *arrays: pa.Array) -> pa.Array:
    """`make` of consecutive slices of the arrays, whose `sizes` add up to `most` or which are one row, put together again."""
    upto, lo, out = np.cumsum(sizes), 0, []
    while lo < len(sizes) or not out:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        out.append(make(*(a.slice(lo, hi - lo) for a in arrays)))
        lo = hi
    return pa.concat_arrays(out)


def _list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def encode_codes(molecules: DataFrame, books: dict[str, Levels1D | Levels3D]) -> DataFrame:
    """`molecules` (scaled: positions, forces, energy) with `codes`, a struct of CODES. Lists of different lengths fail."""
    code = _coder(books)

    @F.arrow_udf(CODES)
    def coded(positions: pa.Array, forces: pa.Array, energy: pa.Array) -> pa.Array:
        (n, p, _), (m, f, _) = flat(positions), flat(forces)
        _same_sizes(n, m)
        rows = lambda c: pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)), pa.array(c.reshape(-1)))
        out = code(p, f, energy.to_numpy(zero_copy_only=False).astype(float))
        lists = [pa.ListArray.from_arrays(_ends(n), rows(out[k])) for k in ("pos", "fx", "fy", "fz")]
        return pa.StructArray.from_arrays([*lists, rows(out["en"])], ["pos", "fx", "fy", "fz", "en"])

    return molecules.withColumn("codes", coded("positions", "forces", "energy"))


def _sequencer(space: Space):
    """A function of atomic numbers, molecule sizes, codes and section orders to (tokens, lengths)."""
    starts = [space.channel(k) for k in range(4)]
    p_row, f_row = space.pos_levels + 1, 3 * space.levels + 1
    step = lambda levels: np.arange(levels) * space.size

    def tokens(numbers: np.ndarray, n: np.ndarray, codes: dict[str, np.ndarray], order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.column_stack([n + 2, n * p_row + 2, n * f_row + 2, np.full(len(n), space.levels + 3)])
        total = lengths.sum(axis=1) + 2
        first = np.cumsum(total) - total
        out = np.full(int(total.sum()), NEWLINE, np.int32)  # what is not written below ends a row
        out[first], out[first + total - 1] = BOS, EOS
        at, now, every = np.empty_like(lengths), first + 1, np.arange(len(n))
        for k in range(4):  # where each section starts
            own = np.full(len(n), k) if order is None else order[:, k]
            at[every, own] = now
            now = now + lengths[every, own]
        for k, (opens, closes) in enumerate(((ATOMS, ATOMS_END), (POS, POS_END), (FORCE, FORCE_END), (ENERGY, ENERGY_END))):
            out[at[:, k]], out[at[:, k] + lengths[:, k] - 1] = opens, closes
        of = np.repeat(every, n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        out[at[of, 0] + 1 + inside] = numbers + (FIRST_ATOM - 1)
        row = at[of, 1] + 1 + inside * p_row
        out[row[:, None] + np.arange(space.pos_levels)] = codes["pos"] + space.pos + step(space.pos_levels)
        row = at[of, 2] + 1 + inside * f_row
        for k, name in enumerate(("fx", "fy", "fz")):
            out[row[:, None] + k * space.levels + np.arange(space.levels)] = codes[name] + starts[k] + step(space.levels)
        out[at[:, 3][:, None] + 1 + np.arange(space.levels)] = codes["en"] + starts[3] + step(space.levels)
        return out, total

    return tokens


def section_order(key: Column, seed: int) -> Column:
    """A permutation of 0..3 that follows from the key and the seed."""
    drawn = F.transform(F.array(*(F.lit(k) for k in range(4))), lambda k: F.struct(draw(F.concat_ws(":", key.cast("string"), k.cast("string")), seed).alias("d"), k.alias("k")))
    return F.array_sort(drawn)["k"]


def _tokenizer(books: dict, scales: Scales):
    """A function of atomic numbers, positions, forces, energies and section orders (or None) to lists of tokens."""
    code, lay = _coder(books), _sequencer(space_of(books))

    def piece(numbers: pa.Array, positions: pa.Array, forces: pa.Array, energy: pa.Array, order: pa.Array | None = None) -> pa.Array:
        (n, p, _), (m, f, _) = flat(positions), flat(forces)
        z = _list_sizes(numbers)
        _same_sizes(n, m, z)
        order = None if order is None else pc.list_flatten(order).to_numpy(zero_copy_only=False).reshape(-1, 4)
        e = half_away((energy.to_numpy(zero_copy_only=False).astype(float) - scales.energy_shift) / scales.energy, 9)
        out, total = lay(pc.list_flatten(numbers).to_numpy(zero_copy_only=False), n, code(half_away(centre(p, n) / scales.position), half_away(f / scales.force), e), order)
        return pa.ListArray.from_arrays(_ends(total), pa.array(out))

    def tokens(*arrays: pa.Array) -> pa.Array:
        return _piecewise(piece, ATOMS_AT_ONCE, _list_sizes(arrays[0]), *arrays)

    return tokens


def tokenize(molecules: DataFrame, books: dict, scales: Scales, shuffle_seed: int | None = None, key: str = "mol_id") -> DataFrame:
    """`molecules` (atomic_numbers, positions, forces, energy) with `tokens`: centred, scaled, coded and laid out in one function.

    Sections come in the order atoms, positions, forces, energy, or in one drawn by key and seed. Rows never leave their
    partition. Lists of different lengths in a molecule fail; null lists are empty.
    """
    tokens = _tokenizer(books, scales)
    columns = [F.col(c) for c in ("atomic_numbers", "positions", "forces", "energy")]
    if shuffle_seed is None:

        @F.arrow_udf("array<int>")
        def plain(numbers: pa.Array, positions: pa.Array, forces: pa.Array, energy: pa.Array) -> pa.Array:
            return tokens(numbers, positions, forces, energy)

        return molecules.withColumn("tokens", plain(*columns))

    @F.arrow_udf("array<int>")
    def shuffled(numbers: pa.Array, positions: pa.Array, forces: pa.Array, energy: pa.Array, order: pa.Array) -> pa.Array:
        return tokens(numbers, positions, forces, energy, order)

    return molecules.withColumn("tokens", shuffled(*columns, section_order(F.col(key), shuffle_seed)))


def _groups(marks: np.ndarray) -> np.ndarray:
    """Numbers of runs from 0 on, a new one where marks are true."""
    return np.cumsum(marks) - 1


def _any_in(group: np.ndarray, is_: np.ndarray) -> np.ndarray:
    """For every place whether any of its group is true."""
    return np.bincount(group, is_, group[-1] + 1)[group] > 0 if len(group) else is_


def _decoder(books: dict, scales: Scales):
    """A function of (tokens, molecule of each, molecules) to the parts of DECODED.

    Markers open and close sections. A position row ends at a line end and is lost without one; a force row ends at a
    line end only if it has x codes, otherwise its y and z codes carry over; levels count by arrival.
    """
    space = space_of(books)
    starts = [space.channel(k) for k in range(4)]
    vectors = np.array(books["position"].vectors, float)

    def decode(t: np.ndarray, of: np.ndarray, count: int) -> tuple:
        keep = (t != BOS) & (t != EOS)
        t, of = t[keep], of[keep]
        marker = (t >= ATOMS) & (t <= ENERGY_END)
        begins = np.r_[True, of[1:] != of[:-1]] if len(t) else np.zeros(0, bool)
        segment = _groups(begins | marker)
        opened = np.where(np.isin(t, (ATOMS, POS, FORCE, ENERGY)) & marker, t, -1)
        section = opened[np.maximum.accumulate(np.where(begins | marker, np.arange(len(t)), 0))] if len(t) else opened
        body = ~marker & (section >= 0)
        t, of, segment, section = t[body], of[body], segment[body], section[body]
        end = t == NEWLINE
        new = np.r_[True, segment[1:] != segment[:-1]] if len(t) else np.zeros(0, bool)
        line = _groups(new | np.r_[False, end[:-1]]) if len(t) else segment
        axis = np.where(t >= starts[2], 2, np.where(t >= starts[1], 1, np.where(t >= starts[0], 0, -1)))
        axis = np.where((section == FORCE) & ~end, axis, -1)
        closes = end & np.where(section == FORCE, _any_in(line, axis == 0), np.where(section == POS, _any_in(line, ~end), False))
        row = _groups(new | np.r_[False, closes[:-1]]) if len(t) else segment
        whole = _any_in(row, closes)
        code = lambda start: np.mod(t - start, space.size)

        def rows(is_: np.ndarray, group: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(places of the codes that count, their row, their level, the rows' molecules, whether a row is short)."""
            at = np.nonzero(is_)[0]
            g = group[at]
            lead = np.r_[True, g[1:] != g[:-1]] if len(at) else np.zeros(0, bool)
            number = _groups(lead)
            level = np.arange(len(at)) - np.nonzero(lead)[0][number] if len(at) else number
            size = np.bincount(number, minlength=int(lead.sum()))
            fits = level < levels
            return at[fits], number[fits], level[fits], of[at[lead]], size < levels

        error = np.zeros(count, bool)
        at, number, level, p_of, short = rows((section == POS) & ~end & whole, row, space.pos_levels)
        error[p_of[short]] = True
        found = vectors[level, code(space.pos)[at]] * scales.position
        positions = np.column_stack([np.bincount(number, found[:, i], len(p_of)) for i in range(3)])
        n = np.bincount(p_of, minlength=count)

        def scalars(is_: np.ndarray, group: np.ndarray, start: int, book: Levels1D) -> tuple[np.ndarray, np.ndarray]:
            at, number, level, own, short = rows(is_, group, len(book.centroids))
            error[own[short]] = True
            return np.bincount(number, np.array(book.centroids, float)[level, code(start)[at]], len(own)), own

        forces = [scalars((axis == k) & whole, row, starts[k], books[f"force_{x}"]) for k, x in enumerate("xyz")]
        energy, e_of = scalars((section == ENERGY) & ~end, of, starts[3], books["energy"])
        m = [np.bincount(own, minlength=count) for _, own in forces]
        full = np.zeros(count)
        full[e_of] = energy * scales.energy + scales.energy_shift
        error |= (n < 1) | (m[0] < 1) | (m[0] != m[1]) | (m[0] != m[2]) | (np.bincount(e_of, minlength=count) < 1)
        good = [~error[own] for _, own in forces]
        atoms = (section == ATOMS) & ~end & (t >= FIRST_ATOM) & (t < FIRST_ATOM + N_ATOMS)
        force = np.column_stack([value[ok] * scales.force for (value, _), ok in zip(forces, good, strict=True)])
        none = lambda sizes: np.where(error, 0, sizes)
        return t[atoms] - (FIRST_ATOM - 1), np.bincount(of[atoms], minlength=count), positions[~error[p_of]], none(n), force, none(m[0]), full, error

    return decode


def _reader(books: dict, scales: Scales):
    """A function of lists of tokens to structs of DECODED."""
    decoder = _decoder(books, scales)

    def piece(tokens: pa.Array) -> pa.Array:
        sizes = _list_sizes(tokens)
        flat_tokens = pc.fill_null(pc.list_flatten(tokens), BOS).to_numpy(zero_copy_only=False)  # a null token says nothing
        z, n_z, p, n_p, f, n_f, energy, error = decoder(flat_tokens.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
        good = pa.array([None if bad else 1 for bad in error], pa.int8())  # what `as_lists` takes its nulls from
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(_ends(n_z), pa.array(z.astype(np.int32))), as_lists(p, n_p, good), as_lists(f, n_f, good), pa.array(energy, mask=error), pa.array(error)],
            ["atomic_numbers", "positions", "forces", "energy", "error"],
        )

    def read(tokens: pa.Array) -> pa.Array:
        return _piecewise(piece, TOKENS_AT_ONCE, _list_sizes(tokens), tokens)

    return read


def with_decoded(sequences: DataFrame, books: dict, scales: Scales) -> DataFrame:
    """`sequences` with `decoded`, a struct of DECODED read from `tokens`: one function of a batch's tokens, no shuffle."""
    read = _reader(books, scales)

    @F.arrow_udf(DECODED)
    def decoded(tokens: pa.Array) -> pa.Array:
        return read(tokens)

    # Else a filter on `decoded` is pushed below, with a call (and a worker) of its own.
    return sequences.withColumn("decoded", decoded.asNondeterministic()("tokens"))


def with_round_trip(molecules: DataFrame, books: dict, scales: Scales) -> DataFrame:
    """`molecules` with `trip`, a struct of ROUND_TRIP: positions before and after encoding and decoding (both centred), and the decoded forces and energy.

    Tokens are made and read inside one function, so a task has one Python worker for the whole way and no token leaves it.
    """
    tokens, read = _tokenizer(books, scales), _reader(books, scales)

    def piece(numbers: pa.Array, positions: pa.Array, forces: pa.Array, energy: pa.Array) -> pa.Array:
        back = read(tokens(numbers, positions, forces, energy))

        def middle(lists: pa.Array) -> pa.Array:
            sizes, values, _ = flat(lists)
            return as_lists(centre(values, sizes), sizes, lists)

        return pa.StructArray.from_arrays([middle(positions), middle(back.field("positions")), back.field("forces"), back.field("energy"), back.field("error")], ["positions", "back_positions", "back_forces", "back_energy", "error"])

    @F.arrow_udf(ROUND_TRIP)
    def trip(numbers: pa.Array, positions: pa.Array, forces: pa.Array, energy: pa.Array) -> pa.Array:
        return _piecewise(piece, ATOMS_AT_ONCE, _list_sizes(positions), numbers, positions, forces, energy)

    # Else a filter on `trip` is pushed below, with a call (and a worker) of its own.
    return molecules.withColumn("trip", trip.asNondeterministic()("atomic_numbers", "positions", "forces", "energy"))


def with_coding_errors(molecules: DataFrame, books: dict) -> DataFrame:
    """`molecules` (scaled: positions, forces, energy) with `errors`, a struct of what coding loses: lists of position and force components, and the energy's."""
    pos = [np.array(v, float) for v in books["position"].vectors]

    def added(codes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        total = levels[0][codes[:, 0]]
        for k in range(1, len(levels)):
            total = total + levels[k][codes[:, k]]
        return total

    def lost(x: np.ndarray, book: Levels1D) -> np.ndarray:
        return x - added(scalar_codes(x, book)[0], [np.array(c, float) for c in book.centroids])

    def piece(positions: pa.Array, forces: pa.Array, energy: pa.Array) -> pa.Array:
        (n, p, _), (m, f, _) = flat(positions), flat(forces)
        _same_sizes(n, m)
        e = lost(energy.to_numpy(zero_copy_only=False).astype(float), books["energy"])
        f = np.column_stack([lost(f[:, i], books[f"force_{a}"]) for i, a in enumerate("xyz")])
        lists = [pa.ListArray.from_arrays(_ends(3 * n), pa.array(x.reshape(-1))) for x in (p - added(encode_vectors(p, pos)[0], pos), f)]
        return pa.StructArray.from_arrays([*lists, pa.array(e, mask=energy.is_null().to_numpy(zero_copy_only=False))], ["position", "force", "energy"])

    @F.arrow_udf("position array<double>, force array<double>, energy double")
    def errors(positions: pa.Array, forces: pa.Array, energy: pa.Array) -> pa.Array:
        return _piecewise(piece, ATOMS_AT_ONCE, _list_sizes(positions), positions, forces, energy)

    return molecules.withColumn("errors", errors.asNondeterministic()("positions", "forces", "energy"))


def decode(sequences: DataFrame, books: dict, scales: Scales, key: str = "mol_id") -> DataFrame:
    """Molecules read back from `tokens`, row by row: key, atomic_numbers, positions (centred), forces, energy, error.

    A sequence that has no position or force row, a row with fewer codes than levels, or too few energy codes gives
    `error` and null values. Codes beyond the levels are left out. Null sequences are empty ones.
    """
    return with_decoded(sequences, books, scales).select(key, "decoded.*")


def prompt(tokens: Column) -> Column:
    """The tokens that a model goes on from: up to the first force marker; else up to the end of positions and a force marker; else an error."""
    upto = lambda marker: F.slice(tokens, 1, F.array_position(tokens, marker).cast("int"))
    return F.when(F.array_contains(tokens, FORCE), upto(FORCE)).when(
        F.array_contains(tokens, POS_END), F.concat(upto(POS_END), F.array(F.lit(FORCE)))
    ).otherwise(F.raise_error(F.lit("a sequence without positions has no prompt")))


def with_defaults(decoded: DataFrame, natoms: str) -> DataFrame:
    """Decoded outputs with zeros where there is nothing usable: forces of another length than `natoms`, or an error."""
    zeros = F.array_repeat(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.col(natoms).cast("int"))
    usable = F.coalesce(~F.col("error") & (F.size("forces") == F.col(natoms)), F.lit(False))
    return decoded.withColumns({"energy": F.when(F.coalesce(F.col("error"), F.lit(True)), F.lit(0.0)).otherwise(F.col("energy")), "forces": F.when(usable, F.col("forces")).otherwise(zeros)})
