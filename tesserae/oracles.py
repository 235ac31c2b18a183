"""DuckDB SQL for the registered queries, written out from the same constants."""

from __future__ import annotations

from tesserae import queries as q
from tesserae.operators import vocab

S = q.FIXED_SCALES


def d(x: float) -> str:
    return f"({x!r})::DOUBLE"


def lst(xs) -> str:
    return "[" + ", ".join(d(float(x)) for x in xs) + "]"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def r9(x: str) -> str:
    return f"round({x}, 9) + 0.0::DOUBLE"


ATOMS_A = """atoms AS (
  SELECT l_orderkey AS mol_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS atom_idx,
    1 + l_partkey % 118 AS atomic_number, l_quantity / 10 AS x, l_extendedprice / 10000 AS y, l_discount * 50 AS z,
    l_tax - 0.04::DOUBLE AS fx, l_discount - 0.05::DOUBLE AS fy, (l_quantity - 25) / 100 AS fz
  FROM lineitem),
mols AS (SELECT o_orderkey AS mol_id, -o_totalprice / 1000 AS energy FROM orders)"""

ATOMS_B = """atoms AS (
  SELECT vec_id AS mol_id, i AS atom_idx, 1 + (i * 7 + label) % 118 AS atomic_number,
    embedding[i * 3 + 1]::DOUBLE AS x, embedding[i * 3 + 2]::DOUBLE AS y, embedding[i * 3 + 3]::DOUBLE AS z,
    embedding[63 - i * 3]::DOUBLE AS fx, embedding[62 - i * 3]::DOUBLE AS fy, embedding[61 - i * 3]::DOUBLE AS fz,
    embedding[64]::DOUBLE AS energy
  FROM embeddings, (SELECT unnest(range(21)) AS i))"""

CENTRED = """centred AS (
  SELECT * EXCLUDE (x, y, z), round(x - avg(x) OVER w, 9) AS x, round(y - avg(y) OVER w, 9) AS y, round(z - avg(z) OVER w, 9) AS z
  FROM atoms WINDOW w AS (PARTITION BY mol_id))"""

# Scaled positions of the trained queries.
SCALED_B = f"""{ATOMS_B}, {CENTRED},
pscale AS (SELECT round(sqrt(sum(x * x + y * y + z * z) / (3 * count(*))), 9) AS s FROM centred),
scaled AS (SELECT mol_id, atom_idx, round(x / s, 9) AS x, round(y / s, 9) AS y, round(z / s, 9) AS z FROM centred, pscale)"""


def morton_ctes(source: str, out: str, where: str = "true") -> str:
    """CTEs that give `out`: rows of `source` with mc."""
    grid = ", ".join(f"greatest(0, least(1023, trunc(({a} - l{a}) / (CASE WHEN h{a} = l{a} THEN 1 ELSE h{a} - l{a} END) * 1023)))::BIGINT AS g{a}" for a in "xyz")
    steps, prev = [], f"{out}_g"
    for n, (shift, mask) in enumerate(((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))):
        cols = ", ".join(f"(g{a} | (g{a} << {shift})) & {mask} AS g{a}" for a in "xyz")
        steps.append(f"{out}_s{n} AS (SELECT * REPLACE ({cols}) FROM {prev})")
        prev = f"{out}_s{n}"
    box = ", ".join(f"min({a}) AS l{a}, max({a}) AS h{a}" for a in "xyz")
    return f"""{out}_in AS (SELECT * FROM {source} WHERE {where}),
{out}_box AS (SELECT {box} FROM {out}_in),
{out}_g AS (SELECT {out}_in.*, {grid} FROM {out}_in, {out}_box),
{", ".join(steps)},
{out} AS (SELECT * EXCLUDE (gx, gy, gz), gx | (gy << 1) | (gz << 2) AS mc FROM {prev})"""


def codebook_ctes(source: str, out: str, size: int) -> str:
    """A 3D level's codebook (code, x, y, z), zero first; assumes enough significant rows."""
    return f"""{morton_ctes(source, f"{out}_m", "sqrt(x * x + y * y + z * z) >= 1e-4::DOUBLE")},
{out}_r AS (SELECT x, y, z, row_number() OVER (ORDER BY mc, mol_id, atom_idx) - 1 AS rk, count(*) OVER () AS n FROM {out}_m),
{out} AS (SELECT 0 AS code, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z UNION ALL
  SELECT j + 1, x, y, z FROM (SELECT unnest(range({size - 1})) AS j) JOIN {out}_r ON rk = trunc((j + 0.5::DOUBLE) / {size - 1} * (n - 1))::BIGINT)"""


def nearest_ctes(source: str, book: str, out: str, code: str) -> str:
    """Rows of `source` with their nearest codeword (lowest code on ties) and the residual in x, y, z."""
    return f"""{out}_d AS (SELECT s.*, b.code AS bc, b.x AS bx, b.y AS by_, b.z AS bz,
    row_number() OVER (PARTITION BY s.mol_id, s.atom_idx ORDER BY (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) + (s.z - b.z) * (s.z - b.z), b.code) AS k
  FROM {source} s, {book} b),
{out} AS (SELECT * EXCLUDE (bc, bx, by_, bz, k, x, y, z), bc AS {code}, round(x - bx, 9) AS x, round(y - by_, 9) AS y, round(z - bz, 9) AS z FROM {out}_d WHERE k = 1)"""


def kmeans_sql(runs: int, steps: int, size: int) -> str:
    """Lloyd steps of all runs side by side; no centre loses all its rows on these tables."""
    ctes = [SCALED_B, "p AS MATERIALIZED (SELECT mol_id, atom_idx, x, y, z FROM scaled)"]
    firsts = " UNION ALL ".join(f"(SELECT {r} AS run, row_number() OVER (ORDER BY g) - 1 AS code, x, y, z FROM (SELECT *, md5('{1 + r}:' || mol_id || ':' || atom_idx) AS g FROM p ORDER BY g LIMIT {size}))" for r in range(runs))
    ctes.append(f"c0 AS MATERIALIZED ({firsts})")
    far = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)"
    for k in range(steps + 1):
        ctes.append(f"d{k} AS (SELECT run, mol_id, atom_idx, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, min({{'d': {far}, 'c': c.code}}) AS m FROM p, c{k} AS c GROUP BY run, mol_id, atom_idx)")
        if k < steps:
            mean = ", ".join(f"round(sum(round({a} * 1e9)::HUGEINT)::DOUBLE / count(*) / 1e9::DOUBLE, 9) AS {a}" for a in "xyz")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT run, m.c AS code, {mean} FROM d{k} GROUP BY run, m.c)")
    ctes.append(f"best AS (SELECT run FROM d{steps} GROUP BY run ORDER BY round(sum(m.d), 6), run LIMIT 1)")
    return f"WITH {', '.join(ctes)} SELECT 'position' AS channel, 0::BIGINT AS level, code::BIGINT AS code, {', '.join(f'{r6(a)} AS {a}' for a in 'xyz')} FROM c{steps} JOIN best USING (run)"


def events_ctes(levels: int, size: int) -> str:
    n = size - 1
    out = ["st AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)", "l0 AS (SELECT event_id, round((value - m) / s, 9) AS r0, round((value - m) / s, 9) AS r FROM events, st)"]
    at = "[" + ", ".join(d((j + 0.5) / n) for j in range(n)) + "]"
    for k in range(levels):
        out.append(f"b{k} AS (SELECT list_sort(list_append(list_transform(quantile_cont(r, {at}), lambda v: round(v + 1.7e-10::DOUBLE, 9)), 0.0::DOUBLE)) AS c FROM l{k} WHERE abs(r) >= 1e-4::DOUBLE)")
        out.append(f"m{k} AS (SELECT c, list_transform(range(1, {size}), lambda i: (c[i] + c[i + 1]) / 2) AS b FROM b{k})")
        out.append(f"e{k} AS (SELECT l{k}.*, c, len(list_filter(b, lambda v: v < r)) AS c{k}, len(list_filter(b, lambda v: v < r0)) AS p{k} FROM l{k}, m{k})")
        out.append(f"l{k + 1} AS (SELECT * EXCLUDE (r, c), round(r - c[c{k} + 1], 9) AS r FROM e{k})")
    return ", ".join(out)


def fixed_codes() -> str:
    """CTEs for the molecules of orders with the fixed codebooks: acodes (per atom) and ecodes (per molecule)."""
    out = [ATOMS_A, CENTRED]
    scaled = ", ".join(f"round({a} / {d(S.position)}, 9) AS {a}" for a in "xyz") + ", " + ", ".join(f"round(f{a} / {d(S.force)}, 9) AS f{a}" for a in "xyz")
    out.append(f"a0 AS (SELECT mol_id, atom_idx, atomic_number, {scaled} FROM centred)")
    for k, book in enumerate(q.FIXED_POSITION.vectors):
        dist = "[" + ", ".join(f"(x - {d(v[0])}) * (x - {d(v[0])}) + (y - {d(v[1])}) * (y - {d(v[1])}) + (z - {d(v[2])}) * (z - {d(v[2])})" for v in book) + "]"
        out.append(f"n{k} AS (SELECT *, {dist} AS ds FROM a{k})")
        out.append(f"o{k} AS (SELECT * EXCLUDE (ds), list_position(ds, list_min(ds)) - 1 AS p{k} FROM n{k})")
        axes = ", ".join(f"round({a} - {lst(v[i] for v in book)}[p{k} + 1], 9) AS {a}" for i, a in enumerate("xyz"))
        out.append(f"a{k + 1} AS (SELECT * REPLACE ({axes}) FROM o{k})")
    prev = f"a{len(q.FIXED_POSITION.vectors)}"
    sums = ", ".join(f"({' + '.join(f'{lst(v[i] for v in b)}[p{k} + 1]' for k, b in enumerate(q.FIXED_POSITION.vectors))}) * {d(S.position)} AS d{a}" for i, a in enumerate("xyz"))
    out.append(f"f0 AS (SELECT *, {sums} FROM {prev})")
    for k, (c, b) in enumerate(zip(q.FIXED_SCALAR.centroids, q.FIXED_SCALAR.bounds, strict=True)):
        cols = ", ".join(f"len(list_filter({lst(b)}, lambda v: v < f{a})) AS f{a}{k}" for a in "xyz")
        out.append(f"g{k} AS (SELECT *, {cols} FROM f{k})")
        left = ", ".join(f"round(f{a} - {lst(c)}[f{a}{k} + 1], 9) AS f{a}" for a in "xyz")
        out.append(f"f{k + 1} AS (SELECT * REPLACE ({left}) FROM g{k})")
    levels = len(q.FIXED_SCALAR.centroids)
    scalar = lambda name: "(" + " + ".join(f"{lst(c)}[{name}{k} + 1]" for k, c in enumerate(q.FIXED_SCALAR.centroids)) + ")"
    forces = ", ".join(f"{scalar(f'f{a}')} * {d(S.force)} AS df{a}" for a in "xyz")
    out.append(f"acodes AS (SELECT *, {forces} FROM f{levels})")
    out.append(f"h0 AS (SELECT mol_id, energy, round((energy - {d(S.energy_shift)}) / {d(S.energy)}, 9) AS r FROM mols)")
    for k, (c, b) in enumerate(zip(q.FIXED_SCALAR.centroids, q.FIXED_SCALAR.bounds, strict=True)):
        out.append(f"i{k} AS (SELECT *, len(list_filter({lst(b)}, lambda v: v < r)) AS e{k} FROM h{k})")
        out.append(f"h{k + 1} AS (SELECT * REPLACE (round(r - {lst(c)}[e{k} + 1], 9) AS r) FROM i{k})")
    out.append(f"ecodes AS (SELECT *, {scalar('e')} * {d(S.energy)} + {d(S.energy_shift)} AS denergy FROM h{levels})")
    return ",\n".join(out)


def sequences(text: bool) -> str:
    """CTE seqs (mol_id, n, s): the tokens of every molecule as text or as ids."""
    space = q.SPACE
    special = (lambda k: vocab.SPECIAL_TEXT[k]) if text else str
    one = (lambda name, start, level, c: f"'[{name}{level}:' || {c} || ']'") if text else (lambda name, start, level, c: f"({start + level * space.size} + {c})::VARCHAR")
    atom = "'[Z=' || atomic_number || ']'" if text else "(11 + atomic_number)::VARCHAR"
    nl = f"'{special(vocab.NEWLINE)}'"
    join = lambda parts: " || ' ' || ".join(parts)
    pos = join([one("P", space.pos, k, f"p{k}") for k in range(space.pos_levels)] + [nl])
    force = join([one(f"F{a.upper()}", space.channel(i), k, f"f{a}{k}") for i, a in enumerate("xyz") for k in range(space.levels)] + [nl])
    energy = join([one("E", space.channel(3), k, f"e{k}") for k in range(space.levels)] + [nl])
    agg = lambda x: f"string_agg({x}, ' ' ORDER BY atom_idx)"
    m = lambda k: f"'{special(k)}'"
    V = vocab
    return f"""{fixed_codes()},
per AS (SELECT mol_id, count(*) AS n, {agg(atom)} AS a, {agg(pos)} AS p, {agg(force)} AS f FROM acodes GROUP BY mol_id),
seqs AS (SELECT mol_id, coalesce(n, 0) AS n, concat_ws(' ', {m(V.BOS)}, {m(V.ATOMS)}, a, {m(V.ATOMS_END)}, {m(V.POS)}, p, {m(V.POS_END)}, {m(V.FORCE)}, f, {m(V.FORCE_END)},
  {m(V.ENERGY)}, {energy}, {m(V.ENERGY_END)}, {m(V.EOS)}) AS s FROM ecodes LEFT JOIN per USING (mol_id))"""


LENGTH = f"n * {q.SPACE.pos_levels + 3 * q.SPACE.levels + 3} + {q.SPACE.levels + 11}"


def tasks_cte() -> str:
    e = lambda n: f"embedding[{n}]::DOUBLE"
    pick = lambda n, *names: f"[{', '.join(repr(x) for x in names)}][vec_id % {n} + 1]"
    rows = [
        ("conformers", "label", "''", 63, "true"), ("distance_scaling", "label", "''", 63, "true"), ("spin_gap", "vec_id // 2", pick(2, "singlet", "triplet"), 63, "true"),
        ("protonation", "vec_id // 2", pick(2, "protonated", "deprotonated"), 61, "true"), ("ligand_strain", "vec_id // 2", pick(2, "bound", "relaxed"), 59, "true"),
        ("ie_ea", "vec_id // 3", pick(3, "neutral", "cation", "anion"), 63, "(vec_id % 3 <> 1 OR label % 4 <> 0) AND (vec_id % 3 <> 2 OR label % 3 <> 0)"),
        ("ligand_pocket", "vec_id", "'complex'", 63, "true"),
    ]
    parts = " UNION ALL ".join(f"SELECT '{t}' AS task, ({g})::BIGINT AS group_id, {s} AS state, vec_id::BIGINT AS idx, {e(p)} AS pred, {e(p + 1)} AS target FROM embeddings WHERE {w}" for t, g, s, p, w in rows)
    return f"ev AS ({parts})"


def states(task: str, *names: str) -> str:
    cols = ", ".join(f"max(CASE WHEN state = '{n}' THEN {c} END) AS {n}_{c[0]}" for n in names for c in ("pred", "target"))
    return f"(SELECT group_id, {cols} FROM ev WHERE task = '{task}' GROUP BY group_id)"


def gap(task: str, upper: str, lower: str) -> str:
    err = f"abs(({upper}_p - {lower}_p) - ({upper}_t - {lower}_t))"
    return f"SELECT {r6(f'coalesce(avg({err}), 0) * 1000')} AS mae_mev, count({err}) AS n FROM {states(task, upper, lower)}"


IE, EA = "abs((cation_p - neutral_p) - (cation_t - neutral_t))", "abs((neutral_p - anion_p) - (neutral_t - anion_t))"
TASK_SQL = {
    "conformers": "SELECT round(avg((p = t)::INT::DOUBLE), 6) + 0.0::DOUBLE AS accuracy, sum((p = t)::INT)::BIGINT AS correct, count(*) AS total FROM (SELECT group_id, min({'e': pred, 'i': idx}).i AS p, min({'e': target, 'i': idx}).i AS t FROM ev WHERE task = 'conformers' GROUP BY 1)",
    "distance_scaling": f"SELECT {r6('avg(m) * 1000')} AS mae_mev, count(*) AS n_systems FROM (SELECT group_id, avg(abs(pred - target)) AS m FROM ev WHERE task = 'distance_scaling' GROUP BY 1)",
    "spin_gap": gap("spin_gap", "triplet", "singlet"),
    "ie_ea": f"SELECT {r6(f'coalesce(avg({IE}), 0) * 1000')} AS ie_mae_mev, count({IE}) AS n_ie, {r6(f'coalesce(avg({EA}), 0) * 1000')} AS ea_mae_mev, count({EA}) AS n_ea FROM {states('ie_ea', 'neutral', 'cation', 'anion')}",
    "protonation": gap("protonation", "protonated", "deprotonated"),
    "ligand_strain": gap("ligand_strain", "bound", "relaxed"),
    "ligand_pocket": f"SELECT {r6('avg(abs(pred - target)) * 1000')} AS mae_mev, count(*) AS n FROM ev WHERE task = 'ligand_pocket'",
}


def error_columns(e: str) -> str:
    return f"{r6(f'avg(abs({e}))')} AS mae, {r6(f'quantile_cont(abs({e}), 0.5)')} AS median_error, {r6(f'sqrt(avg(({e}) * ({e})))')} AS rmse, {r6(f'max(abs({e}))')} AS max_error"


def vocab_sql(s: vocab.Space) -> str:
    K = s.size
    parts = [f"SELECT {k} AS token_id, '{t}' AS token" for k, t in enumerate(vocab.SPECIAL_TEXT)]
    parts.append(f"SELECT {vocab.FIRST_ATOM} - 1 + z, '[Z=' || z || ']' FROM (SELECT unnest(range(1, {vocab.N_ATOMS + 1})) AS z)")
    for name, start, levels in [("P", s.pos, s.pos_levels), *((n, s.channel(k), s.levels) for k, n in enumerate(("FX", "FY", "FZ", "E")))]:
        parts.append(f"SELECT {start} + l * {K} + c, '[{name}' || l || ':' || c || ']' FROM (SELECT unnest(range({levels})) AS l), (SELECT unnest(range({K})) AS c)")
    parts.append(f"SELECT {s.vocab_size}, '{vocab.UNKNOWN}'")
    return "SELECT token_id::BIGINT AS token_id, token FROM (" + " UNION ALL ".join(parts) + ")"


def big_scalar_sql() -> str:
    ctes = ["l0 AS (SELECT event_id, round(value / 100 - 2, 9) AS r FROM events)"]
    for k, (c, b) in enumerate(zip(q.BIG_SCALAR.centroids, q.BIG_SCALAR.bounds, strict=True)):
        ctes.append(f"e{k} AS (SELECT *, len(list_filter({lst(b)}, lambda v: v < r)) AS c{k} FROM l{k})")
        ctes.append(f"l{k + 1} AS (SELECT * REPLACE (round(r - {lst(c)}[c{k} + 1], 9) AS r) FROM e{k})")
    return f"WITH {', '.join(ctes)} SELECT event_id, {', '.join(f'c{k}::BIGINT AS c{k}' for k in range(4))} FROM l4"


def big_position_sql() -> str:
    ctes = [ATOMS_B, "a0 AS (SELECT mol_id, atom_idx, x, y, z FROM atoms)"]
    for k, book in enumerate(q.BIG_POSITION.vectors):
        ctes.append(f"n{k} AS (SELECT *, list_transform({[list(v) for v in book]}, lambda v: (x - v[1]) * (x - v[1]) + (y - v[2]) * (y - v[2]) + (z - v[3]) * (z - v[3])) AS ds FROM a{k})")
        ctes.append(f"o{k} AS (SELECT * EXCLUDE (ds), list_position(ds, list_min(ds)) - 1 AS c{k} FROM n{k})")
        ctes.append(f"a{k + 1} AS (SELECT * REPLACE ({', '.join(f'round({a} - {lst(v[i] for v in book)}[c{k} + 1], 9) AS {a}' for i, a in enumerate('xyz'))}) FROM o{k})")
    return f"WITH {', '.join(ctes)} SELECT mol_id, atom_idx::BIGINT AS atom_idx, {', '.join(f'c{k}::BIGINT AS c{k}' for k in range(8))} FROM a8"


def info_sql() -> str:
    s = q.SPACE
    named = {"vocab_size": s.vocab_size, "codebook_size": s.size, "pos_levels": s.pos_levels, "n_levels": s.levels, "atom_start": vocab.FIRST_ATOM, "pos_start": s.pos, "fx_start": s.channel(0), "fy_start": s.channel(1), "fz_start": s.channel(2), "energy_start": s.channel(3), "pad_id": 0, "bos_id": 1, "eos_id": 2}
    return ", ".join(f"{v}::BIGINT AS {k}" for k, v in named.items())


def big_report_sql() -> tuple[str, str]:
    """Errors at the default shape, and lengths, sums of decoded forces and decoded energies by molecule."""
    ctes = [ATOMS_B, CENTRED, "a0 AS (SELECT mol_id, atom_idx, x, y, z FROM centred)"]
    for k, book in enumerate(q.BIG_POSITION.vectors):
        ctes.append(f"n{k} AS (SELECT *, list_transform({[list(v) for v in book]}, lambda v: (x - v[1]) * (x - v[1]) + (y - v[2]) * (y - v[2]) + (z - v[3]) * (z - v[3])) AS ds FROM a{k})")
        ctes.append(f"o{k} AS (SELECT * EXCLUDE (ds), list_position(ds, list_min(ds)) AS c FROM n{k})")
        ctes.append(f"a{k + 1} AS (SELECT * EXCLUDE (c) REPLACE ({', '.join(f'round({a} - {lst(v[i] for v in book)}[c], 9) AS {a}' for i, a in enumerate('xyz'))}) FROM o{k})")
    scalars = " UNION ALL ".join(f"SELECT mol_id, 'force' AS channel, round(f{a}, 9) AS r, 0.0::DOUBLE AS dec FROM atoms" for a in "xyz")
    ctes.append(f"s0 AS ({scalars} UNION ALL SELECT mol_id, 'energy', round(any_value(energy), 9), 0.0::DOUBLE FROM atoms GROUP BY mol_id)")
    for k, (c, b) in enumerate(zip(q.BIG_SCALAR.centroids, q.BIG_SCALAR.bounds, strict=True)):
        ctes.append(f"t{k} AS (SELECT *, {lst(c)}[len(list_filter({lst(b)}, lambda v: v < r)) + 1] AS c FROM s{k})")
        ctes.append(f"s{k + 1} AS (SELECT * EXCLUDE (c) REPLACE (round(r - c, 9) AS r, dec + c AS dec) FROM t{k})")
    er = " UNION ALL ".join(f"SELECT 'position' AS channel, {a} AS e FROM a8" for a in "xyz")
    report = f"WITH {', '.join(ctes)}, er AS ({er} UNION ALL SELECT channel, r FROM s4) SELECT channel, {error_columns('e')} FROM er GROUP BY 1"
    length = 21 * (8 + 3 * 4 + 3) + 4 + 11
    values = f"SELECT mol_id, {length}::BIGINT AS n_tokens, {r6('sum(dec) FILTER (WHERE channel = $$force$$)')} AS force_sum, {r6('sum(dec) FILTER (WHERE channel = $$energy$$)')} AS energy FROM s4 GROUP BY mol_id"
    own = [c for c in ctes if c == ATOMS_B or c[0] in "st"]
    return report, f"WITH {', '.join(own)} {values}"


def oracle_sql() -> dict[str, str]:
    L, Z = q.EVENT_LEVELS, q.EVENT_SIZE
    ids, txt, codes = sequences(False), sequences(True), fixed_codes()
    codes_l = ", ".join(f"c{k}::BIGINT AS c{k}" for k in range(L))
    plain_l = ", ".join(f"p{k}::BIGINT AS c{k}" for k in range(L))
    two = f"{codebook_ctes('scaled', 'k0', 16)}, {nearest_ctes('scaled', 'k0', 'q0', 'c0')}, {codebook_ctes('q0', 'k1', 16)}, {nearest_ctes('q0', 'k1', 'q1', 'c1')}"
    split = "split AS (SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) <= 700 THEN 'val' ELSE 'train' END AS split FROM orders)"
    shards = f"{split}, sh AS (SELECT o_orderkey, split, (row_number() OVER (PARTITION BY split ORDER BY md5('4:' || o_orderkey)) - 1) // 400 AS shard FROM split)"
    sections = "[" + ", ".join(f"{{'d': md5('5:' || mol_id || ':{k}'), 'k': {m}}}" for k, m in enumerate((vocab.ATOMS, vocab.POS, vocab.FORCE, vocab.ENERGY))) + "]"
    words = "[" + ", ".join(f"'{w}'" for w in q.WORDS) + "]"
    bad_cut = "(n = 0 OR mol_id % 3 = 0)"
    out = {
        "rvq1d_level1": f"WITH {events_ctes(1, Z)} SELECT event_id, c0::BIGINT AS code, {r9('r')} AS residual FROM l1",
        "rvq1d_encode": f"WITH {events_ctes(L, Z)} SELECT event_id, {codes_l} FROM l{L}",
        "rvq1d_encode_plain": f"WITH {events_ctes(L, Z)} SELECT event_id, {plain_l} FROM l{L}",
        "rvq1d_decode_error": f"WITH {events_ctes(L, Z)} SELECT {error_columns('r')} FROM l{L}",
        "scale_stats": f"""WITH {ATOMS_A}, {CENTRED}
            SELECT {r6('sqrt(sum(x * x + y * y + z * z) / (3 * count(*)))')} AS position_scale, {r6('sqrt(sum(fx * fx + fy * fy + fz * fz) / (3 * count(*)))')} AS force_scale,
              (SELECT {r6('avg(energy)')} FROM mols) AS energy_shift, (SELECT {r6('stddev_pop(energy)')} FROM mols) AS energy_scale FROM centred""",
        "centered_positions": f"WITH {ATOMS_B}, {CENTRED} SELECT mol_id, atom_idx::BIGINT AS atom_idx, {', '.join(f'{r6(a)} AS {a}' for a in 'xyz')} FROM centred",
        "morton_codes": f"WITH {SCALED_B}, {morton_ctes('scaled', 'm')} SELECT mol_id, atom_idx::BIGINT AS atom_idx, mc::BIGINT AS mc FROM m",
        "morton_codebook": f"WITH {SCALED_B}, {codebook_ctes('scaled', 'k0', 64)} SELECT 'position' AS channel, 0::BIGINT AS level, code::BIGINT AS code, {', '.join(f'{r6(a)} AS {a}' for a in 'xyz')} FROM k0",
        "rvq3d_encode": f"WITH {SCALED_B}, {two} SELECT mol_id, atom_idx::BIGINT AS atom_idx, c0::BIGINT AS c0, c1::BIGINT AS c1 FROM q1",
        "rvq3d_residual_rms": f"WITH {SCALED_B}, {two} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS level, {r6('sqrt(sum(x * x + y * y + z * z) / (3 * count(*)))')} AS rms FROM q{k}" for k in range(2)),
        "kmeans_codebook": kmeans_sql(q.KMEANS_RUNS, q.KMEANS_STEPS, 8),
        "rvq1d_encode_256": big_scalar_sql(),
        "rvq3d_encode_256": big_position_sql(),
        "vocab_table": f"WITH {ids}, u AS (SELECT unnest(string_split(s, ' '))::BIGINT AS token_id FROM seqs), c AS (SELECT token_id, count(*) AS n_uses FROM u GROUP BY 1) SELECT v.token_id, token, coalesce(n_uses, 0)::BIGINT AS n_uses FROM ({vocab_sql(q.SPACE)}) v LEFT JOIN c USING (token_id)",
        "vocab_info": f"WITH {ids}, u AS (SELECT unnest(string_split(s, ' ')) AS t FROM seqs) SELECT {info_sql()}, count(DISTINCT t)::BIGINT AS n_used, count(*)::BIGINT AS n_tokens FROM u",
        "recon_report_256": big_report_sql()[0],
        "roundtrip_256": big_report_sql()[1],
        "token_ids": f"WITH {ids} SELECT mol_id, ({LENGTH})::BIGINT AS n_tokens, s AS tokens FROM seqs",
        "token_text": f"WITH {txt} SELECT mol_id, s AS text FROM seqs",
        "token_stats": f"WITH {ATOMS_A}, t AS (SELECT mol_id, {LENGTH} AS k FROM (SELECT mol_id, count(atom_idx) AS n FROM mols LEFT JOIN atoms USING (mol_id) GROUP BY 1)) SELECT count(*) AS n_molecules, sum(k)::BIGINT AS n_tokens, min(k)::BIGINT AS min_tokens, max(k)::BIGINT AS max_tokens, round(avg(k), 6) AS mean_tokens, round(quantile_cont(k, 0.5), 6) AS median_tokens FROM t",
        "section_shuffle": f"WITH {ATOMS_A}, c AS (SELECT mol_id, count(atom_idx) AS n FROM mols LEFT JOIN atoms USING (mol_id) GROUP BY 1) SELECT mol_id, list_sort({sections})[1].k::BIGINT AS first_marker, ({LENGTH})::BIGINT AS n_tokens FROM c",
        "decode_tokens": f"WITH {codes} SELECT mol_id, atom_idx::BIGINT AS atom_idx, atomic_number::BIGINT AS atomic_number, {', '.join(f'{r6(f"d{a}")} AS {a}' for a in ('x', 'y', 'z', 'fx', 'fy', 'fz'))}, {r6('denergy')} AS energy FROM acodes JOIN ecodes USING (mol_id)",
        "roundtrip_error": f"""WITH {codes},
            own AS (SELECT mol_id, atom_idx, x AS ox, y AS oy, z AS oz, fx AS ofx, fy AS ofy, fz AS ofz FROM centred),
            re AS (SELECT mol_id, atom_idx, {', '.join(f'round(d{a} - avg(d{a}) OVER (PARTITION BY mol_id), 9) AS r{a}' for a in 'xyz')}, {', '.join(f'df{a}' for a in 'xyz')} FROM acodes),
            er AS (SELECT mol_id, {', '.join(f'o{a} - r{a} AS e{a}' for a in 'xyz')}, {', '.join(f'of{a} - df{a} AS g{a}' for a in 'xyz')} FROM own JOIN re USING (mol_id, atom_idx)),
            agg AS (SELECT mol_id, sqrt(sum(ex * ex + ey * ey + ez * ez) / (3 * count(*))) AS pr, max(greatest(abs(ex), abs(ey), abs(ez))) AS pm, sqrt(sum(gx * gx + gy * gy + gz * gz) / (3 * count(*))) AS fr, max(greatest(abs(gx), abs(gy), abs(gz))) AS fm FROM er GROUP BY 1)
            SELECT mol_id, {r6('pr')} AS pos_rmse, {r9('pm')} AS pos_max, {r6('fr')} AS force_rmse, {r9('fm')} AS force_max, {r6('abs(energy - denergy)')} AS energy_abs, {r6('abs((energy - denergy) / energy)')} AS energy_rel FROM agg JOIN ecodes USING (mol_id)""",
        "recon_report": f"""WITH {codes}, er AS (
            {' UNION ALL '.join(f"SELECT 'position' AS channel, {a} AS e FROM acodes" for a in 'xyz')} UNION ALL {' UNION ALL '.join(f"SELECT 'force', f{a} FROM acodes" for a in 'xyz')} UNION ALL SELECT 'energy', r FROM ecodes)
            SELECT channel, {error_columns('e')} FROM er GROUP BY 1""",
        "prompt_tokens": f"WITH {ATOMS_A}, c AS (SELECT mol_id, count(atom_idx) AS n FROM mols LEFT JOIN atoms USING (mol_id) GROUP BY 1) SELECT mol_id, (n * {q.SPACE.pos_levels + 2} + 6)::BIGINT AS n_prompt, {vocab.FORCE}::BIGINT AS last_token FROM c",
        "parse_defaults": f"""WITH {codes}, per AS (SELECT mol_id, count(*) AS n, sum(abs(dfx) + abs(dfy) + abs(dfz)) AS f FROM acodes GROUP BY 1), al AS (SELECT mol_id, denergy, coalesce(n, 0) AS n, f FROM ecodes LEFT JOIN per USING (mol_id))
            SELECT mol_id, {r6(f'CASE WHEN {bad_cut} THEN 0.0::DOUBLE ELSE denergy END')} AS energy, n::BIGINT AS n_forces, {r6(f'CASE WHEN {bad_cut} THEN 0.0::DOUBLE ELSE f END')} AS force_sum FROM al""",
        "predict_continuation": f"""WITH {codes}, per AS (SELECT mol_id, count(*) AS n, sum(abs(dfx) + abs(dfy) + abs(dfz)) AS f FROM acodes GROUP BY 1), al AS (SELECT mol_id, denergy, coalesce(n, 0) AS n, f FROM ecodes LEFT JOIN per USING (mol_id))
            SELECT mol_id, {r6('CASE WHEN n > 0 AND mol_id % 2 = 0 THEN denergy ELSE 0.0::DOUBLE END')} AS energy, n::BIGINT AS n_forces, {r6('CASE WHEN n > 0 AND mol_id % 2 = 0 THEN f ELSE 0.0::DOUBLE END')} AS force_sum FROM al""",
        "wordlevel_ids": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> '') AS l FROM documents),
            u AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM w), i AS (SELECT doc_id, pos, coalesce(list_position({words}, token), 0) AS id FROM u)
            SELECT doc_id, count(id) AS n_words, count(*) FILTER (WHERE id = 0) AS n_unknown, coalesce(sum(pos * id), 0)::BIGINT AS checksum FROM documents LEFT JOIN i USING (doc_id) GROUP BY 1""",
        "md5_sample": f"SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500",
        "buffered_sample": "SELECT least(500, count(*)) AS n_rows, least(500, count(DISTINCT o_orderkey)) AS n_distinct, least(500, count(o_totalprice)) AS n_in_table FROM orders",
        "train_val_split": f"WITH {split} SELECT o_orderkey, split FROM split",
        "shard_sizes": f"WITH {shards} SELECT split, shard::BIGINT AS shard, count(*) AS n FROM sh GROUP BY 1, 2",
        "shard_members": f"WITH {shards} SELECT o_orderkey, split, shard::BIGINT AS shard FROM sh",
        "offset_split": "WITH i AS (SELECT CASE WHEN k < 100 THEN 'train' ELSE 'val' END AS split, k FROM (SELECT row_number() OVER () - 1 AS k FROM customer) WHERE k < 130) SELECT split, count(*) AS n, min(k)::BIGINT AS first, max(k)::BIGINT AS last FROM i GROUP BY 1",
        "row_index": "SELECT count(*) AS n, count(*) AS n_distinct, 0::BIGINT AS least, (count(*) - 1)::BIGINT AS most FROM orders",
        "published_files": f"WITH {shards} SELECT CASE split WHEN 'val' THEN 'validation' ELSE split END || '-' || lpad(shard::VARCHAR, 5, '0') || '.parquet' AS file, count(*) AS n FROM sh GROUP BY 1",
        "csv_first_rows": f"""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_custkey, c_name || ',' || chr(10) || '"' || c_mktsegment || '"' || chr(10) AS note, {r6('c_acctbal')} AS balance FROM customer ORDER BY c_custkey LIMIT 1000""",
        "nested_json_roundtrip": f"WITH {ATOMS_A} SELECT mol_id, count(atom_idx)::BIGINT AS n, {r6('coalesce(sum(x + y + z), 0.0::DOUBLE)')} AS total FROM mols LEFT JOIN atoms USING (mol_id) GROUP BY mol_id",
        "s2ef_metrics": f"""WITH {ATOMS_B}, p AS (SELECT *, floor(energy / 0.125::DOUBLE) * 0.125::DOUBLE AS pe, {', '.join(f'floor(f{a} / 0.25::DOUBLE) * 0.25::DOUBLE AS p{a}' for a in 'xyz')} FROM atoms),
            n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS lp, sqrt(fx * fx + fy * fy + fz * fz) AS lt FROM p),
            m AS (SELECT mol_id, abs(any_value(pe) - any_value(energy)) AS e, count(*) AS n, {', '.join(f'sum(abs(p{a} - f{a})) AS {a}' for a in 'xyz')}, sum(abs(lp - lt)) AS mg,
              sum(CASE WHEN lp * lt > 0 THEN (px * fx + py * fy + pz * fz) / (lp * lt) ELSE 0.0::DOUBLE END) AS c, max(greatest(abs(px - fx), abs(py - fy), abs(pz - fz))) AS w FROM n GROUP BY 1)
            SELECT {r6('avg(e) * 1000')} AS energy_mae, {r6('avg(e / n) * 1000')} AS energy_mae_per_atom, {r6('sum(x + y + z) / (3 * sum(n)) * 1000')} AS forces_mae,
              {', '.join(f'{r6(f"sum({a}) / sum(n) * 1000")} AS forces{a}_mae' for a in 'xyz')}, {r6('sum(c) / sum(n)')} AS forces_cos, {r6('sum(mg) / sum(n) * 1000')} AS forces_magnitude,
              {r6('avg((e < 0.02::DOUBLE AND w < 0.03::DOUBLE)::INT::DOUBLE)')} AS efwt, count(*) AS n_structures, sum(n)::BIGINT AS n_atoms FROM m""",
        "task_summary": f"WITH {tasks_cte()} " + " UNION ALL ".join(f"SELECT '{t}' AS task, '{h}' AS metric, {h} AS value FROM ({s})" for t, s in TASK_SQL.items() for h in [next(x for x in ("accuracy", "ie_mae_mev", "mae_mev") if f"AS {x}" in s)]),
        "task_distance_detail": f"WITH {tasks_cte()} SELECT group_id, count(*) AS n, string_agg(idx::VARCHAR, ' ' ORDER BY idx) AS distances, {r6('arg_min(pred, idx)')} AS first_pred, {r6('arg_max(target, idx)')} AS last_target FROM ev WHERE task = 'distance_scaling' GROUP BY 1",
        "task_gap_errors": f"WITH {tasks_cte()} SELECT group_id, {r6('triplet_p - singlet_p')} AS pred_gap, {r6('triplet_t - singlet_t')} AS target_gap, {r6('(triplet_p - singlet_p) - (triplet_t - singlet_t)')} AS error FROM {states('spin_gap', 'triplet', 'singlet')} WHERE triplet_p IS NOT NULL AND singlet_p IS NOT NULL",
    }
    return out | {f"task_{name}": f"WITH {tasks_cte()} {sql}" for name, sql in TASK_SQL.items()}
