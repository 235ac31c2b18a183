"""Edge cases of the operators on small tables."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tesserae.functions import order
from tesserae.functions.arrays import morton
from tesserae.functions.rounding import half_away
from tesserae.operators import codebook as cb
from tesserae.operators import corpus, metrics, molecule, predict, scale, vocab
from tesserae.plans import pipelines
from tesserae.queries import BIG_POSITION, BIG_SCALAR, FIXED_BOOKS, FIXED_SCALES, QUERIES, SPACE
from tesserae.sources import files
from tesserae.streaming import encode as stream

MOLECULE = "mol_id long, atomic_numbers array<int>, positions array<array<double>>, forces array<array<double>>, energy double"
ATOMS_END, POS, POS_END, FORCE, FORCE_END, ENERGY, ENERGY_END, NL = 5, 6, 7, 8, 9, 10, 11, 3


def molecules(spark, sizes=(1, 3, 0)):
    rng = np.random.default_rng(3)
    rows = [(k, [1 + 7 * i for i in range(n)], rng.normal(size=(n, 3)).round(4).tolist(), rng.normal(0, 0.1, (n, 3)).round(4).tolist(), -150.0 + k) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, MOLECULE)


def decoded(spark, sequences):
    rows = spark.createDataFrame(list(enumerate(sequences)), "mol_id long, tokens array<int>")
    return {r["mol_id"]: r for r in molecule.decode(rows, FIXED_BOOKS, FIXED_SCALES).collect()}


def whole(atoms=(1,), pos_rows=1, force_rows=1, energy=2):
    p, f, e = SPACE.pos, [SPACE.channel(k) for k in range(3)], SPACE.channel(3)
    return [1, 4, *(11 + a for a in atoms), ATOMS_END, POS, *([p, p + SPACE.size, NL] * pos_rows), POS_END, FORCE, *([f[0], f[0], f[1], f[1], f[2], f[2], NL] * force_rows), FORCE_END, ENERGY, *([e] * energy), NL, ENERGY_END, 2]


@settings(max_examples=200)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=9).map(sorted), st.floats(-6, 6))
def test_codes_count_the_bounds_below(bounds, x):
    book = cb.Levels1D((tuple([0.0] * (len(bounds) + 1)),), (tuple(bounds),))
    assert cb.scalar_codes(np.array([x]), book)[0].item() == sum(b < x for b in bounds)


def test_values_on_bounds_go_to_the_lower_side(spark):
    rows = spark.createDataFrame([(x,) for x in (-9.0, 0.0, 0.5, 1.0, 1.5, 9.0, None)], "x double")
    book = cb.Levels1D(((0.0, 1.0, 2.0, 3.0),), ((0.0, 1.0, 1.0),))
    got = cb.encode_1d(rows, "x", book, residual="r").collect()
    assert [r["c0"] for r in got] == [0, 0, 1, 1, 3, 3, None] and got[-1]["r"] is None and got[-2]["r"] == 6.0
    assert [r["c0"] for r in cb.encode_1d_plain(rows, "x", book).collect()] == [0, 0, 1, 1, 3, 3, None]


def test_morton_interleaves_ten_bits(spark):
    rows = [(x, y, z) for x, y, z in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1023, 1023, 1023), (5, 9, 700))]
    got = [r[0] for r in spark.createDataFrame(rows, "x long, y long, z long").select(morton(F.col("x"), F.col("y"), F.col("z"))).collect()]
    spread = lambda v: sum(((v >> b) & 1) << (3 * b) for b in range(10))
    assert got == [spread(x) | spread(y) << 1 | spread(z) << 2 for x, y, z in rows]


def test_token_counts_follow_the_formula(spark):
    rows = molecule.tokenize(molecules(spark), FIXED_BOOKS, FIXED_SCALES).select("mol_id", F.size("atomic_numbers").alias("n"), F.size("tokens").alias("t")).collect()
    lp, l = SPACE.pos_levels, SPACE.levels
    assert len(rows) == 3 and all(r["t"] == r["n"] * (lp + 3 * l + 3) + l + 11 for r in rows)


def test_round_trip_keeps_atoms_and_bounds_errors(spark):
    source = molecules(spark, (1, 3))
    back = {r["mol_id"]: r for r in molecule.decode(molecule.tokenize(source, FIXED_BOOKS, FIXED_SCALES), FIXED_BOOKS, FIXED_SCALES).collect()}
    for r in source.collect():
        own = back[r["mol_id"]]
        assert own["atomic_numbers"] == r["atomic_numbers"] and not own["error"]
        assert np.abs(np.array(own["forces"]) - np.array(r["forces"])).max() < 0.2
        assert len(own["positions"]) == len(r["positions"])


def test_batches_go_through_in_pieces(spark, monkeypatch):
    """A batch of many molecules is coded and read in slices of bounded size, whole and in order."""
    import pyarrow as pa

    seen = []
    sizes = np.array([3, 0, 5, 9, 1, 1])
    made = molecule._piecewise(lambda a: seen.append(len(a)) or a, 8, sizes, pa.array(range(6)))
    assert made.to_pylist() == list(range(6)) and seen == [3, 1, 2]
    assert molecule._piecewise(lambda a: a, 8, np.zeros(0, int), pa.array([], pa.int64())).to_pylist() == []
    lists = lambda n: pa.array([[[float(k % 7), 0.5, 0.25 * (k % 3)]] * 4 for k in range(n)])
    numbers, energy = pa.array([[1, 6, 7, 8]] * 6000), pa.array(np.arange(6000.0))
    most = []
    lay = molecule._sequencer(SPACE)
    monkeypatch.setattr(molecule, "_sequencer", lambda space: lambda z, n, codes, order: most.append(len(z)) or lay(z, n, codes, order))
    tokens = molecule._tokenizer(FIXED_BOOKS, FIXED_SCALES)(numbers, lists(6000), lists(6000), energy)
    assert max(most) <= molecule.ATOMS_AT_ONCE and sum(most) == 24_000
    whole_ = molecule._reader(FIXED_BOOKS, FIXED_SCALES)(tokens)
    assert len(whole_) == 6000 and whole_.slice(5000, 3).to_pylist() == molecule._reader(FIXED_BOOKS, FIXED_SCALES)(tokens.slice(5000, 3)).to_pylist()


def test_a_filter_on_what_is_read_calls_no_second_function(spark):
    """The round trip, and reading tokens, are one Python call each, whatever is filtered by their errors."""
    calls = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    rows = molecules(spark)
    assert calls(molecule.with_round_trip(rows, FIXED_BOOKS, FIXED_SCALES).where("NOT trip.error").select("mol_id", "trip.positions", "trip.back_forces")) == 1
    sequences = spark.createDataFrame([(1, whole())], "mol_id long, tokens array<int>")
    assert calls(molecule.decode(sequences, FIXED_BOOKS, FIXED_SCALES).where("NOT error").select("positions", "forces")) == 1


def test_the_report_makes_no_row_per_atom_before_it_codes(spark):
    """Codes and errors of a molecule come from one Python call beside the scaling, and its atoms are not rows on the way there."""
    plan = molecule.with_coding_errors(scale.apply_scales(molecules(spark), FIXED_SCALES), FIXED_BOOKS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") <= 2 and "Generate" not in plan
    rows = molecule.with_coding_errors(molecules(spark).withColumn("energy", F.lit(None).cast("double")), FIXED_BOOKS).select("errors").collect()
    assert all(r["errors"]["energy"] is None for r in rows) and sorted(len(r["errors"]["position"]) for r in rows) == [0, 3, 9]


def test_section_shuffle_decodes_to_the_same(spark):
    source = molecules(spark, (2, 3))
    read = lambda seed: sorted(map(str, molecule.decode(molecule.tokenize(source, FIXED_BOOKS, FIXED_SCALES, shuffle_seed=seed), FIXED_BOOKS, FIXED_SCALES).collect()))
    assert read(None) == read(5)


def test_decoder_edge_cases(spark):
    f = [SPACE.channel(k) for k in range(3)]
    no_end = whole()
    no_end.remove(NL)  # the position row's
    carried = whole(force_rows=0)
    at = carried.index(FORCE_END)
    carried[at:at] = [f[1], f[1], f[2], f[2], NL, f[0], f[0], NL]  # y and z wait for x
    got = decoded(spark, [whole(), no_end, carried, [], whole(energy=1), whole()[: whole().index(FORCE) + 1], [0, *whole(), 0], whole(pos_rows=2)])
    assert not got[0]["error"] and got[0]["atomic_numbers"] == [1]
    assert got[1]["error"] and got[1]["positions"] is None
    assert not got[2]["error"] and len(got[2]["forces"]) == 1
    assert all(got[k]["error"] for k in (3, 4, 5))
    assert not got[6]["error"]
    assert len(got[7]["positions"]) == 2


def test_defaults_replace_what_cannot_be_read(spark):
    rows = spark.createDataFrame([(0, whole(), 1), (1, whole(), 2), (2, [], 2)], "mol_id long, tokens array<int>, natoms int")
    got = {r["mol_id"]: r for r in predict.parse_outputs(rows, FIXED_BOOKS, FIXED_SCALES).collect()}
    assert got[1]["forces"] == [[0.0] * 3] * 2 and got[1]["energy"] != 0.0
    assert got[2]["energy"] == 0.0 and got[2]["forces"] == [[0.0] * 3] * 2
    assert len(got[0]["forces"]) == 1


def test_prompts(spark):
    rows = spark.createDataFrame([([1, POS, POS_END, FORCE, 99],), ([1, POS, POS_END, 99],)], "tokens array<int>")
    assert [r[0] for r in rows.select(molecule.prompt(F.col("tokens"))).collect()] == [[1, POS, POS_END, FORCE]] * 2
    with pytest.raises(Exception, match="no prompt"):
        spark.createDataFrame([([1, 2],)], "tokens array<int>").select(molecule.prompt(F.col("tokens"))).collect()


def test_default_vocabulary(spark):
    space = vocab.Space(256, 8, 4)
    rows = vocab.vocabulary(spark, space, unknown=True).collect()
    words = {r["token_id"]: r["token"] for r in rows}
    assert space.vocab_size == 6274 and len(words) == len(set(words.values())) == 6275 and words[6274] == "[UNK]"
    assert words[3] == "[NL]" and words[12] == "[Z=1]" and words[130] == "[P0:0]" and words[6273] == "[E3:255]"


def test_the_vocabulary_is_the_same_by_id_and_by_list(spark):
    space = vocab.Space(256, 8, 4)
    assert [r["token"] for r in vocab.vocabulary(spark, space).orderBy("token_id").collect()] == vocab.texts(space)


def test_words_between_any_white_space(spark):
    docs = spark.createDataFrame([(1, "\tthe  cat\nsat "), (2, ""), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([("the", 1), ("sat", 2)], "token string, token_id int")
    got = sorted((r["doc_id"], r["pos"], r["token_id"]) for r in vocab.word_ids(docs, words, "doc_id", "text", 0).collect())
    assert got == [(1, 0, 1), (1, 1, 0), (1, 2, 2)]


def test_few_significant_values_give_plain_quantiles(spark):
    rows = spark.createDataFrame([(0.0,)] * 5 + [(1.0,)], "r double")
    book = cb.train_1d(rows, "r", 1, 4)
    assert len(book.centroids[0]) == 4 and len(book.bounds[0]) == 3 and list(book.centroids[0]) == sorted(book.centroids[0])


def test_scales_of_constants_are_one(spark):
    s = scale.fit_scales(spark.createDataFrame([(1, [1], [[2.0, 2.0, 2.0]], [[0.0, 0.0, 0.0]], -3.0)], MOLECULE))
    assert (s.position, s.force, s.energy, s.energy_shift) == (1.0, 1.0, 1.0, -3.0)


def test_nearest_takes_the_lowest_index_on_ties():
    book = np.array([[1.0, 0, 0], [-1.0, 0, 0], [1.0, 0, 0]])
    assert cb.nearest(np.array([[0.0, 0, 0], [2.0, 0, 0]]), book).tolist() == [0, 0]


def test_residuals_round_halves_away_from_zero():
    """Vectors whose residual is half a unit of the ninth digit at a level: expected codes are DuckDB's for rvq3d_encode_256."""
    v = np.array([[0.0350341796875, -0.2143678218126297, 0.07085667550563812], [0.17286358773708344, 0.4895208477973938, 0.1787109375]])
    want = [[156, 42, 19, 98, 28, 82, 220, 234], [164, 26, 108, 109, 155, 28, 157, 21]]
    assert cb.encode_vectors(v, [np.array(b, float) for b in BIG_POSITION.vectors])[0].tolist() == want
    x = np.array([0.5, -0.5, 2.5, 0.49999999999999994, np.nan, np.inf, 1e308])
    np.testing.assert_array_equal(half_away(x, 0), [1.0, -1.0, 3.0, 0.0, np.nan, np.inf, 1e308])
    assert half_away(np.array([1e308]))[0] == 1e308


def test_samples_splits_and_shards_are_exact(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert corpus.sample_rows(rows, "k", 37).count() == 37
    split = corpus.split_by_sample(rows, "k", 101)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"val": 101, "train": 899}
    assert {r["split"] for r in corpus.split_by_sample(rows, "k", 5000).collect()} == {"val"}
    shards = files.shard_numbers(split, F.md5(F.col("k").cast("string")), 250)
    got = {(r["split"], r["shard"]): r["count"] for r in shards.groupBy("split", "shard").count().collect()}
    assert got == {("train", 0): 250, ("train", 1): 250, ("train", 2): 250, ("train", 3): 149, ("val", 0): 101}


def test_row_index_runs_over_files(spark, tmp_path):
    spark.range(0, 900, 1, 3).write.parquet(str(tmp_path / "t"))
    got = files.with_row_index(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r["row_idx"] for r in got) == list(range(900))


def test_row_index_keeps_no_row_per_place(spark, tmp_path):
    """The scan's rows are not dealt by their file, and distinct places are grouped 64 at a time."""
    spark.range(0, 1000, 1, 7).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["row_index"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "(distinct" not in plan and "bit_or" in plan
    assert tuple(out.first()) == (1000, 1000, 0, 999)


def test_csv_round_trip_of_nested_columns(spark, tmp_path):
    rows = molecules(spark).select(F.col("mol_id").cast("string").alias("property_id"), "atomic_numbers", "positions", F.col("forces").alias("atomic_forces"), "energy")
    files.write_molecule_csv(rows, str(tmp_path / "m"))
    back = files.read_molecule_csv(spark, str(tmp_path / "m"))
    cols = ["property_id", "atomic_numbers", "positions", "atomic_forces", "energy"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, rows.select(cols).collect()))


def test_train_save_publish(spark, tmp_path):
    source = molecules(spark, (4, 5, 6, 7, 8, 9))
    books, scales = pipelines.train(source, size=4, pos_levels=2, levels=2, cap=None)
    pipelines.save_codebooks(spark, books, scales, str(tmp_path / "books"))
    again = pipelines.read_codebooks(spark, str(tmp_path / "books"))
    assert again == (books, scales)
    pipelines.publish(source, books, scales, str(tmp_path / "out"), val_size=2, shard_size=3)
    out = spark.read.parquet(str(tmp_path / "out/data"))
    assert {r["f"]: r["count"] for r in out.groupBy(F.col("_metadata.file_name").alias("f")).count().collect()} == {"train-00000.parquet": 3, "train-00001.parquet": 1, "validation-00000.parquet": 2}


def test_predictors_run_once_per_task_and_targets_join_by_key(spark):
    rows = molecules(spark, (1, 2)).select(F.col("mol_id").cast("string").alias("id"), "atomic_numbers", "positions", "energy", "forces", F.size("atomic_numbers").alias("natoms"))

    def make():
        return lambda batch: pd.DataFrame({"id": batch["id"], "energy": 0.0, "forces": [[[0.0] * 3] * int(n) for n in batch["natoms"]]})

    got = metrics.s2ef(predict.predict(rows, make), rows).first().asDict()
    assert got["n_structures"] == 2 and got["n_atoms"] == 3
    assert math.isfinite(got["energy_mae"]) if "energy_mae" in got else True


def test_empty_tables(spark):
    none = molecules(spark, ())
    assert molecule.tokenize(none, FIXED_BOOKS, FIXED_SCALES).count() == 0
    assert molecule.decode(molecule.tokenize(none, FIXED_BOOKS, FIXED_SCALES), FIXED_BOOKS, FIXED_SCALES).count() == 0
    assert corpus.split_by_sample(none, "mol_id", 3).count() == 0


# Exact order statistics


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), np.zeros(2000), rng.normal(size=500) * 1e9, [1e-300, -1e300]]).tolist()
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    at = [0.0, 0.01, 1 / 3, 0.5, 0.9, 1.0]
    got = order.quantiles(df, "x", at)[()][0]
    assert np.allclose(got, np.quantile(values, at), rtol=1e-12, atol=1e-300)


def test_order_values_cut_cells_until_few_rows_are_left(spark, monkeypatch):
    monkeypatch.setattr(order, "CELLS", 4)
    monkeypatch.setattr(order, "COLLECTED", 3)
    rng = np.random.default_rng(6)
    values = sorted([*rng.integers(-50, 50, 200).tolist(), *[7] * 100, -(2**59), 2**59, 2**59 + 1, 2**59 + 2])
    df = spark.createDataFrame([(x, x % 2) for x in values], "x long, g long")
    n, got = order.order_values(df, "x", range)[()]
    assert n == len(values) and {r: v for r, (v, _) in got.items()} == dict(enumerate(values))
    assert all(below == sum(v < values[r] for v in values) for r, (_, below) in got.items())
    groups = order.order_values(df, "x", range, ["g"])
    assert all({r: v for r, (v, _) in groups[g,][1].items()} == dict(enumerate(x for x in values if x % 2 == g)) for g in (0, 1))
    assert order.order_values(df.limit(0), "x", range).get((), (0, {}))[1] == {}
    assert order.quantiles(df.limit(0), "x", [0.5])[()] == (None, ())


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    got = order.order_values(df, "x", range)[()][1]
    assert [got[0][0], got[1][0]] == [1.0, 2.0] and math.isnan(got[2][0])


def test_error_summary_of_groups(spark):
    rows = [("a", -1.0), ("a", 3.0), ("a", 2.0), (None, 5.0)]
    got = {r["g"]: r for r in metrics.error_summary(spark.createDataFrame(rows, "g string, e double"), F.col("e"), ["g"]).collect()}
    assert (got["a"]["mae"], got["a"]["median_error"], got["a"]["max_error"]) == (2.0, 2.0, 3.0) and got[None]["median_error"] == 5.0
    none = metrics.error_summary(spark.createDataFrame([], "e double"), F.col("e")).collect()
    assert len(none) == 1 and none[0]["median_error"] is None


def test_exact_subsamples(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.rand(1).alias("r"))
    some = cb.sample_exact(rows, "k", 40, seed=3)
    assert some.count() == 40 and sorted(map(str, some.collect())) == sorted(map(str, cb.sample_exact(rows, "k", 40, seed=3).collect()))
    assert cb.sample_exact(rows, "k", 40, seed=4).intersect(some).count() < 40 and cb.sample_exact(rows, "k", 9000).count() == 500
    assert cb.train_1d(rows, "r", 1, 8, key="k", cap=40, seed=3) == cb.train_1d(some, "r", 1, 8)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan


# Scaling and coding at scale


def test_centring_costs_the_same_per_atom_whatever_the_molecule(spark):
    def seconds(atoms):
        rng = np.random.default_rng(1)
        rows = [(k, [1] * atoms, rng.normal(size=(atoms, 3)).tolist(), rng.normal(size=(atoms, 3)).tolist(), 0.0) for k in range(40_000 // atoms)]
        df = spark.createDataFrame(rows, MOLECULE).repartition(4).cache()
        df.count()
        out = scale.apply_scales(df, FIXED_SCALES)
        run = lambda: out.write.format("noop").mode("overwrite").save()
        run()
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    small, large = seconds(50), seconds(2000)
    assert large < 4 * small + 0.5


def test_plans_hold_no_aggregate_inside_a_lambda_and_move_no_rows(spark):
    source = molecules(spark, (2, 3))
    for df in (scale.with_centred(source), scale.apply_scales(source, FIXED_SCALES), molecule.decode(molecule.tokenize(source, FIXED_BOOKS, FIXED_SCALES), FIXED_BOOKS, FIXED_SCALES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "aggregate(" not in plan and "Window" not in plan


def test_default_shapes_code_and_decode(spark):
    rng = np.random.default_rng(2)
    books = {"position": BIG_POSITION, **{f"force_{a}": BIG_SCALAR for a in "xyz"}, "energy": BIG_SCALAR}
    rows = [(k, [6] * n, rng.normal(size=(n, 3)).tolist(), rng.normal(size=(n, 3)).tolist(), float(k)) for k, n in enumerate((1, 17, 300))]
    source, scales = spark.createDataFrame(rows, MOLECULE), scale.Scales(1.0, 1.0, 0.0, 1.0)
    tokens = molecule.tokenize(source, books, scales)
    assert {r["mol_id"]: r["n"] for r in tokens.select("mol_id", F.size("tokens").alias("n")).collect()} == {k: 23 * n + 15 for k, n in enumerate((1, 17, 300))}
    back = {r["mol_id"]: r for r in molecule.decode(tokens, books, scales).collect()}
    for k, _, p, f, e in rows:
        assert np.abs(np.array(back[k]["forces"]) - f).max() < 1e-6 and abs(back[k]["energy"] - e) < 1e-6
        assert np.abs(np.array(back[k]["positions"]) - (np.array(p) - np.mean(p, axis=0))).max() < 0.1
    coded = molecule.encode_codes(scale.apply_scales(source, scales), books).select("mol_id", "codes").collect()
    assert [(len(r["codes"]["pos"]), len(r["codes"]["pos"][0]), len(r["codes"]["fx"][0]), len(r["codes"]["en"])) for r in sorted(coded)] == [(n, 8, 4, 4) for n in (1, 17, 300)]


def test_lists_of_different_lengths_fail(spark):
    rows = spark.createDataFrame([(1, [1, 2], [[0.0] * 3], [[0.0] * 3], 0.0)], MOLECULE)
    with pytest.raises(Exception, match="differ in length"):
        molecule.tokenize(rows, FIXED_BOOKS, FIXED_SCALES).collect()


def read_by_hand(tokens):
    """The decoder's rules, token by token."""
    f, e, K = [SPACE.channel(k) for k in range(3)], SPACE.channel(3), SPACE.size
    atoms, pos, forces, energy, section = [], [], [[], [], []], [], None
    here, axes = [], [[], [], []]
    for t in tokens:
        if t in (1, 2):
            continue
        if 4 <= t <= 11:
            section = t if t in (4, POS, FORCE, ENERGY) else None
            here, axes = [], [[], [], []]
        elif section == 4:
            if 12 <= t < 130:
                atoms.append(t - 11)
        elif section == POS:
            if t == NL:
                if here:
                    pos.append(here)
                here = []
            else:
                here.append((t - SPACE.pos) % K)
        elif section == FORCE:
            if t == NL:
                if axes[0]:
                    for out, own in zip(forces, axes):
                        if own:
                            out.append(own)
                    axes = [[], [], []]
            elif t >= f[0]:
                k = 2 if t >= f[2] else 1 if t >= f[1] else 0
                axes[k].append((t - f[k]) % K)
        elif section == ENERGY and t != NL:
            energy.append((t - e) % K)
    short = any(len(c) < SPACE.pos_levels for c in pos) or any(len(c) < SPACE.levels for c in [*forces[0], *forces[1], *forces[2], energy])
    bad = short or not pos or not forces[0] or len({*map(len, forces)}) > 1
    if bad:
        return atoms, None, None, None, True
    value = lambda book, codes: sum(level[c] for level, c in zip(book.centroids, codes))
    xyz = [[FIXED_SCALES.position * sum(level[c][i] for level, c in zip(FIXED_BOOKS["position"].vectors, codes)) for i in range(3)] for codes in pos]
    force = [[FIXED_SCALES.force * value(FIXED_BOOKS["force_x"], own[k]) for own in forces] for k in range(len(forces[0]))]
    return atoms, xyz, force, value(FIXED_BOOKS["energy"], energy) * FIXED_SCALES.energy + FIXED_SCALES.energy_shift, False


def test_random_malformed_sequences_follow_the_rules(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        seq = whole(atoms=[rng.randrange(1, 9) for _ in range(rng.randrange(3))], pos_rows=rng.randrange(3), force_rows=rng.randrange(3), energy=rng.choice([0, 1, 2, 2, 3]))
        for _ in range(rng.choice([0, 1, 2, 6])):
            at, what = rng.randrange(len(seq)), rng.randrange(4)
            seq[at : at + (what > 0)] = [[rng.randrange(SPACE.vocab_size + 5)], [], [rng.randrange(12)], [NL]][what]
        if k % 7 == 0:
            seq = seq + seq[rng.randrange(len(seq)) :]
        rows.append((k, seq))
    got = {r["mol_id"]: r for r in molecule.decode(spark.createDataFrame(rows, "mol_id long, tokens array<int>"), FIXED_BOOKS, FIXED_SCALES).collect()}
    good = 0
    for k, seq in rows:
        atoms, pos, force, energy, bad = read_by_hand(seq)
        r = got[k]
        assert (r["atomic_numbers"], r["error"], r["positions"] is None, r["energy"] is None) == (atoms, bad, bad, bad), (seq, r)
        if not bad:
            good += 1
            assert np.allclose(r["positions"], pos) and np.allclose(r["forces"], force) and r["energy"] == pytest.approx(energy)
    assert 50 < good < 550
    odd = molecule.decode(spark.createDataFrame([(1, None), (2, [None, 1, None])], "mol_id long, tokens array<int>"), FIXED_BOOKS, FIXED_SCALES).collect()
    assert all(r["error"] and r["atomic_numbers"] == [] for r in odd)


# k-means


def test_kmeans_fills_up_and_beats_a_plain_lloyd(spark):
    few = spark.createDataFrame([(float(x % 3),) for x in range(30)], "r double")
    book = cb.train_1d_kmeans(few, "r", 2, 8, restarts=1)
    assert len(book.centroids[0]) == 8 and set(book.centroids[0]) == {0.0, 1.0, 2.0}
    assert [r["c0"] for r in cb.encode_1d(few.distinct().orderBy("r"), "r", book).collect()] == sorted({r["c0"] for r in cb.encode_1d(few, "r", book).collect()})
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.1, (60, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 0), (0, 0, 3))])
    df = spark.createDataFrame(points.tolist(), "x double, y double, z double")
    cost = lambda centres: ((points - centres[cb.nearest(points, centres)]) ** 2).sum()
    best = np.inf
    for seed in range(10):
        centres = points[np.random.default_rng(seed).choice(len(points), 4, replace=False)]
        for _ in range(30):
            own = cb.nearest(points, centres)
            centres = np.array([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(4)])
        best = min(best, cost(centres))
    assert cost(np.array(cb.kmeans_vectors(df, ["x", "y", "z"], 4, seed=1))) <= best * 1.01


def test_scalar_kmeans_trains_on_its_cap(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.col("id").cast("double").alias("r"))
    some = cb.sample_exact(rows, "k", 5, seed=2)
    assert set(cb.train_1d_kmeans(rows, "r", 1, 5, "k", 5, 2, restarts=3).centroids[0]) == {r["r"] for r in some.collect()}


# Whole jobs


def test_train_by_kmeans(spark):
    books, _ = pipelines.train(molecules(spark, (4, 5, 6)), size=3, pos_levels=1, levels=1, cap=10, method="kmeans")
    assert len(books["position"].vectors[0]) == 3 and all(len(books[c].centroids[0]) == 3 for c in ("force_x", "force_y", "force_z", "energy"))


def test_serialize_and_read_the_corpus(spark, tmp_path):
    source = molecules(spark, (1, 3))
    seen = Observation("serialize")
    stats = pipelines.serialize(source, FIXED_BOOKS, FIXED_SCALES, str(tmp_path / "c"), seen).first()
    assert seen.get == {"rows": 2, "tokens": stats["n_tokens"]}
    rows, info = files.read_corpus(spark, str(tmp_path / "c"))
    assert stats["n_molecules"] == rows.count() == 2 and stats["n_tokens"] == sum(len(r["tokens"]) for r in rows.collect())
    assert info["vocab_size"] == SPACE.vocab_size and info["pos_start"] == SPACE.pos


def test_sampler_job(spark, tmp_path):
    rows = molecules(spark, [1 + k % 2 for k in range(50)]).select(F.concat(F.lit("p"), "mol_id").alias("property_id"), "atomic_numbers", "positions", F.col("forces").alias("atomic_forces"), "energy", F.lit(1).alias("other"))
    rows.write.parquet(str(tmp_path / "in"))
    pipelines.sample_to_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), n=20, seed=3)
    back = files.read_molecule_csv(spark, str(tmp_path / "out"))
    assert back.count() == 20 and tuple(back.columns) == (*files.SAMPLE_COLUMNS, "row_idx")
    want = {r["property_id"]: r for r in rows.collect()}
    assert all(want[r["property_id"]]["positions"] == r["positions"] for r in back.collect())
    first = files.read_molecule_csv(spark, str(tmp_path / "out"), max_rows=5)
    assert [r["property_id"] for r in first.orderBy("row_idx").collect()] == [r["property_id"] for r in back.orderBy("row_idx").collect()][:5]
    assert files.read_molecule_parquet(spark, str(tmp_path / "in")).columns == ["atomic_numbers", "positions", "atomic_forces", "energy"]


def test_evaluation_of_a_file(spark, tmp_path):
    def zeros():
        return lambda batch: pd.DataFrame({"id": batch["id"], "energy": 0.0, "forces": [[[0.0] * 3] * int(n) for n in batch["natoms"]]})

    molecules(spark, (1, 2, 3)).select("atomic_numbers", "positions", "forces", F.col("energy").alias("total_energy")).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = files.read_evaluation(spark, str(tmp_path / "in"))
    assert sorted(r["id"] for r in rows.collect()) == ["0", "1", "2"] and {"energy", "forces"} <= set(rows.columns)
    assert files.read_evaluation(spark, str(tmp_path / "in"), max_samples=2).count() == 2
    assert "energy" not in files.read_evaluation(spark, str(tmp_path / "in"), split="test").columns
    got = pipelines.evaluate_file(spark, str(tmp_path / "in"), zeros, str(tmp_path / "out")).first()
    assert got["n_structures"] == 3 and got["energy_mae"] == pytest.approx(149_000.0)
    assert spark.read.json(str(tmp_path / "out" / "s2ef")).first()["n_atoms"] == 6
    assert sorted(r["natoms"] for r in spark.read.parquet(str(tmp_path / "out" / "predictions")).collect()) == [1, 2, 3]
    assert pipelines.evaluate_file(spark, str(tmp_path / "in"), zeros, str(tmp_path / "test"), split="test") is None
    assert pipelines.evaluate(rows, zeros, str(tmp_path / "r")).first()["n_structures"] == spark.read.json(str(tmp_path / "r")).first()["n_structures"] == 3


def test_a_failing_task_does_not_stop_the_others(spark, tmp_path):
    rows = [("conformers", 1, "", 0, 1.0, 2.0), ("conformers", 1, "", 1, 0.5, 1.0), ("spin_gap", 1, "singlet", 0, 1.0, 1.0), ("ligand_pocket", 1, "complex", 0, 2.0, 3.0)]
    table = spark.createDataFrame(rows, "task string, group_id long, state string, idx long, pred double, target double")
    broken = table.withColumn("pred", F.when(F.col("task") == "spin_gap", F.raise_error(F.lit("broken rows"))).otherwise(F.col("pred")))
    got = metrics.run_tasks(broken, ["conformers", "no such task", "spin_gap", "ligand_pocket"])
    assert set(got) == {"conformers", "spin_gap", "ligand_pocket"} and "broken rows" in got["spin_gap"]["error"]
    out = {r["task"]: (r["metric"], r["value"]) for r in pipelines.evaluate_tasks(broken, str(tmp_path / "t"), got).collect()}
    assert out == {"conformers": ("accuracy", 1.0), "spin_gap": ("error", None), "ligand_pocket": ("mae_mev", 1000.0)}
    assert "broken rows" in spark.read.json(str(tmp_path / "t" / "spin_gap")).first()["error"]
    assert spark.read.json(str(tmp_path / "t" / "ligand_pocket")).first()["n"] == 1 and spark.read.json(str(tmp_path / "t" / "summary")).count() == 3


def test_reports_by_split(spark):
    source = molecules(spark, (2, 3, 4)).withColumn("split", F.when(F.col("mol_id") == 0, "val").otherwise("train"))
    by = {(r["split"], r["channel"]): r for r in pipelines.reconstruction_report(source, FIXED_BOOKS, FIXED_SCALES, split="split").collect()}
    assert set(by) == {(s, c) for s in ("val", "train") for c in ("position", "force", "energy")}
    whole_ = {r["channel"]: r for r in pipelines.reconstruction_report(source, FIXED_BOOKS, FIXED_SCALES).collect()}
    assert all(whole_[c]["max_error"] == max(by[s, c]["max_error"] for s in ("val", "train")) for c in whole_)


def test_vocabulary_files_and_texts(spark, tmp_path):
    vocab.write_tokenizer(spark, SPACE, str(tmp_path / "v"))
    rows = spark.read.json(str(tmp_path / "v")).collect()
    assert len(rows) == SPACE.vocab_size + 1 and {r["role"]: r["token"] for r in rows if r["role"]} == {"pad": "[PAD]", "bos": "[BOS]", "eos": "[EOS]", "unk": "[UNK]"}
    tokens = spark.createDataFrame([([1, NL, -1, SPACE.vocab_size],)], "t array<int>")
    text = lambda **k: tokens.select(vocab.tokens_to_text(F.col("t"), SPACE, **k)).first()[0]
    assert text() == f"[BOS] [NL] [UNK:-1] [UNK:{SPACE.vocab_size}]" and text(pretty=True) == f"[BOS] \n [UNK:-1] [UNK:{SPACE.vocab_size}]"


# Streams


def test_streams_tokenise_like_tables(spark, tmp_path):
    source = molecules(spark, (1, 2, 3))
    source.write.parquet(str(tmp_path / "in"))
    want = sorted(map(str, molecule.tokenize(source, FIXED_BOOKS, FIXED_SCALES).select("mol_id", "tokens").collect()))
    stream.stream_tokens(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"), FIXED_BOOKS, FIXED_SCALES, MOLECULE).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    seen = []
    stream.stream_batches(spark, str(tmp_path / "in"), str(tmp_path / "at2"), FIXED_BOOKS, FIXED_SCALES, MOLECULE, lambda df, k: seen.extend(map(str, df.collect()))).awaitTermination()
    assert sorted(seen) == want


# Exact order statistics and codebook training at any shape of data


@pytest.mark.parametrize("collected, sketch", [(50_000, 65_535), (100, 64), (400, 512)])
def test_quantiles_by_brackets_and_their_fallback(spark, monkeypatch, collected, sketch):
    monkeypatch.setattr(order, "COLLECTED", collected)
    monkeypatch.setattr(order, "SKETCH", sketch)
    monkeypatch.setattr(order, "SKETCH_ERROR", 0.01)
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=3000), "b": np.r_[np.zeros(2000), rng.normal(size=500)], "c": np.array([2.0]), "d": np.full(700, -1.5)}
    rows = [(g, float(v)) for g, vs in x.items() for v in vs] + [("a", None), (None, 3.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = [0.0, 0.013, 0.25, 0.5, 0.99, 1.0]
    got = order.quantiles(df, "x", at, ["g"], also=[F.count("*"), F.max("x")])
    for g, v in (*x.items(), (None, [3.0])):
        assert got[g,][0] == pytest.approx(np.quantile(v, at).tolist(), abs=1e-12) and got[g,][1][1] == max(v)
    assert got["e",] == (None, (1, None)) and got["a",][1][0] == 3001
    assert order.quantiles(df, "x", [0.5], ["g"], least=600)["b",][0] == [0.0] and order.quantiles(df, "x", [0.5], ["g"], least=600)["c",][0] is None
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert order.quantiles(nan, "x", [0.0, 0.5])[()][0] == [1.0, 2.0] and math.isnan(order.quantiles(nan, "x", [1.0])[()][0][0])


def test_ranks_among_equal_values_are_dealt_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("mc"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v")).repartition(6)
    seen = []
    whole = cb.written
    try:
        cb.written = lambda rows, name: seen.append(whole(rows, name)) or seen[-1]
        got = {r["rank"]: r["key"] for r in cb.pick_ranks(df, ["mc", "key"], [0, 5, 9_999, 19_999, 19_999], 4096, task_rows=2_000).collect()}
    finally:
        cb.written = whole
    keys = sorted(f"k{i}" for i in range(20_000))
    assert got == {r: keys[r] for r in (0, 5, 9_999, 19_999)}
    sizes = sorted(r["count"] for r in seen[0].groupBy(F.shiftright("__at", 33)).count().collect())
    assert len(sizes) == 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_equal_vectors_train_without_a_cap(spark):
    df = spark.range(500).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"), F.col("id").cast("string").alias("k"))
    assert cb.train_3d(df, 1, 8, ["k"], cap=None).vectors == (((0.0, 0.0, 0.0), *[(1.0, 2.0, 3.0)] * 7),)


def test_lloyd_steps_equal_numpy_and_refill_empty_centres(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 3)).round(4)
    df = spark.createDataFrame(v.tolist(), "x double, y double, z double").repartition(7)
    centres = {0: v[:4], 3: np.r_[v[10:13], [[90.0, 0.0, 0.0]]]}
    for run, (after, cost) in cb.lloyd_step(df, ["x", "y", "z"], centres).items():
        d = np.square(v[:, None] - centres[run][None]).sum(axis=2)
        code = d.argmin(axis=1)
        want = [v[code == k].mean(axis=0) if (code == k).any() else v[d.min(axis=1).argmax()] for k in range(4)]
        assert np.allclose(after, want, atol=1e-9) and cost == pytest.approx(d.min(axis=1).sum())
    seeds = {k: v[k * 5 : k * 5 + 5] for k in range(3)}
    one = cb.kmeans_vectors(df, ["x", "y", "z"], 5, 1, seeds=seeds)
    assert one == cb.kmeans_vectors(df.repartition(2), ["x", "y", "z"], 5, 1, seeds=seeds) and len(set(one)) == 5
    assert cb.kmeans_vectors(df.limit(0), ["x", "y", "z"], 3, 1) == [(0.0, 0.0, 0.0)] * 3
    apart = spark.createDataFrame([(float(100 * (i % 6)) + 0.01 * (i % 7), 0.0, 0.0) for i in range(600)], "x double, y double, z double")
    assert sorted(round(c[0] / 100) for c in cb.kmeans_vectors(apart, ["x", "y", "z"], 6, 2, restarts=2)) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("book", [BIG_POSITION.vectors[0], BIG_POSITION.vectors[3], tuple((float(k % 3), 0.0, float(k // 3)) for k in range(100)), ((1.0, 1.0, 1.0),) * 70])
def test_code_cells_give_the_codes_of_the_whole_book(book):
    rng, book = np.random.default_rng(2), np.array(book)
    spread = np.abs(book).max() * 1.3 + 0.1
    v = np.r_[rng.uniform(-spread, spread, (5000, 3)), book, (book[:-1] + book[1:]) / 2, np.round(rng.uniform(-spread, spread, (500, 3)) * 2) / 2, [[9e9, 0, 0], [np.inf, 0, 0], [np.nan, 0, 0]]]
    d = sum(np.square(v[:, i, None] - book[None, :, i]) for i in range(3))
    assert cb.nearest(v, book).tolist() == d.argmin(axis=1).tolist()


def test_tasks_of_one_scan_equal_single_ones(spark, sf_dir):
    from tesserae.sources.fixtures import task_energies

    rows = task_energies(spark, sf_dir)
    together = metrics.run_tasks(rows)
    for name, made in together.items():
        one = metrics.run_tasks(rows, [name])[name]
        assert made.columns == one.columns and made.first().asDict() == pytest.approx(one.first().asDict())
    none = metrics.run_tasks(rows.limit(0))
    assert {t: r.first()[-1] for t, r in none.items()} == dict.fromkeys(metrics.TASKS, 0) and len(together) == 7


def test_words_of_a_vocabulary_too_large_for_the_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat the dog"), (2, None), (3, "")], "doc_id long, text string")
    words = spark.createDataFrame([("the", 7), ("dog", 9)], "token string, token_id int")
    ids = lambda: sorted(map(tuple, vocab.word_ids(docs, words, "doc_id", "text", 0).collect()))
    small = ids()
    assert [r["ids"] for r in vocab.word_id_lists(docs, words, "text", 0).orderBy("doc_id").collect()] == [[7, 0, 7, 9], [], []]
    monkeypatch.setattr(vocab, "MAX_WORDS", 1)
    assert ids() == small == [(1, 0, 7), (1, 1, 0), (1, 2, 7), (1, 3, 9)]
    with pytest.raises(ValueError, match="do not go to every task"):
        vocab.word_id_lists(docs, words, "text", 0)
