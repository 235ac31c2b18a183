"""Registered queries: each runs operators of the library over whole tables and returns a flat, rounded result."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.arrays import draw, parse_vectors
from tesserae.operators import codebook as cb
from tesserae.operators import corpus, metrics, molecule, predict, scale, vocab
from tesserae.plans.pipelines import publish, reconstruction_report
from tesserae.sources import buffered
from tesserae.sources import fixtures as fx
from tesserae.sources.csv_ranges import read_csv_rows
from tesserae.sources.files import shard_numbers, with_row_index
from tesserae.sources.shared import shared_path

# Codebooks made from a rule, for the queries that do not train: K = 8 codes, two levels everywhere.
K, POS_LEVELS, LEVELS = 8, 2, 2
CUBES, STEPS = (2.0, 0.75), (0.5, 0.125)
FIXED_POSITION = cb.Levels3D(tuple(tuple(tuple(((k >> i) % 2) * a - a / 2 for i in range(3)) for k in range(K)) for a in CUBES))
_CENTROIDS = tuple(tuple((k - 3.5) * s for k in range(K)) for s in STEPS)
FIXED_SCALAR = cb.Levels1D(_CENTROIDS, tuple(tuple((a + b) / 2 for a, b in zip(c, c[1:], strict=False)) for c in _CENTROIDS))
FIXED_BOOKS = {"position": FIXED_POSITION, "force_x": FIXED_SCALAR, "force_y": FIXED_SCALAR, "force_z": FIXED_SCALAR, "energy": FIXED_SCALAR}
FIXED_SCALES = scale.Scales(1.5, 0.1, -150.0, 80.0)
SPACE = vocab.Space(K, POS_LEVELS, LEVELS)
EVENT_SIZE, EVENT_LEVELS = 16, 3
KMEANS_RUNS, KMEANS_STEPS = 10, 12
#: Words of the small word-level vocabulary; their ids follow from 1, unknown words are 0.
WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "de", "la", "que", "der", "die", "und", "le", "les", "des")


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r9(c: Column | str) -> Column:
    """Nine digits, for what is a difference of nine-digit numbers: six would meet halves."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").select("event_id", "value")
    s = rows.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    return rows.select("event_id", F.round((F.col("value") - F.lit(s["m"])) / F.lit(s["s"]), 9).alias("r"))


def rvq1d_level1(spark, sf_dir):
    rows = _events(spark, sf_dir)
    out = cb.encode_1d(rows, "r", cb.train_1d(rows, "r", 1, EVENT_SIZE), residual="left_over")
    return out.select("event_id", big("c0").alias("code"), r9("left_over").alias("residual"))


def rvq1d_encode(spark, sf_dir):
    rows = _events(spark, sf_dir)
    out = cb.encode_1d(rows, "r", cb.train_1d(rows, "r", EVENT_LEVELS, EVENT_SIZE))
    return out.select("event_id", *(big(f"c{k}").alias(f"c{k}") for k in range(EVENT_LEVELS)))


def rvq1d_encode_plain(spark, sf_dir):
    rows = _events(spark, sf_dir)
    out = cb.encode_1d_plain(rows, "r", cb.train_1d(rows, "r", EVENT_LEVELS, EVENT_SIZE))
    return out.select("event_id", *(big(f"c{k}").alias(f"c{k}") for k in range(EVENT_LEVELS)))


def rvq1d_decode_error(spark, sf_dir):
    rows = _events(spark, sf_dir)
    book = cb.train_1d(rows, "r", EVENT_LEVELS, EVENT_SIZE)
    back = cb.encode_1d(rows, "r", book).withColumn("back", cb.decode_1d([F.col(f"c{k}") for k in range(EVENT_LEVELS)], book))
    out = metrics.error_summary(back, F.col("r") - F.col("back"))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def _big_scalar(levels: int = 4, size: int = 256) -> cb.Levels1D:
    """A codebook of the default shape, made from a rule: even steps that shrink from level to level."""
    levels_ = [[(k - (size - 1) / 2) * 8.0 / size ** (1 + level) for k in range(size)] for level in range(levels)]
    return cb.Levels1D(tuple(map(tuple, levels_)), tuple(tuple((a + b) / 2 for a, b in zip(c, c[1:], strict=False)) for c in levels_))


BIG_SCALAR = _big_scalar()
#: 256 vectors a level: a grid of 4 x 8 x 8 that shrinks from level to level.
BIG_POSITION = cb.Levels3D(tuple(tuple((((k >> 6) - 1.5) * 2.0 / 4**level, ((k >> 3) % 8 - 3.5) / 4**level, (k % 8 - 3.5) / 4**level) for k in range(256)) for level in range(8)))


BIG_BOOKS = {"position": BIG_POSITION, "force_x": BIG_SCALAR, "force_y": BIG_SCALAR, "force_z": BIG_SCALAR, "energy": BIG_SCALAR}


def rvq1d_encode_256(spark, sf_dir):
    """Every event at the default shape of a scalar channel: 256 codes, four levels, nothing trained."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 100 - 2, 9).alias("r"))
    return cb.encode_1d(rows, "r", BIG_SCALAR).select("event_id", *(big(f"c{k}").alias(f"c{k}") for k in range(4)))


def rvq3d_encode_256(spark, sf_dir):
    """Every atom at the default shape of positions: 256 codes, eight levels, nothing trained."""
    out = cb.encode_3d(fx.vector_atoms(spark, sf_dir), BIG_POSITION)
    return out.select("mol_id", big("atom_idx").alias("atom_idx"), *(big(F.get("codes", F.lit(k))).alias(f"c{k}") for k in range(8)))


def scale_stats(spark, sf_dir):
    out = scale.scale_frame(fx.order_molecules(spark, sf_dir))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def centered_positions(spark, sf_dir):
    out = fx.explode_atoms(scale.with_centred(fx.vector_molecules(spark, sf_dir)))
    return out.select("mol_id", big("atom_idx").alias("atom_idx"), *(r6(c).alias(c) for c in "xyz"))


def _scaled_atoms(spark, sf_dir) -> DataFrame:
    rows = fx.vector_molecules(spark, sf_dir)
    return fx.explode_atoms(scale.apply_scales(rows, scale.fit_scales(rows)))


def morton_codes(spark, sf_dir):
    return cb.with_morton(_scaled_atoms(spark, sf_dir)).select("mol_id", big("atom_idx").alias("atom_idx"), "mc")


def _book_rows(spark, books) -> DataFrame:
    out = cb.codebook_table(spark, books)
    return out.select("channel", big("level").alias("level"), big("code").alias("code"), *(r6(F.get("vec", F.lit(i))).alias(a) for i, a in enumerate("xyz")))


def morton_codebook(spark, sf_dir):
    return _book_rows(spark, {"position": cb.train_3d(_scaled_atoms(spark, sf_dir), 1, 64, ["mol_id", "atom_idx"])})


def rvq3d_encode(spark, sf_dir):
    atoms = _scaled_atoms(spark, sf_dir)
    out = cb.encode_3d(atoms, cb.train_3d(atoms, 2, 16, ["mol_id", "atom_idx"]))
    return out.select("mol_id", big("atom_idx").alias("atom_idx"), *(big(F.get("codes", F.lit(k))).alias(f"c{k}") for k in range(2)))


def rvq3d_residual_rms(spark, sf_dir):
    atoms = _scaled_atoms(spark, sf_dir)
    left = cb.encode_3d(atoms, cb.train_3d(atoms, 2, 16, ["mol_id", "atom_idx"]), keep_squares=True)
    levels = left.select(F.posexplode("squares").alias("level", "square")).groupBy("level")
    return levels.agg(F.sqrt(F.sum("square") / (3 * F.count("*"))).alias("rms")).select(big("level").alias("level"), r6("rms").alias("rms"))


def kmeans_codebook(spark, sf_dir):
    atoms = _scaled_atoms(spark, sf_dir)
    seeds = cb.digest_seeds(atoms, ["x", "y", "z"], ["mol_id", "atom_idx"], 8, seed=1, restarts=KMEANS_RUNS)
    book = cb.kmeans_vectors(atoms, ["x", "y", "z"], 8, seed=1, steps=KMEANS_STEPS, seeds=seeds)
    return _book_rows(spark, {"position": cb.Levels3D((tuple(book),))})


def vocab_table(spark, sf_dir):
    """The whole vocabulary, with how often the orders' sequences use each token."""
    return vocab.token_uses(_tokens(spark, sf_dir), SPACE).select(big("token_id").alias("token_id"), "token", "n_uses")


def vocab_info(spark, sf_dir):
    """What describes the vocabulary, and how many of its tokens the orders' sequences use."""
    used = _tokens(spark, sf_dir).select(F.explode("tokens").alias("t")).agg(F.countDistinct("t").alias("n_used"), F.count("*").alias("n_tokens"))
    out = vocab.vocabulary_info(spark, SPACE)
    return used.join(F.broadcast(out)).select(*(big(c).alias(c) for c in (*out.columns, "n_used", "n_tokens")))  # one row each


def _tokens(spark, sf_dir, seed=None) -> DataFrame:
    return molecule.tokenize(fx.order_molecules(spark, sf_dir), FIXED_BOOKS, FIXED_SCALES, seed)


def token_ids(spark, sf_dir):
    out = _tokens(spark, sf_dir)
    return out.select("mol_id", big(F.size("tokens")).alias("n_tokens"), F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def token_text(spark, sf_dir):
    return _tokens(spark, sf_dir).select("mol_id", vocab.tokens_to_text(F.col("tokens"), SPACE).alias("text"))


def token_stats(spark, sf_dir):
    return corpus.length_statistics(_tokens(spark, sf_dir), F.col("tokens"))


def section_shuffle(spark, sf_dir):
    """Which section comes first in each molecule's shuffled sequence, and the unchanged length."""
    out = _tokens(spark, sf_dir, seed=5)
    return out.select("mol_id", big(F.get("tokens", F.lit(1))).alias("first_marker"), big(F.size("tokens")).alias("n_tokens"))


def decode_tokens(spark, sf_dir):
    back = molecule.decode(_tokens(spark, sf_dir).select("mol_id", "tokens"), FIXED_BOOKS, FIXED_SCALES).where("NOT error")
    atoms = fx.explode_atoms(back)
    return atoms.select("mol_id", big("atom_idx").alias("atom_idx"), big("atomic_number").alias("atomic_number"), *(r6(c).alias(c) for c in ("x", "y", "z", "fx", "fy", "fz", "energy")))


def roundtrip_error(spark, sf_dir):
    """Per molecule the errors of positions (both sides centred), forces and energy after encoding and decoding, all inside its row."""
    both = molecule.with_round_trip(fx.order_molecules(spark, sf_dir), FIXED_BOOKS, FIXED_SCALES).where("NOT trip.error")
    off = lambda x, y: F.zip_with(F.flatten(x), F.flatten(y), lambda u, v: u - v)
    rows = both.select("mol_id", off(F.col("trip.positions"), F.col("trip.back_positions")).alias("dp"), off(F.col("forces"), F.col("trip.back_forces")).alias("df"), F.col("energy").alias("e"), F.col("trip.back_energy").alias("be"))
    rmse = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / F.size(d))
    worst = lambda d: F.array_max(F.transform(d, lambda x: F.abs(x)))
    return rows.select(
        "mol_id", r6(rmse("dp")).alias("pos_rmse"), r9(worst("dp")).alias("pos_max"), r6(rmse("df")).alias("force_rmse"), r9(worst("df")).alias("force_max"),
        r6(F.abs(F.col("e") - F.col("be"))).alias("energy_abs"), r6(F.abs((F.col("e") - F.col("be")) / F.col("e"))).alias("energy_rel"),
    )


def recon_report(spark, sf_dir):
    out = reconstruction_report(fx.order_molecules(spark, sf_dir), FIXED_BOOKS, FIXED_SCALES)
    return out.select("channel", *(r6(c).alias(c) for c in ("mae", "median_error", "rmse", "max_error")))


def recon_report_256(spark, sf_dir):
    """The report at the default shape: 256 codes, eight position levels and four of the others, over every embedding's molecule."""
    out = reconstruction_report(fx.vector_molecules(spark, sf_dir), BIG_BOOKS, scale.Scales(1.0, 1.0, 0.0, 1.0))
    return out.select("channel", *(r6(c).alias(c) for c in ("mae", "median_error", "rmse", "max_error")))


def roundtrip_256(spark, sf_dir):
    """Tokens of the default shape and what they decode to: lengths and mean forces of every embedding's molecule."""
    scales = scale.Scales(1.0, 1.0, 0.0, 1.0)
    rows = molecule.with_decoded(molecule.tokenize(fx.vector_molecules(spark, sf_dir), BIG_BOOKS, scales), BIG_BOOKS, scales)
    total = F.aggregate(F.flatten("decoded.forces"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("mol_id", big(F.size("tokens")).alias("n_tokens"), r6(total).alias("force_sum"), r6("decoded.energy").alias("energy"))


def prompt_tokens(spark, sf_dir):
    out = _tokens(spark, sf_dir).select("mol_id", molecule.prompt(F.col("tokens")).alias("p"))
    return out.select("mol_id", big(F.size("p")).alias("n_prompt"), big(F.element_at("p", -1)).alias("last_token"))


def parse_defaults(spark, sf_dir):
    """Sequences of every third molecule lose their energy section; what cannot be read becomes zeros."""
    rows = _tokens(spark, sf_dir).withColumn("natoms", F.size("atomic_numbers"))
    cut = F.when(F.col("mol_id") % 3 == 0, F.slice("tokens", 1, F.size("tokens") - (LEVELS + 4))).otherwise(F.col("tokens"))
    read = predict.parse_outputs(rows.select("mol_id", "natoms", cut.alias("tokens")), FIXED_BOOKS, FIXED_SCALES)
    total = F.aggregate(F.flatten("forces"), F.lit(0.0), lambda a, x: a + F.abs(x))
    return read.select("mol_id", r6("energy").alias("energy"), big(F.size("forces")).alias("n_forces"), r6(total).alias("force_sum"))


def predict_continuation(spark, sf_dir):
    """A generator that only ends a sequence: every other molecule's prompt is its sequence up to there and reads well, the others fall to the defaults."""
    whole = F.slice("tokens", 1, F.size("tokens") - 1)
    rows = _tokens(spark, sf_dir).select("mol_id", F.size("atomic_numbers").alias("natoms"), F.when(F.col("mol_id") % 2 == 0, whole).otherwise(molecule.prompt(F.col("tokens"))).alias("tokens"))
    made = predict.predict_tokens(rows, lambda: (lambda tokens, most: [vocab.EOS]))
    read = predict.parse_outputs(made, FIXED_BOOKS, FIXED_SCALES)
    total = F.aggregate(F.flatten("forces"), F.lit(0.0), lambda a, x: a + F.abs(x))
    return read.select("mol_id", r6("energy").alias("energy"), big(F.size("forces")).alias("n_forces"), r6(total).alias("force_sum"))


def wordlevel_ids(spark, sf_dir):
    words = spark.createDataFrame([(w, k) for k, w in enumerate(WORDS, 1)], "token string, token_id int")
    ids = vocab.word_id_lists(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), words, "text", 0)
    at = F.transform("ids", lambda t, k: big(t) * k)
    return ids.select("doc_id", big(F.size("ids")).alias("n_words"), big(F.size(F.filter("ids", lambda t: t == 0))).alias("n_unknown"), F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


def md5_sample(spark, sf_dir):
    return corpus.sample_rows(fx.table(spark, sf_dir, "orders").select("o_orderkey", r6("o_totalprice").alias("o_totalprice")), "o_orderkey", 500, seed=7)


def buffered_sample(spark, sf_dir):
    """500 orders through shuffle buffers: how many come, how many differ, and how many the table has with the same price."""
    rows = buffered.buffered_sample(spark, f"{sf_dir}/orders.parquet", 500, ["o_orderkey", "o_totalprice"], seed=7, buffer=100)
    known = rows.join(fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), "o_orderkey", "left")
    return known.agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_distinct"), F.count_if(F.col("o_totalprice") == F.col("price")).alias("n_in_table"))


def _split(spark, sf_dir) -> DataFrame:
    return corpus.split_by_sample(fx.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 700, seed=3)


def train_val_split(spark, sf_dir):
    return _split(spark, sf_dir)


def shard_sizes(spark, sf_dir):
    out = shard_numbers(_split(spark, sf_dir), draw(F.col("o_orderkey"), 4), 400)
    return out.groupBy("split", "shard").agg(F.count("*").alias("n"))


def shard_members(spark, sf_dir):
    return shard_numbers(_split(spark, sf_dir), draw(F.col("o_orderkey"), 4), 400).select("o_orderkey", "split", "shard")


def offset_split(spark, sf_dir):
    rows = with_row_index(fx.table(spark, sf_dir, "customer"))
    return corpus.split_by_offset(rows, "row_idx", 100, 30).groupBy("split").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))


def row_index(spark, sf_dir):
    """How many rows there are, how many places differ, and the first and last place. Places are counted as bits of 64-bit words, so no task keeps each of its rows."""
    at = F.col("row_idx")
    bit = F.expr("shiftleft(1L, CAST(row_idx & 63 AS INT))")
    words = with_row_index(fx.table(spark, sf_dir, "orders")).groupBy(F.shiftright(at, 6).alias("w"))
    words = words.agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"), F.min(at).alias("least"), F.max(at).alias("most"))
    return words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0)).alias("n_distinct"), F.min("least").alias("least"), F.max("most").alias("most"))


def published_files(spark, sf_dir):
    """Every order's token text, published in shards of 400: the files' names and rows."""
    path = shared_path(spark, "published")
    publish(fx.order_molecules(spark, sf_dir), FIXED_BOOKS, FIXED_SCALES, path, val_size=700, shard_size=400, seed=3)
    return spark.read.parquet(f"{path}/data").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def csv_first_rows(spark, sf_dir):
    """The first 1,000 customers in file order of CSV files with line ends and quotes in a field."""
    path = shared_path(spark, "customers-csv")
    note = F.concat("c_name", F.lit(',\n"'), "c_mktsegment", F.lit('"\n')).alias("note")
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", note, r6("c_acctbal").alias("balance"))
    rows.repartitionByRange(6, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = read_csv_rows(spark, path, ["c_custkey", "note", "balance"], max_rows=1000, range_bytes=1 << 14)
    return out.select("row_idx", big("c_custkey").alias("c_custkey"), "note", F.col("balance").cast("double").alias("balance"))


def nested_json_roundtrip(spark, sf_dir):
    rows = fx.order_molecules(spark, sf_dir).select("mol_id", F.to_json("positions").alias("j"))
    back = rows.select("mol_id", parse_vectors(F.col("j")).alias("p"))
    return back.select("mol_id", big(F.size("p")).alias("n"), r6(F.aggregate(F.flatten("p"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


class Quantised:
    """A predictor that knows its targets coarsely: energies down to eighths, forces down to quarters."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        forces = [[[float(x // 0.25) * 0.25 for x in a] for a in m] for m in batch["forces"]]
        return pd.DataFrame({"id": batch["id"], "energy": batch["energy"] // 0.125 * 0.125, "forces": forces})


def s2ef_metrics(spark, sf_dir):
    rows = fx.vector_molecules(spark, sf_dir).select(F.col("mol_id").cast("string").alias("id"), "energy", "forces")
    out = metrics.s2ef(predict.predict(rows, Quantised), rows)
    return out.select(*(c if c.startswith("n_") else r6(c).alias(c) for c in out.columns))


def _task(name: str) -> Callable:
    def query(spark, sf_dir):
        out = metrics.run_tasks(fx.task_energies(spark, sf_dir), [name])[name]
        return out.select(*(r6(c).alias(c) if t == "double" else c for c, t in out.dtypes))

    return query


def task_summary(spark, sf_dir):
    return metrics.summary(fx.task_energies(spark, sf_dir)).select("task", "metric", r6("value").alias("value"))


def task_distance_detail(spark, sf_dir):
    out = metrics.distance_detail(metrics.task_rows(fx.task_energies(spark, sf_dir), "distance_scaling"))
    return out.select("group_id", big(F.size("distances")).alias("n"), F.array_join(F.col("distances").cast("array<string>"), " ").alias("distances"), r6(F.element_at("preds", 1)).alias("first_pred"), r6(F.element_at("targets", -1)).alias("last_target"))


def task_gap_errors(spark, sf_dir):
    out = metrics.gap_errors(metrics.task_rows(fx.task_energies(spark, sf_dir), "spin_gap"), "triplet", "singlet")
    return out.select("group_id", *(r6(c).alias(c) for c in ("pred_gap", "target_gap", "error")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    rvq1d_level1, rvq1d_encode, rvq1d_encode_plain, rvq1d_decode_error, scale_stats, centered_positions, morton_codes, morton_codebook, rvq3d_encode,
    rvq3d_residual_rms, rvq1d_encode_256, rvq3d_encode_256, kmeans_codebook, vocab_table, vocab_info, token_ids, token_text, token_stats, section_shuffle, decode_tokens, roundtrip_error,
    recon_report, recon_report_256, roundtrip_256, prompt_tokens, parse_defaults, predict_continuation, wordlevel_ids, md5_sample, buffered_sample, train_val_split, shard_sizes, shard_members, offset_split,
    row_index, published_files, csv_first_rows, nested_json_roundtrip, s2ef_metrics, task_summary, task_distance_detail, task_gap_errors,
)} | {f"task_{name}": _task(name) for name in metrics.TASKS}
