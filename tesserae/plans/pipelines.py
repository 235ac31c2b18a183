"""Whole jobs: train codebooks, tokenise and publish a corpus, evaluate predictions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.arrays import draw
from tesserae.functions.order import drawn
from tesserae.operators.codebook import (
    Levels1D, Levels3D, codebook_table, load_codebooks, train_1d, train_1d_kmeans, train_3d,
)
from tesserae.operators.corpus import length_statistics, sample_rows
from tesserae.operators.metrics import error_summary, headlines, run_tasks, s2ef
from tesserae.operators.molecule import space_of, tokenize, with_coding_errors
from tesserae.operators.predict import predict
from tesserae.operators.scale import Scales, apply_scales, fit_scales
from tesserae.operators.vocab import tokens_to_text, vocabulary_info
from tesserae.sources.buffered import BUFFER, buffered_sample
from tesserae.sources.files import (
    SAMPLE_COLUMNS, place_in_shards, read_evaluation, shard_starts, write_corpus, write_molecule_csv, write_predictions, write_results, write_shards,
)
from tesserae.sources.fixtures import explode_atoms


def train(molecules: DataFrame, size: int = 256, pos_levels: int = 8, levels: int = 4, cap: int | None = 500_000, method: str = "quantile", seed: int = 0) -> tuple[dict[str, Levels1D | Levels3D], Scales]:
    """Codebooks of positions, the three force axes and energy, and the scales they hold in. Each channel draws its own sample."""
    scales = fit_scales(molecules)
    scaled = apply_scales(molecules, scales)
    atoms = explode_atoms(scaled).withColumn("atom_key", F.concat_ws("/", "mol_id", "atom_idx"))
    one = train_1d if method == "quantile" else train_1d_kmeans
    books: dict[str, Levels1D | Levels3D] = {"position": train_3d(atoms, pos_levels, size, ["atom_key"], cap, seed, method)}
    for k, axis in enumerate("xyz", 1):
        books[f"force_{axis}"] = one(atoms, f"f{axis}", levels, size, "atom_key", cap, seed + 100 * k)
    books["energy"] = one(scaled, "energy", levels, size, "mol_id", cap, seed + 400)
    return books, scales


def save_codebooks(spark: SparkSession, books: dict, scales: Scales, path: str) -> None:
    codebook_table(spark, books).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
    spark.createDataFrame([tuple(scales.row().values())], ", ".join(f"{k} double" for k in scales.row())).coalesce(1).write.mode("overwrite").parquet(f"{path}/scales")


def read_codebooks(spark: SparkSession, path: str) -> tuple[dict, Scales]:
    return load_codebooks(spark.read.parquet(f"{path}/codebooks")), Scales(**spark.read.parquet(f"{path}/scales").first().asDict())


def reconstruction_report(molecules: DataFrame, books: dict, scales: Scales, split: str | None = None) -> DataFrame:
    """Errors in scaled units per split and channel: position, force (all axes together) and energy."""
    keep = [split] if split else []
    coded = with_coding_errors(apply_scales(molecules, scales), books).select(*keep, "errors")
    named = lambda name, values: F.transform(values, lambda x: F.struct(F.lit(name).alias("channel"), x.alias("error")))
    channels = [named("position", F.col("errors.position")), named("force", F.col("errors.force")), named("energy", F.array("errors.energy"))]
    errors = coded.select(*keep, F.explode(F.concat(*channels)).alias("x")).select(*keep, "x.channel", "x.error")
    return error_summary(errors, F.col("error"), [*keep, "channel"])


def progress(tokens: Column) -> list[Column]:
    """What an observation counts of token rows as they pass: rows and tokens."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("tokens")]


def serialize(molecules: DataFrame, books: dict, scales: Scales, path: str, seen: Observation | None = None) -> DataFrame:
    """Tokenise into a corpus at `path`; returns the length statistics. `seen` gets the rows and tokens as they are written."""
    spark = molecules.sparkSession
    rows = tokenize(molecules, books, scales).select("mol_id", "tokens")
    if seen:
        rows = rows.observe(seen, *progress(F.col("tokens")))
    write_corpus(rows, path, vocabulary_info(spark, space_of(books)).first().asDict())
    return length_statistics(spark.read.parquet(f"{path}/tokens"), F.col("tokens"))


def publish(molecules: DataFrame, books: dict, scales: Scales, path: str, val_size: int = 100_000, shard_size: int = 250_000, seed: int = 0, key: str = "mol_id") -> dict[str, int]:
    """Tokenise, split, and write text shards of exact size; returns how many rows, tokens and validation rows were written.

    Split and shard follow from the key's digest alone: keys are ranked on their own, and the first digest of every
    shard is a short sorted list that goes to the tasks. So a text is made inside the scan and moves once, to its shard.
    The counts are observed while the texts are made, without a scan of their own.
    """
    split = F.when(drawn(molecules.select(key), key, val_size, seed), "val").otherwise("train")
    order = draw(F.col(key), seed + 1)
    firsts = shard_starts(molecules.select(key).withColumn("split", split), order, shard_size)
    seen = Observation("publish")
    tokens = tokenize(molecules, books, scales).select(key, "tokens", split.alias("split")).observe(seen, *progress(F.col("tokens")), F.count_if(F.col("split") == "val").alias("validation"))
    text = tokens.select(key, "split", tokens_to_text(F.col("tokens"), space_of(books)).alias("text"))
    write_shards(place_in_shards(text, order, firsts).select("text", "split", "shard"), path, {s: len(x) for s, x in firsts.items()})
    return seen.get


def sample_to_csv(spark: SparkSession, source: str, path: str, n: int = 1_000_000, seed: int = 0, key: str = "property_id") -> None:
    """n rows of a Parquet table, drawn by the digest of their key, as a CSV of the sample's columns: a projected scan and a filter."""
    rows = spark.read.parquet(source)
    rows = rows.select(*(c for c in SAMPLE_COLUMNS if c in rows.columns))
    write_molecule_csv(sample_rows(rows, key, n, seed), path)


def stream_sample_to_csv(spark: SparkSession, source: str, path: str, n: int = 1_000_000, seed: int = 0, buffer: int = BUFFER) -> None:
    """n rows of a Parquet table by bounded shuffle buffers, as a CSV of the sample's columns: only the row groups that the sample needs are read."""
    has = spark.read.parquet(source).columns
    write_molecule_csv(buffered_sample(spark, source, n, [c for c in SAMPLE_COLUMNS if c in has], seed, buffer), path)


def evaluate(structures: DataFrame, make, path: str | None = None) -> DataFrame:
    """Predict `structures` (id, ..., energy, forces) and score them; results go to `path` as JSON if given."""
    result = s2ef(predict(structures, make), structures)
    if path:
        write_results(result, path)
    return result


def evaluate_file(spark: SparkSession, source: str, make, path: str, split: str = "val", max_samples: int = 0) -> DataFrame | None:
    """Predict the structures of a Parquet table; write the predictions and, for the val split, the metrics. Other splits have no targets."""
    structures = read_evaluation(spark, source, split, max_samples)
    write_predictions(predict(structures, make), f"{path}/predictions")
    if split != "val":
        return None
    back = spark.read.parquet(f"{path}/predictions").select("id", "energy", "forces")  # a model runs once
    result = s2ef(back, structures, "id")
    write_results(result, f"{path}/s2ef")
    return result


def evaluate_tasks(evaluation: DataFrame, path: str, tasks: Iterable[str] | None = None) -> DataFrame:
    """Every task over (task, group_id, state, idx, pred, target): a result file per task, an error file for one that fails, and a summary."""
    spark = evaluation.sparkSession
    results = run_tasks(evaluation, tasks)
    for name, result in results.items():
        rows = result if isinstance(result, DataFrame) else spark.createDataFrame([(result["error"],)], "error string")
        write_results(rows, f"{path}/{name}")
    out = headlines(results, spark)
    write_results(out, f"{path}/summary")
    return out
