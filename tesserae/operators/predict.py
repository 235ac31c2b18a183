"""Predictions from any model that a Python object can wrap, one instance per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from tesserae.operators.molecule import with_decoded, with_defaults
from tesserae.operators.vocab import EOS

PREDICTIONS = "id string, energy double, forces array<array<double>>"


def predict(structures: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """(id, energy, forces) of `structures`: `make()` builds a predictor once per task, which maps batches to batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield model(b)[["id", "energy", "forces"]]

    return structures.mapInPandas(run, PREDICTIONS)


def predict_batches(prompts: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray, int], Sequence]], max_new: int = 512, batch: int = 32, window: int = 4096, profile: ResourceProfile | None = None) -> DataFrame:
    """`prompts` (tokens, ...) with each sequence continued by a model that takes sequences of similar length at once.

    `make()` builds the model once per task. It gets a matrix of token ids (a row per sequence, filled up with 0 on the
    right), their lengths and `max_new`, and returns each one's new tokens; a sequence ends with its first end token. A
    task takes `window` rows, orders them by length, cuts them into batches of `batch`, and gives them back as they came.
    `n_padding` is the number of places that were filled up beside a row. Null tokens are an empty sequence. `profile`
    asks for what the executors of this stage need, such as an accelerator.
    """
    schema = StructType([*(f for f in prompts.schema if f.name != "n_padding"), StructField("n_padding", IntegerType())])

    def continued(model, rows: pa.Table) -> pa.Table:
        lists = rows.column("tokens").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
        ends, order = np.cumsum(sizes), np.argsort(sizes, kind="stable")
        out, padding = [None] * len(sizes), np.zeros(len(sizes), np.int32)
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            ids = np.zeros((len(at), sizes[at[-1]]), np.int32)
            for k, i in enumerate(at):
                ids[k, : sizes[i]] = flat[ends[i] - sizes[i] : ends[i]]
            for k, (i, new) in enumerate(zip(at, model(ids, sizes[at], max_new), strict=True)):
                whole = np.r_[ids[k, : sizes[i]], np.asarray(new, np.int32)[:max_new]]
                stop = np.flatnonzero(whole == EOS)
                out[i] = whole[: stop[0] + 1] if len(stop) else whole
            padding[at] = ids.shape[1] - sizes[at]
        made = {"tokens": pa.array(out, lists.type), "n_padding": pa.array(padding)}
        return pa.table([made[c] if c in made else rows.column(c) for c in schema.names], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, n = make(), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= window:
                yield from continued(model, pa.Table.from_batches(held)).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from continued(model, pa.Table.from_batches(held)).combine_chunks().to_batches()

    return prompts.mapInArrow(run, schema, profile=profile)


def predict_tokens(prompts: DataFrame, make: Callable[[], Callable[[list[int], int], list[int]]], max_new: int = 512, key: str = "mol_id") -> DataFrame:
    """`prompts` (key, tokens, ...) with each sequence continued by a generator of single sequences, at most `max_new` tokens and no further than its end token."""

    def batched():
        generate = make()
        return lambda ids, sizes, most: [generate(row[:n].tolist(), most) for row, n in zip(ids, sizes, strict=True)]

    return predict_batches(prompts, batched, max_new).select(*prompts.columns)


def parse_outputs(generated: DataFrame, books: dict, scales, natoms: str = "natoms", key: str = "mol_id") -> DataFrame:
    """(key, energy, forces) of generated sequences, zeros where they cannot be read."""
    read = with_decoded(generated.select(key, natoms, "tokens"), books, scales).select(key, natoms, "decoded.*")
    return with_defaults(read, natoms).select(key, "energy", "forces")
