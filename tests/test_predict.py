"""Predictions in batches of similar length."""

from __future__ import annotations

import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import predict
from tesserae.operators.vocab import EOS


def rows_of(spark, n=600):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(3, 90) for _ in range(rng.randrange(0, 200))], f"m{i}") for i in range(n)]
    rows += [(n, None, None), (n + 1, [7, EOS, 9], "ends"), (n + 2, [], "empty")]
    return rows, spark.createDataFrame(rows, "mol_id long, tokens array<int>, n_padding string")


def generator():
    """As many new tokens as the sum's last digit, then the end token where it is even. Made inside a function, so that workers get it by value."""

    def new_tokens(seq, most):
        total = sum(seq)
        return [3 + total % 7] * min(total % 10, most) + [EOS] * (total % 2 == 0) + [5]

    return new_tokens


def test_batches_equal_single_sequences(spark):
    (rows, df), new_tokens = rows_of(spark), generator()

    def make():
        def model(ids, sizes, most):
            assert ids.shape == (len(sizes), sizes.max()) and all(not row[n:].any() for row, n in zip(ids, sizes, strict=True))
            return [new_tokens(row[:n].tolist(), most) for row, n in zip(ids, sizes, strict=True)]

        return model

    want = {}
    for key, tokens, _ in rows:
        whole = [*(tokens or []), *new_tokens(tokens or [], 6)[:6]]
        want[key] = whole[: whole.index(EOS) + 1] if EOS in whole else whole
    for batch, window in ((1, 1), (16, 100), (1000, 10_000)):
        got = predict.predict_batches(df.repartition(3, "mol_id"), make, max_new=6, batch=batch, window=window).collect()
        assert {r["mol_id"]: r["tokens"] for r in got} == want and len(got) == len(rows)
    single = predict.predict_tokens(df, lambda: new_tokens, max_new=6)
    assert single.columns == ["mol_id", "tokens", "n_padding"] and {r["mol_id"]: r["tokens"] for r in single.select("mol_id", "tokens").collect()} == want


def test_one_model_a_task_and_little_padding(spark):
    _, df = rows_of(spark)

    def make():
        own = uuid.uuid4().int % 1_000_000 + 100
        return lambda ids, sizes, most: np.full((len(sizes), 1), own)

    got = predict.predict_batches(df.where("mol_id < 600").repartition(4), make, batch=16).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["task"], r["tokens"][-1]) for r in got}) == len({r["task"] for r in got}) == 4
    assert sum(r["n_padding"] for r in got) < 0.1 * sum(len(r["tokens"]) for r in got)  # about half as many again in order of arrival


def test_no_prompts(spark):
    none = spark.createDataFrame([], "mol_id long, tokens array<int>")
    assert predict.predict_batches(none, lambda: None).collect() == []
