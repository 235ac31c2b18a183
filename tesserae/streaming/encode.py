"""Tokenising a stream of molecules with frozen codebooks: stateless, so it needs neither watermark nor shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.molecule import tokenize
from tesserae.operators.scale import Scales


def stream_tokens(spark: SparkSession, source: str, sink: str, checkpoint: str, books: dict, scales: Scales, schema: str):
    """Start a query that turns Parquet files arriving in `source` into token rows in `sink`, each exactly once."""
    arriving = spark.readStream.schema(schema).parquet(source)
    return tokenize(arriving, books, scales).select("mol_id", "tokens").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_batches(spark: SparkSession, source: str, checkpoint: str, books: dict, scales: Scales, schema: str, handle):
    """The same, handing each micro-batch of tokens to `handle(df, batch_id)`."""

    def tokens(batch: DataFrame, number: int) -> None:
        handle(tokenize(batch, books, scales).select("mol_id", "tokens"), number)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(tokens).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
