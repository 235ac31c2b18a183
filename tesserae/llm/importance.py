"""Importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Unigrams and bigrams of lower-cased words fall into a fixed number of buckets. Bucket counts over all raw rows and over
the target rows give two smoothed generative models; a text's weight is the sum of the log ratios of its n-grams. The
k texts with the largest weight plus Gumbel noise are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_materialized, kth_largest, materialize

BUCKETS = 10_000
#: Target rows that the target's model is fitted on (about; drawn by a hash of their id). Their ids are sent to all tasks.
TARGET_ROWS = 50_000
SMOOTHING = 1.0
_HASHED: dict[str, int] = {}


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's unigrams and bigrams, with repeats."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_HASHED) > 300_000:
        _HASHED.clear()
    own = []
    for w in words:
        h = _HASHED.get(w)
        if h is None:
            h = _HASHED[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        own.append(h)
    h = np.array(own, np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(33)
    return np.concatenate([h % np.uint64(buckets), pairs % np.uint64(buckets)]).astype(np.int64)


def _counter(buckets: int):
    def count(batches):
        counts = np.zeros((2, buckets), np.int64)
        for b in batches:
            for text, target in zip(b.column("text"), b.column("target").to_pylist(), strict=True):
                own = np.bincount(ngram_buckets(text.as_py(), buckets), minlength=buckets)
                counts[0] += own
                if target:
                    counts[1] += own
        at = np.nonzero(counts[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])

    return count


def log_ratios(rows: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Per bucket log(target share / raw share), from the counts over all `rows` (text, target boolean)."""
    found = rows.mapInArrow(_counter(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in found.collect():  # `buckets` rows at most
        raw[b], target[b] = r, t
    share = lambda x: np.log((x + smoothing) / (x.sum() + smoothing * buckets))
    return share(target) - share(raw)


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise that depends on the key and the seed only, so a task that runs again draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 0, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, log_weight, sample_key, selected.

    `target` holds the ids of target rows; of more than `target_rows` ids about so many are drawn by a hash of the id for
    the target's model (all of them, if there are fewer). The raw model counts every row. No text is shuffled.

    round(share * rows) rows are selected: those with the largest keys, equal keys by a hash of the id; rows equal in
    both (repeated rows) stand or fall together. Null and empty texts weigh 0. Rows without an id are raw rows. Without
    target rows, or with nothing but target rows, all weights are nearly 0 and the sample is uniform.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Narrow ids are counted first, so that what is broadcast stays near target_rows whatever the table's size.
    marked = materialize(target.select(F.col(doc_id).alias("__target")).where("__target IS NOT NULL").distinct(), "target-ids")
    n = marked.count()
    if n > target_rows:
        marked = marked.where(F.pmod(F.xxhash64(F.col("__target").cast("string"), F.lit("target")), F.lit(1 << 40)) < int(target_rows / n * (1 << 40)))
    both = rows.join(F.broadcast(marked), rows["doc_id"] == F.col("__target"), "left")
    ratio = log_ratios(both.select("text", F.col("__target").isNotNull().alias("target")), buckets)
    drop_materialized(marked)

    def weigh(batches):
        for b in batches:
            w = [float(ratio[ngram_buckets(t.as_py(), buckets)].sum()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    weights = rows.mapInArrow(weigh, f"doc_id {kind}, log_weight double").withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    # Fixed point orders like the double to a millionth; the rest of the order is the hash.
    exact = weights.withColumn("__key", F.round(F.col("sample_key") * 1e6).cast("long")).withColumn("__tie", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed + 1)))
    exact = materialize(exact, "sample-keys")
    k = round(share * exact.count())
    cut = kth_largest(exact, "__key", k)
    if cut is None:
        return exact.drop("__key", "__tie").withColumn("selected", F.lit(k > 0))
    tie = kth_largest(exact.where(F.col("__key") == cut[0]), "__tie", cut[1])
    chosen = (F.col("__key") > cut[0]) | ((F.col("__key") == cut[0]) & (F.col("__tie") >= tie[0]))
    return exact.withColumn("selected", chosen).drop("__key", "__tie")
