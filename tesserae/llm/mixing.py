"""Temperature mixing of sources.

Source weights are token shares raised to an exponent, which is bisected to meet a target entropy or a limit on how
often any source repeats. The weights are then realised as a token budget per source: whole epochs, and part of one
more. Every epoch orders a source's blocks, and the documents inside them, by hashes of their own, so a document's
place follows from its id and a plan of one row per source; no group of documents is ever gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import drop_materialized, materialize

#: Blocks per source at most: a block never holds less than BLOCK_TOKENS (but the last), and a source never has more.
MAX_BLOCKS, BLOCK_TOKENS = 4096, 1 << 16
#: Source plans are a broadcast of one short row per source; beyond so many sources the plan is joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: The exponent is solved on the driver from one number per source; more sources than this (some 200 MB there) are refused.
MAX_SOURCES = 1_000_000
PLACES = ("epoch", "position", "within_block")


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights: shares to the power of the exponent; sources without tokens get none."""
    total = sum(tokens.values())
    raw = {s: math.exp(exponent * math.log(t / total)) if t else 0.0 for s, t in tokens.items()}
    norm = math.fsum(raw.values())
    return {s: w / norm if norm else 0.0 for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def smallest_full_budget(tokens: dict[str, int], weights: dict[str, float]) -> float:
    """The least token budget at which no source is cut below one epoch."""
    return max((t / weights[s] for s, t in tokens.items() if t), default=0.0)


def most_repeats(tokens: dict[str, int], weights: dict[str, float], budget: float | None) -> float:
    """How often the most repeated source is read."""
    b = smallest_full_budget(tokens, weights) if budget is None else budget
    return max((b * weights[s] / t for s, t in tokens.items() if t), default=0.0)


def solve_exponent(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent in 0..1, by bisection: the entropy falls and repeats of small sources fall as it grows.

    With `target_entropy`: the exponent whose weights have it (1 or 0 where it is out of reach). With `max_repeats`: the
    smallest exponent, thus the flattest mix, at which no source is read more often than that.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")

    def flat_enough(x: float) -> bool:  # true up to the answer's left, false to its right
        w = weights_at(tokens, x)
        return entropy(w) > target_entropy if max_repeats is None else most_repeats(tokens, w, budget) > max_repeats

    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if flat_enough(mid) else (low, mid)
    return high


@dataclass(frozen=True)
class SourcePlan:
    source: str
    tokens: int
    weight: float
    epochs: int
    rest: int
    blocks: int


def source_key(source: str) -> Column:
    """Null is a source of its own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")


def plan_sources(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> list[SourcePlan]:
    weights = weights_at(tokens, solve_exponent(tokens, target_entropy, max_repeats, budget))
    total = smallest_full_budget(tokens, weights) if budget is None else budget
    out = []
    for s, t in sorted(tokens.items()):
        due = round(total * weights[s])
        epochs, rest = divmod(due, t) if t else (1, 0)  # a source without tokens is passed on once
        out.append(SourcePlan(s, t, weights[s], epochs, rest, max(1, min(MAX_BLOCKS, t // BLOCK_TOKENS))))
    return out


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 0, tokens: Column | None = None, doc_id: str = "doc_id", source: str = "source", places: bool = True) -> DataFrame:
    """The rows of the mix: all columns of `docs`, with epoch (from 0), position and within_block (columns of those names are replaced).

    Without `places` the columns are those of `docs`, whatever their names.

    Training order is (position, within_block): position places blocks of all sources between 0 and 1, so that every
    stretch of it has the mix's proportions.

    `budget` is the mix's tokens; None means the least at which every document is read at least once. In the last,
    partial epoch of a source, blocks are taken in their order while they fit, and of the first that does not fit the
    documents that do. Rows of one id (and rows without an id) of a source stand together. `tokens` counts a row
    (white-space words of column text by default; null is none). An empty table gives an empty mix. More than
    MAX_SOURCES sources raise ValueError.
    """
    spark = docs.sparkSession
    count = word_count() if tokens is None else tokens
    draw = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed))
    sizes = materialize(docs.select(source_key(source).alias("__source"), count.alias("__tokens"), draw.alias("__draw")), "mix-sizes")
    per_source = materialize(sizes.groupBy("__source").agg(F.coalesce(F.sum("__tokens"), F.lit(0)).alias("n")), "mix-sources")
    if (n_sources := per_source.count()) > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; at most {MAX_SOURCES} can be mixed: map them to coarser ones")
    totals = {r[0]: r[1] for r in per_source.collect()}
    drop_materialized(per_source)
    plans = plan_sources(totals, target_entropy, max_repeats, budget) if totals else []
    schema = "__source string, __all long, __weight double, __epochs int, __rest long, __blocks int"
    plan = spark.createDataFrame([(p.source, p.tokens, p.weight, p.epochs, p.rest, p.blocks) for p in plans], schema)
    few = len(plans) <= MAX_BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df.hint("merge"))
    # The cut of the partial epoch: first between blocks, then inside the block where the budget ends.
    placed = sizes.join(hint(plan), "__source").withColumn("__block", F.pmod(F.shiftright("__draw", 20), F.col("__blocks")))
    order = Window.partitionBy("__source").orderBy("__turn")
    blocks = placed.where("__rest > 0").groupBy("__source", "__block", "__epochs", "__rest").agg(F.sum("__tokens").alias("n"))
    blocks = blocks.withColumn("__turn", F.xxhash64("__block", F.col("__epochs"), F.lit(seed))).withColumn("upto", F.sum("n").over(order))
    edge = blocks.where("upto > __rest").groupBy("__source").agg(F.min(F.struct("__turn", "__block", (F.col("__rest") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
    edge = edge.select("__source", F.col("e.__turn").alias("__edge_turn"), F.col("e.__block").alias("__block"), F.col("e.left").alias("__left"))
    inside = placed.join(hint(edge), ["__source", "__block"]).groupBy("__source", "__draw", "__left", "__epochs").agg(F.sum("__tokens").alias("n"))
    inside = inside.withColumn("__turn", F.xxhash64("__draw", F.col("__epochs"), F.lit(seed))).withColumn("upto", F.sum("n").over(order))
    last = inside.where("upto <= __left").groupBy("__source").agg(F.max("__turn").alias("__last"))
    cuts = plan.join(edge.drop("__block", "__left"), "__source", "left").join(last, "__source", "left")
    own = docs.withColumn("__source", source_key(source)).withColumn("__draw", draw).join(hint(cuts), "__source")
    own = own.withColumn("__block", F.pmod(F.shiftright("__draw", 20), F.col("__blocks")))
    own = own.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs"))))
    turn, inner = F.xxhash64("__block", F.col("__epoch"), F.lit(seed)), F.xxhash64("__draw", F.col("__epoch"), F.lit(seed))
    # Without an edge the partial epoch is empty; without a last document nothing of the edge block fits.
    partial = F.coalesce((turn < F.col("__edge_turn")) | ((turn == F.col("__edge_turn")) & (inner <= F.col("__last"))), F.lit(False))
    own = own.where((F.col("__epoch") < F.col("__epochs")) | partial)
    if not places:
        return own.select(*docs.columns)
    unit = lambda h: F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    # Blocks of all sources interleave: a block's place in its epoch, the epoch's place among those the source has.
    within = unit(turn.bitwiseXOR(F.lit(-(2**63))))
    span = F.col("__epochs") + F.when(F.col("__all") > 0, F.col("__rest") / F.col("__all")).otherwise(0.0)
    # The blocks of a partial epoch lie up to its share; with few blocks the last may lie beyond, and then ends the mix.
    position = F.least((F.col("__epoch") + within) / F.greatest(span, F.lit(1.0)), F.lit(1.0))
    return own.select(*(c for c in docs.columns if c not in PLACES), *(x.alias(n) for x, n in zip((F.col("__epoch"), position, inner), PLACES, strict=True)))
