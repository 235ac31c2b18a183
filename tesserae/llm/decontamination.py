"""Benchmark decontamination in DataFrame functions only.

Test items are cut into windows of 13 normalised words. The first eight words of a window (four, two or one for
shorter items) are its anchor; the anchors' 64-bit hashes form the broadcast set. Training texts are scanned once:
the hash of every position's anchor is looked up, and each hit is verified on the words themselves by an equality
join with the windows. Up to `max_broadcast_windows` anchors are constants of the plan; up to `max_broadcast_anchors`
they are a broadcast table that the scan's positions meet inside their tasks, so positions never move; beyond that
anchors and windows are matched by shuffled joins. The result is the same.

A row is known by its id and a hash of its text, so rows of one id with different texts, and rows without an id, are
judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import materialize

WINDOW_WORDS = 13
#: 200,000 anchors are 1.6 MB in a plan and about 20 MB as a hash set in an executor.
MAX_BROADCAST_WINDOWS = 200_000
#: Some 30 bytes each in a broadcast table of longs: 300 MB in an executor.
MAX_BROADCAST_ANCHORS = 10_000_000
#: What separates words once A-Z are lower-cased: ASCII other than digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(split, lambda w: w != "")


def _anchor_length(n: Column) -> Column:
    return F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (item_id string, n_words int, window string, anchor_words int, anchor long) of the test items.

    Items without words have no windows. Items of fewer words than `window` are one window. Windows of items without an
    id have a null item_id.
    """
    words = benchmark.select(F.col(item_id).cast("string").alias("item_id"), normal_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    at = words.withColumn("n", F.least(F.size("words"), F.lit(window))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1))
    )
    part = at.select("item_id", F.col("n").alias("n_words"), F.slice("words", F.col("at"), F.col("n")).alias("w"))
    k = _anchor_length(F.col("n_words"))
    return part.select("item_id", "n_words", F.concat_ws(" ", "w").alias("window"), k.cast("int").alias("anchor_words"), _hash_of(F.col("w"), k).alias("anchor")).distinct()


def _hash_of(words: Column, k: Column) -> Column:
    """The anchor hash of the first k words: the same mixing as `_anchor_hashes`."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(*(F.when(k == n, F.xxhash64(*(F.get(each, F.lit(i)) for i in range(n)))) for n in (8, 4, 2, 1)))


def _anchor_hashes(hashes: Column, k: int) -> Column:
    """For every position the hash of the k word hashes from there on (the last k-1 positions have fewer and are cut off)."""
    n = F.greatest(F.size(hashes) - F.lit(k - 1), F.lit(0))
    return F.transform(
        F.slice(hashes, 1, n), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + F.lit(j)) for j in range(1, k)))
    )


def _cut(words: Column, start: Column, lengths: list[int]) -> Column:
    """(start, n_words, window) of the words from `start` (from 0) on, for each length that fits."""
    one = lambda n: F.struct(start.alias("start"), F.lit(n).alias("n_words"), F.concat_ws(" ", F.slice(words, start + 1, n)).alias("window"))
    return F.filter(F.array(*map(one, lengths)), lambda x: x["start"] + x["n_words"] <= F.size(words))


def scan(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast_windows: int = MAX_BROADCAST_WINDOWS, max_broadcast_anchors: int = MAX_BROADCAST_ANCHORS) -> tuple[DataFrame, DataFrame]:
    """What one pass over the texts finds: rows (doc_id, h, n_words), and distinct verified hits (doc_id, h, start int from 0, n_words int, window string)."""
    keys = [(r[0], r[1], r[2]) for r in windows.groupBy("anchor_words").agg(F.countDistinct("anchor"), F.array_sort(F.collect_set("n_words"))).collect()]
    total = sum(n for _, n, _ in keys)
    small = total <= max_broadcast_windows
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), normal_words(F.col(text)).alias("words"))
    words = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    none = F.array().cast("array<struct<start:int,n_words:int,window:string>>")
    found, far = [none], None
    for k, _, lengths in sorted(keys):
        anchors = windows.where(F.col("anchor_words") == k).select("anchor").distinct()
        words = words.withColumn(f"anchors{k}", _anchor_hashes(F.col("hashes"), k))
        if small:
            known = [r[0] for r in anchors.collect()]  # bounded by max_broadcast_windows
            starts = F.filter(F.transform(f"anchors{k}", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
            found.append(F.flatten(F.transform(starts, lambda i: _cut(F.col("words"), i, lengths))))
        else:
            at = words.select("doc_id", "h", F.posexplode_outer(f"anchors{k}").alias("start", "anchor"))
            at = at.join(F.broadcast(anchors) if total <= max_broadcast_anchors else anchors, "anchor", "left_semi")  # positions stay in their tasks, or move
            at = at.groupBy("doc_id", "h").agg(F.collect_set("start").alias("starts")).select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "starts")
            both = words.select("doc_id", "h", "words").join(at.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")))
            both = both.select("doc_id", "h", F.explode(F.flatten(F.transform("starts", lambda i: _cut(F.col("words"), i, lengths)))).alias("x"))
            far = both if far is None else far.unionByName(both)
    # The pass over all texts is the costly part: its counts and what the anchors found are written once.
    rows = materialize(words.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.concat(*found).alias("cuts")), "scanned-texts")
    cuts = rows.where(F.size("cuts") > 0).select("doc_id", "h", F.explode("cuts").alias("x"))
    cuts = (cuts if far is None else cuts.unionByName(far)).select("doc_id", "h", "x.*")
    known = windows.select("n_words", "window").distinct()
    hits = cuts.join(F.broadcast(known) if small else known.hint("merge"), ["n_words", "window"], "left_semi").select("doc_id", "h", "start", "n_words", "window").distinct()
    return rows.drop("cuts"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS, max_broadcast_anchors: int = MAX_BROADCAST_ANCHORS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the hit word spans, and text_hash.

    `spans` lists the merged hit ranges as (start, end) word positions, end exclusive. A document is contaminated if it
    has hit words and they are at least a twentieth of its words. Null and empty texts have no words and are clean; rows
    of one id, and rows without an id, are judged each by its own text. Items without an id count as hits but are in no
    list. An empty benchmark leaves all documents clean.
    """
    # A few hundred items to a bounded table: read once, used three times.
    windows = materialize(benchmark_windows(benchmark, item_id, item_text, window), "benchmark-windows")
    small = windows.count() <= max_broadcast_windows
    rows, hits = scan(docs, windows, doc_id, text, max_broadcast_windows, max_broadcast_anchors)
    hits = materialize(hits, "window-hits")
    # Merge overlapping windows of a document: a range starts where no earlier window reaches.
    key = ["doc_id", "h"]
    order = Window.partitionBy(*key).orderBy("start", "n_words")
    reach = hits.groupBy(*key, "start").agg(F.max("n_words").alias("n_words"))
    reach = reach.withColumn("seen", F.coalesce(F.max(F.col("start") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reach = reach.withColumn("range", F.sum((F.col("start") > F.col("seen")).cast("int")).over(order))
    ranges = reach.groupBy(*key, "range").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_words")).alias("end"))
    spans = ranges.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = windows.where("item_id IS NOT NULL").select("window", "n_words", "item_id").distinct()
    hit_items = hits.select(*key, "n_words", "window").distinct().join(F.broadcast(items) if small else items.hint("merge"), ["n_words", "window"])
    listed = hit_items.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["of"]) & (a["h"] == b["of_h"])
    named = lambda df: df.withColumnsRenamed({"doc_id": "of", "h": "of_h"})
    listed = named(listed)
    facts = spans.join(listed.hint("merge"), same(spans, listed), "left").select(*key, "n_hit", "spans", "items")
    facts = named(facts)
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items_col = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(facts.hint("merge"), same(rows, facts), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_col), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.col("spans"), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.col("h").alias("text_hash"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents that are not contaminated, with all their columns, those without an id too."""
    bad = decontaminate(docs, benchmark, doc_id, text, **names).where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__h")).distinct()
    return docs.join(bad.hint("merge"), docs[doc_id].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text]) == bad["__h"]), "left_anti")
