"""N-gram Jaccard self-join by MinHash banding.

Texts with equal n-gram sets form a class; one representative each goes on. Bands and rows are chosen for a target
recall at the threshold. Representatives meet where a band's hash is equal; buckets with the same members are one.

Members of a bucket too large for one block are first compared with one pivot, on full sets: the bucket's consensus, the
n-grams that half of its members have. Jaccard distance is a metric and a pivot need not be a member, so members within
half the allowed distance of it (its core) all link with each other: they are counted without meeting. Copies of one
text, each changed a little, all lie around their consensus, however many they are. What is left has a consensus of
its own, once more; then it is cut into blocks of bounded size and every pair of blocks, but for those of one core,
is a group, in which all pairs are verified on their full n-gram sets. A pair counts in one of its buckets only. A
group returns a row per member, not per pair: the links it adds and the smallest member they connect it to; so the rows
stay linear in the members, however many pairs link.

Documents are known by their id and a hash of their text, so rows of one id with different texts, and rows without an
id, take part each on its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import drop_materialized, materialize, only_cache, shuffle_width, sliced
from tesserae.llm.graph import connected_components
from tesserae.llm.words import run_hashes, word_hashes

#: A block holds about so many members and n-grams at most, so a group of two fits in a few tens of MB.
BLOCK_MEMBERS, BLOCK_NGRAMS = 256, 500_000
#: Members that one copy of a pivot's set serves, and members that make a core worth blocks of its own.
PIVOT_MEMBERS, CORE_MEMBERS = 4096, 64


def ngram_hashes(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams (lower-cased white-space words); shorter texts are one n-gram."""
    h = word_hashes(text)
    return np.unique(run_hashes(h, min(n, len(h)))) if len(h) else h


def choose_bands(threshold: float, target_recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose recall at the threshold reaches the target within max_hashes."""
    best = None
    for rows in range(1, 17):
        missed = 1 - threshold**rows
        bands = math.ceil(math.log(1 - target_recall) / math.log(missed)) if missed > 0 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall")
    return best


def _signer(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    fold = rng.integers(1, 1 << 63, rows, np.uint64) | np.uint64(1)

    def signature(h: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(h), 4096):
            np.minimum(low, (np.multiply.outer(a, h[k : k + 4096]) + b[:, None]).min(axis=1), out=low)
        low ^= low >> np.uint64(31)
        mixed = (low.reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64)
        return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)

    def sign(batches):
        only_cache("words")
        for batch in batches:
            count, digest, bits = [], [], []
            for t in batch.column("text"):
                h = ngram_hashes(t.as_py(), n)
                count.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                bits.append(signature(h) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "h", "n", "digest", "bands"])

    return sign


def _set_maker(n: int):
    def make(batches):
        only_cache("words")
        for b in batches:
            sets = [ngram_hashes(t.as_py(), n).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], ["rep", "grams"])

    return make


def _gram_counts(batches):
    """How many of the members of a home in each task have an n-gram: (home, its members, gram, n); rows arrive ordered by home."""
    for b in batches:
        home = b.column("home").to_numpy()
        cuts = np.r_[0, np.flatnonzero(home[1:] != home[:-1]) + 1, len(home)] if len(home) else np.zeros(1, np.int64)
        grams = b.column("grams")
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            found, n = np.unique(np.concatenate([np.frombuffer(g.as_py(), np.uint64) for g in grams.slice(lo, hi - lo)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), home[lo])), b.column("m").slice(lo, 1).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found.view(np.int64)), pa.array(n)], ["home", "m", "gram", "n"])


def _near_pivot(threshold: float):
    """(rep, core) of the members within half the allowed distance of the pivot whose row leads their block; core is the pivot's number."""

    def near(batches):
        pivot, key = None, 0
        for b in batches:
            found = [], []
            for kind, rep, grams in zip(*(b.column(c).to_pylist() for c in ("kind", "rep", "grams")), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if kind == 0:
                    pivot, key = np.sort(own), rep
                    continue
                both = np.intersect1d(own, pivot, assume_unique=True).size
                if 2 * both >= (1 + threshold) * (len(own) + len(pivot) - both):
                    found[0].append(rep)
                    found[1].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["rep", "core"])

    return near


def _packed(batches):
    """(home, core, grams) of a consensus: its sorted n-grams as one byte string, and a number that equal ones share."""
    for b in batches:
        sets = [np.sort(np.asarray(g, np.int64).view(np.uint64)) for g in b.column("set").to_pylist()]
        keys = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets]
        yield pa.RecordBatch.from_arrays([b.column("home"), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["home", "core", "grams"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    m = len(sets)
    if m == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[0, both], [both, 0]])
    grams = np.concatenate(sets)
    if not len(grams):
        return np.zeros((m, m))
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    total, width = int(shared.sum()), 8192
    out = np.zeros((m, m), np.float64)
    cuts = np.searchsorted(column, np.arange(0, total + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            dense = np.zeros((m, min(width, total - k * width)), np.float32)
            dense[owner[part], column[part] - k * width] = 1
            out += dense @ dense.T
    return out


def _verifier(threshold: float):
    def group_rows(members: list[dict], bucket: int, left: int, right: int):
        """(rep, links, root) of the members that link inside this pair of blocks."""
        m = len(members)
        if m < 2:
            return []
        # A pair that shares a smaller bucket is handled there.
        own = [np.sort(np.array(x["buckets"], np.int64)) for x in members]
        mine = _overlaps([x[x < bucket] for x in own]) == 0
        if left != right:
            side = np.array([x["block"] for x in members])
            mine &= side[:, None] != side[None, :]
        np.fill_diagonal(mine, False)
        core = np.array([-1 if x["core"] is None else x["core"] for x in members])
        mine &= (core[:, None] != core[None, :]) | (core < 0)[:, None]  # pairs of one core are counted already
        if not mine.any():
            return []
        sets = [np.frombuffer(x["grams"], np.uint64) for x in members]
        size = np.array([len(s) for s in sets], np.float64)
        shared = _overlaps(sets)
        linked = mine & (shared > 0) & (shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9)
        links = linked @ np.array([x["size"] for x in members], np.int64)
        # The smallest member that links reach: minima pass along links until they rest.
        low = np.array([x["rep"] for x in members], np.int64)
        while True:
            after = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
            if np.array_equal(after, low):
                break
            low = after
        return [(members[k]["rep"], int(links[k]), int(low[k])) for k in np.nonzero(linked.any(axis=1))[0]]

    def verify(batches):
        key, held, out = None, [], []

        def flush():
            rows, out[:] = list(out), []
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "root"])

        for b in batches:
            for row in b.to_pylist():
                own = (row["bucket"], row["left"], row["right"])
                if own != key:
                    if held:
                        out += group_rows(held, *key)
                    key, held = own, []
                held.append(row)
            if len(out) > 10_000:
                yield flush()
        if held:
            out += group_rows(held, *key)
        if out:
            yield flush()

    return verify


def _cores(big: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, core) of the members of large buckets that lie close to the consensus of a bucket they are in.

    A member's home is the largest bucket it is in; the consensus of the members at home there is a pivot, so a set is
    read once for it. All members of a bucket meet the pivot that most of them have at home; equal pivots are one.
    """
    spark, inside = big.sparkSession, big.select("bucket", "rep")
    sizes = inside.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_MEMBERS)
    homes = materialize(inside.join(sizes.hint("merge"), "bucket").groupBy("rep").agg(F.max(F.struct("m", "bucket"))["bucket"].alias("home")), "homes")
    held = homes.groupBy("home").agg(F.count("*").alias("m")).where(F.col("m") >= CORE_MEMBERS)
    members = homes.join(held.hint("merge"), "home").join(sets.hint("merge"), "rep").select("home", "m", "grams")
    counts = members.sortWithinPartitions("home").mapInArrow(_gram_counts, "home long, m long, gram long, n long").groupBy("home", "m", "gram").agg(F.sum("n").alias("n"))
    # A consensus holds at most twice as many n-grams as its members do on average.
    pivots = counts.where(2 * F.col("n") >= F.col("m")).groupBy("home").agg(F.collect_list("gram").alias("set")).mapInArrow(_packed, "home long, core long, grams binary")
    pivots = materialize(pivots, "consensus")
    # A bucket's pivot is the one that most of its members have at home.
    at_home = homes.join(pivots.select("home", "core").hint("merge"), "home").select("rep", "core")
    votes = inside.join(at_home.hint("merge"), "rep").groupBy("bucket", "core").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "core"))["core"].alias("core"))
    pairs = materialize(inside.join(votes.hint("merge"), "bucket").select("core", "rep").distinct(), "core-candidates")
    copies = pairs.groupBy("core").agg(F.ceil(F.count("*") / PIVOT_MEMBERS).cast("int").alias("copies"))
    cells = pairs.join(copies.hint("merge"), "core").select("core", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "rep")
    cells = cells.hint("merge").join(sets, "rep").select("core", "copy", "kind", "rep", "grams")
    leads = pivots.select("core", "grams").dropDuplicates(["core"]).join(copies.hint("merge"), "core")
    leads = leads.select("core", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.col("core").alias("rep"), "grams")
    rows = cells.unionByName(leads).repartition(shuffle_width(spark), "core", "copy").sortWithinPartitions("core", "copy", "kind")
    close = materialize(rows.mapInArrow(sliced(_near_pivot(threshold)), "rep long, core long"), "close")
    # Of several cores the one with most members takes a document.
    width = close.groupBy("core").agg(F.count("*").alias("m"))
    near = close.join(width.hint("merge"), "core").groupBy("rep").agg(F.max(F.struct("m", "core"))["core"].alias("core"))
    out = materialize(near, "cores")
    drop_materialized(homes, pivots, pairs, close)
    return out


def _block_cells(inside: DataFrame, cores: DataFrame) -> DataFrame:
    """(bucket, left, right, block, rep) of the members of large buckets for every pair of blocks that is to be verified."""
    tagged = inside.drop("parts").join(cores.hint("merge"), "rep", "left")
    weight = tagged.groupBy("bucket", "core").agg(F.count("*").alias("c"), F.sum("n").alias("g"))
    # Small cores share blocks with what has none; pairs inside them are left out when pairs are verified.
    weight = weight.withColumn("group", F.when(F.col("c") >= CORE_MEMBERS, F.col("core")))
    groups = weight.groupBy("bucket", "group").agg(F.ceil(F.greatest(F.sum("c") / BLOCK_MEMBERS, F.sum("g") / BLOCK_NGRAMS)).cast("int").alias("parts"))
    upto = F.sum("parts").over(Window.partitionBy("bucket").orderBy("group"))
    groups = groups.withColumns({"from": (upto - F.col("parts")).cast("int"), "total": F.sum("parts").over(Window.partitionBy("bucket")).cast("int")})
    where = materialize(weight.select("bucket", "core", "group").join(groups.withColumnsRenamed({"bucket": "b", "group": "g"}), (F.col("bucket") == F.col("b")) & F.col("group").eqNullSafe(F.col("g"))).drop("b", "g"), "bucket-blocks")
    where = where.withColumnsRenamed({"bucket": "b", "core": "of"})
    cells = tagged.join(where.hint("merge"), (F.col("bucket") == F.col("b")) & F.col("core").eqNullSafe(F.col("of")))
    cells = cells.withColumn("block", F.col("from") + F.pmod(F.xxhash64("rep", "bucket"), F.col("parts")).cast("int"))
    apart = lambda o: F.col("group").isNull() | (o < F.col("from")) | (o >= F.col("from") + F.col("parts"))
    cells = cells.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("total") - 1), apart)))
    return cells.select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "rep")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.9995, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links, text_hash, kept_hash.

    Two rows link if the Jaccard similarity of their n-gram sets is at least `threshold` (equal sets always do);
    class_id is the smallest id that links reach (null where they reach no id), n_links the number of rows a row links
    to, other rows of its own id included. Rows without words link to nothing and are their own class. kept_hash is the
    text_hash of the row of class_id that stands for the class. Ids of any type that has an order; other columns are not read.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, target_recall)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    signed = materialize(plain.mapInArrow(sliced(_signer(n, bands, rows, seed)), f"doc_id {kind}, h long, n long, digest binary, bands array<long>"), "signatures")
    # A class's number is drawn once and written, so it never changes; ids come in again at the end.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("f")
    classes = signed.where("n > 0").groupBy("digest").agg(first, F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "ngram-classes")
    spots = classes.select("rep", "n", F.posexplode("bands").alias("band", "hash"))
    # A bucket's identity is its membership: equal buckets of several bands are one. A bucket is a few hashes and
    # counts here, pre-aggregated before the shuffle.
    mixed = (F.xxhash64("rep"), F.xxhash64("rep", F.lit(7)))
    buckets = spots.groupBy("band", "hash").agg(
        F.count("*").alias("m"), F.sum("n").alias("grams"), F.xxhash64(F.count("*"), F.bit_xor(mixed[0]), F.bit_xor(mixed[1]), F.min("rep"), F.max("rep")).alias("bucket")
    ).where("m > 1")
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("grams") / BLOCK_NGRAMS)).cast("int")
    buckets = materialize(buckets.select("band", "hash", "bucket", parts.alias("parts")), "buckets")
    # Candidates grow with the input, so these joins are merges at every size: no broadcast that fits a small table only.
    inside = materialize(spots.join(buckets.hint("merge"), ["band", "hash"]).select("bucket", "parts", "rep", "n").distinct(), "bucket-members")
    mine = inside.groupBy("rep").agg(F.collect_set("bucket").alias("buckets"))  # at most `bands` of them
    mine = materialize(mine.join(classes.hint("merge"), "rep").select("rep", "size", "buckets", F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("first_h")), "candidates")
    sets = plain.join(mine.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).select("rep", "text")
    sets = sets.mapInArrow(sliced(_set_maker(n)), "rep long, grams binary").dropDuplicates(["rep"])  # repeated rows
    small = inside.where("parts = 1").select("bucket", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("block"), "rep")
    large = inside.where("parts > 1")
    made = [buckets, inside, mine]
    if large.isEmpty():
        cells, told, in_cores = small, mine.withColumn("core", F.lit(None).cast("long")), None
    else:
        sets = materialize(sets, "ngram-sets")
        cores = _cores(large, sets, threshold)
        cells, told = small.unionByName(_block_cells(large, cores)), mine.join(cores.hint("merge"), "rep", "left")
        whole = cores.join(mine.select("rep", "size"), "rep")
        total = materialize(whole.groupBy("core").agg(F.sum("size").alias("total"), F.min("rep").alias("root")), "core-sizes")
        in_cores = whole.join(total, "core").select("rep", (F.col("total") - F.col("size")).alias("links"), "root")
        made += [sets, cores, total]
    told = sets.join(told.select("rep", "size", "buckets", "core").hint("merge"), "rep")
    groups = cells.hint("merge").join(told, "rep").repartition(shuffle_width(spark), "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "rep")
    groups = groups.select("bucket", "left", "right", "block", "rep", "size", "buckets", "core", "grams")
    found = groups.mapInArrow(sliced(_verifier(threshold)), "rep long, links long, root long")
    found = materialize(found if in_cores is None else found.unionByName(in_cores), "verified")
    drop_materialized(*made)
    roots = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = links.join(roots, links["rep"] == roots["node"], "left").select("rep", "links", "root")
    numbered = classes.select("rep", "digest", "f", "size").join(linked.hint("merge"), "rep", "left")
    numbered = materialize(numbered.select("digest", "f", F.coalesce("root", "rep").alias("root"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "class-links")
    leads = materialize(numbered.groupBy("root").agg(F.min("f").alias("lead")), "class-leads")
    known = materialize(numbered.join(leads, "root").select("digest", "links", F.col("lead.doc_id").alias("class_id"), F.col("lead.h").alias("kept_hash")), "class-rows")
    drop_materialized(found, classes, numbered, leads)
    # Rows without words have no digest and stay out of the join; a digest of many rows is a skewed key of a plain merge.
    out = signed.where("digest IS NOT NULL").select("doc_id", "h", "digest").join(known.hint("merge"), "digest")
    out = out.select("doc_id", "class_id", F.col("links").alias("n_links"), F.col("h").alias("text_hash"), "kept_hash")
    wordless = signed.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("h").alias("text_hash"), F.col("h").alias("kept_hash"))
    return out.unionByName(wordless)


def keep_one_per_class(docs: DataFrame, joined: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that are not duplicates: a class keeps one row, of its smallest id.

    Repeated rows, of one id and one text, stand or fall together. Of rows without an id that have equal texts one stays,
    if their class holds no id; rows without words stay.
    """
    other = ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("kept_hash")))
    extra = joined.where(other).select(F.col("doc_id").alias("__extra"), F.col("text_hash").alias("__h")).distinct()
    h, id_ = F.xxhash64(docs[text]), docs[doc_id]
    named, unnamed = extra.where("__extra IS NOT NULL").hint("merge"), extra.where("__extra IS NULL").hint("merge")
    known = docs.where(id_.isNotNull()).join(named, (id_ == named["__extra"]) & (h == named["__h"]), "left_anti")
    nameless = docs.where(id_.isNull()).join(unnamed, h == unnamed["__h"], "left_anti")
    blank = F.coalesce(F.trim(F.regexp_replace(F.col(text), r"\s", "")) == "", F.lit(True))
    key = max(docs.columns, key=len) + "_hash"  # no column has this name
    one = nameless.where(~blank).withColumn(key, F.xxhash64(F.col(text))).dropDuplicates([key]).drop(key)
    return known.unionByName(one).unionByName(nameless.where(blank))
