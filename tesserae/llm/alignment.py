"""Alignment of two tokenizers over the bytes of a text.

Both token sequences spell the same bytes. Token indices repeated over their bytes give the owner of each byte for A and
for B: consecutive distinct pairs of owners are the tokens that overlap, and places where both owners change at once cut
the tokens into groups. How many documents hold a pair of ids is counted over the whole corpus and joined back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_materialized, materialize, tokenizer_path
from tesserae.llm.encoding import encoder, piece_encoder

#: Bytes of a text whose owners are held at once; longer texts are taken in stretches that end where both tokens end.
STRETCH = 1 << 20
#: Rows of one output batch.
ROWS = 128
#: Pairs of ids (with a count and a mark, some 25 bytes each) that may be broadcast; more are joined by a merge.
MAX_BROADCAST_PAIRS = 2_000_000
ALIGNED = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Side:
    """One tokenizer: ids of a text, the bytes of its entries, and the decimal ids with what follows them inside groups."""

    def __init__(self, ids, entries: list[bytes], ends: str):
        self.ids = ids
        self.lens = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.names = np.array([[f"{k}{end}" for k in range(len(entries))] for end in ends], object)


_SIDES: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """One pair per worker process."""
    if (path_a, path_b) not in _SIDES:
        a, b = encoder(path_a, plain=True), piece_encoder(path_b)
        _SIDES[path_a, path_b] = Side(lambda t: a.ids(" " + t), a.entry_bytes(), ",|"), Side(b.ids, b.entry_bytes(), ",;")
    return _SIDES[path_a, path_b]


def _spelled(side: Side, ids: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The bytes of the tokens, one after another."""
    return side.flat[(side.starts[ids] - begins)[owner] + np.arange(len(owner))]


def owners(lens: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lens), dtype=np.int32), lens)


def overlaps(own_a: np.ndarray, own_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens, B tokens) of every overlap in order, and the bytes at which groups begin (but for the first)."""
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    at = np.flatnonzero(np.r_[True, new_a | new_b])
    return own_a[at], own_b[at], np.flatnonzero(new_a & new_b) + 1


def _stretches(len_a: np.ndarray, len_b: np.ndarray, most: int):
    """Token ranges (a0, a1, b0, b1) that spell the same bytes, of about `most` bytes each."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    if end_a[-1] <= most:
        return [(0, len(len_a), 0, len(len_b))]
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    cuts = np.unique(both[np.searchsorted(both, np.arange(most, end_a[-1] + most, most).clip(max=end_a[-1]))])
    a, b = np.r_[0, np.searchsorted(end_a, cuts) + 1], np.r_[0, np.searchsorted(end_b, cuts) + 1]
    return zip(a[:-1], a[1:], b[:-1], b[1:], strict=True)


def align_text(text: str | None, a: Side, b: Side, stretch: int = STRETCH) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """(A tokens, B tokens, groups, links, digest of the groups, linked id pairs as a << 32 | b, how often each is linked)."""
    none = 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
    if not text:
        return none
    raw = np.frombuffer((" " + text).encode(), np.uint8)
    ids_a, ids_b = a.ids(text), b.ids(text)
    len_a, len_b = a.lens[ids_a], b.lens[ids_b]
    if len_a.sum() != len(raw) or len_b.sum() != len(raw):
        return none
    groups, made, digest, at = 0, [], hashlib.sha256(), 0
    for a0, a1, b0, b1 in _stretches(len_a, len_b, stretch):
        ia, ib = ids_a[a0:a1], ids_b[b0:b1]
        own_a, own_b = owners(len_a[a0:a1]), owners(len_b[b0:b1])
        begin_a, begin_b = np.cumsum(len_a[a0:a1]) - len_a[a0:a1], np.cumsum(len_b[b0:b1]) - len_b[b0:b1]
        here = raw[at : at + len(own_a)]
        if not np.array_equal(_spelled(a, ia, own_a, begin_a), here) or not np.array_equal(_spelled(b, ib, own_b, begin_b), here):
            return none
        x, y, cuts = overlaps(own_a, own_b)
        made.append(ia[x].astype(np.int64) << 32 | ib[y])
        starts = np.zeros(len(own_a), bool)
        starts[cuts] = True
        of_a, of_b = np.cumsum(starts[begin_a]), np.cumsum(starts[begin_b])  # each token's group
        per_a, per_b = np.bincount(of_a), np.bincount(of_b)
        words = np.empty(len(ia) + len(ib), object)
        words[np.arange(len(ia)) + (np.cumsum(per_b) - per_b)[of_a]] = a.names[np.r_[of_a[1:] != of_a[:-1], True].astype(np.int8), ia]
        words[np.arange(len(ib)) + np.cumsum(per_a)[of_b]] = b.names[np.r_[of_b[1:] != of_b[:-1], True].astype(np.int8), ib]
        at += len(own_a)
        said = "".join(words.tolist())
        digest.update((said if at < len(raw) else said[:-1]).encode())
        groups += len(cuts) + 1
    pairs, times = np.unique(np.concatenate(made), return_counts=True)
    return len(ids_a), len(ids_b), groups, int(times.sum()), digest.hexdigest(), pairs, times.astype(np.int32)


def _aligner(path_a: str, path_b: str, stretch: int):
    def align(batches):
        a, b = sides(path_a, path_b)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows = [align_text(t.as_py(), a, b, stretch) for t in part.column("text")]
                lists = []
                for k, kind in ((5, pa.int64()), (6, pa.int32())):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[k] for r in rows]), kind)))
                plain = [pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *plain, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return align


def align(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 32 | b, distinct), times.

    A encodes a space and the text, B the text, both without special tokens; special strings in texts are plain text. Null
    and empty texts, and those that one of the tokenizers does not spell byte for byte, have no tokens: zeros, '' and empty
    lists. Repeated ids are rows of their own; other columns are not read. A text is held whole, its owners by stretches.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_aligner(tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b), stretch), ALIGNED.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each linked id pair, and whether no pair of its A id is held by more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_scores(docs: DataFrame, broadcast_pairs: int = MAX_BROADCAST_PAIRS, **names) -> DataFrame:
    """The columns of `align` but for the lists, with n_best (links whose pair is the best of its A id) and count_sum.

    Up to `broadcast_pairs` distinct pairs are broadcast; more are joined by a merge, where a frequent pair is a skewed key
    that adaptive execution splits. An empty table gives no rows.
    """
    aligned = materialize(align(docs, **names).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(aligned), "best-pairs")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    links = links.join(counts.hint("broadcast" if counts.count() <= broadcast_pairs else "merge"), "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = materialize(sums, "link-sums")
    out = aligned.drop("pairs", "times").join(sums.hint("merge"), "row", "left").drop("row")
    drop_materialized(counts)
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
