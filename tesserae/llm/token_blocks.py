"""Token-id output in patched frame-of-reference blocks.

A segment is one byte string, little-endian throughout:

    magic "PFB1" | u32 block length | u64 ids | u32 blocks | u32 x (blocks + 1) byte starts of the blocks in the body | body
    block: u32 minimum | u8 bit width | u16 exceptions | u16 x e positions | u32 x e high bits | packed low bits

An id is its block's minimum plus its low bits, plus its high bits shifted left by the width where it is an exception.
The width is the bit length at a chosen percentile of the block's differences, so rare large ids do not widen the rest.
The last block is filled up with its minimum. A file set is a Parquet table of segments in ascending id order of the
documents, each with its documents' ids and lengths; Spark's committer makes the write survive lost executors.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import fresh_path, shuffle_width, sliced, tokenizer_path
from tesserae.llm.encoding import encoder

MAGIC, BLOCK, PERCENTILE = b"PFB1", 256, 0.95
HEAD = struct.Struct("<4sIQI")
#: A segment closes at the document that reaches so many ids: a few hundred KB, whatever the table's size.
SEGMENT_IDS = 1 << 18
SEGMENTS = "shard int, segment int, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack_bits(values: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each row's values, one after another from the lowest bit; eight values fill w bytes."""
    rows, n = values.shape
    out = np.zeros((rows, -(-n // 8), w), np.uint8)
    kind = np.uint32 if w <= 24 else np.uint64
    low = np.zeros((rows, -(-n // 8) * 8), kind)
    low[:, :n] = values & values.dtype.type((1 << w) - 1)
    for j in range(8):
        byte, shift = divmod(j * w, 8)
        part = low[:, j::8] << kind(shift)
        for t in range((shift + w + 7) // 8):
            out[:, :, byte + t] |= (part >> kind(8 * t)).astype(np.uint8)
    return out.reshape(rows, -1)[:, : (n * w + 7) // 8]


def _unpack_bits(raw: np.ndarray, w: int, n: int) -> np.ndarray:
    """The n values of w bits in each row of bytes."""
    rows = len(raw)
    groups = -(-n // 8)
    full = np.zeros((rows, groups * w), np.uint8)
    full[:, : raw.shape[1]] = raw
    full = full.reshape(rows, groups, w)
    out = np.empty((rows, groups * 8), np.uint32)
    kind = np.uint32 if w <= 24 else np.uint64
    for j in range(8):
        byte, shift = divmod(j * w, 8)
        value = full[:, :, byte].astype(kind)
        for t in range(1, (shift + w + 7) // 8):
            value |= full[:, :, byte + t].astype(kind) << kind(8 * t)
        out[:, j::8] = (value >> kind(shift)) & kind((1 << w) - 1)
    return out[:, :n]


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A segment's bytes for an array of ids below 2**32."""
    n = len(ids)
    blocks = -(-n // block)
    if not blocks:
        return HEAD.pack(MAGIC, block, 0, 0) + np.zeros(1, "<u4").tobytes()
    wide = "<u2" if int(ids.max()) < 1 << 16 else "<u4"
    full = np.empty(blocks * block, wide)
    full[:n] = ids
    full[n:] = full[(blocks - 1) * block : n].min()
    full = full.reshape(blocks, block)
    low = full.min(axis=1)
    diff = full - low[:, None]
    rank = max(0, int(np.ceil(percentile * block)) - 1)
    width = _bit_length(np.partition(diff, rank, axis=1)[:, rank])
    row, pos = np.nonzero(diff > ((1 << width) - 1).astype(diff.dtype)[:, None])
    exceptions = np.bincount(row, minlength=blocks)
    head = 7 + 6 * exceptions
    size = head + (block * width + 7) // 8
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    body = np.zeros(starts[-1], np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        raw = values.reshape(len(at), -1).view(np.uint8)
        body[at[:, None] + np.arange(raw.shape[1])] = raw

    put(starts[:-1], low.astype("<u4")[:, None])
    body[starts[:-1] + 4] = width
    put(starts[:-1] + 5, exceptions.astype("<u2")[:, None])
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        put(starts[row] + 7 + 2 * nth, pos.astype("<u2")[:, None])
        high = diff[row, pos].astype(np.uint64) >> width[row].astype(np.uint64)
        put(starts[row] + 7 + 2 * exceptions[row] + 4 * nth, high.astype("<u4")[:, None])
    for w in np.unique(width):
        if w:
            own = np.nonzero(width == w)[0]
            put(starts[own] + head[own], _pack_bits(diff[own], int(w)))
    return HEAD.pack(MAGIC, block, n, blocks) + starts.astype("<u4").tobytes() + body.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if its header, index or length is wrong."""
    if len(data) < HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a segment of token blocks")
    _, block, n, blocks = HEAD.unpack_from(data)
    at = HEAD.size + 4 * (blocks + 1)
    if len(data) < at:
        raise ValueError("a segment ends inside its index")
    starts = np.frombuffer(data, "<u4", blocks + 1, HEAD.size).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at)
    if starts[-1] != len(body) or np.any(np.diff(starts) < 7) or not (blocks - 1) * block < n <= blocks * block and blocks:
        raise ValueError("a segment's length does not agree with its index")

    def take(start: np.ndarray, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(body[start[:, None] + np.arange(size)]).view(kind)[:, 0]

    if not blocks:
        return np.zeros(0, np.uint32)
    begin = starts[:-1]
    low, width, exceptions = take(begin, "<u4"), body[begin + 4].astype(np.int64), take(begin + 5, "<u2").astype(np.int64)
    head = 7 + 6 * exceptions
    out = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.nonzero(width == w)[0]
            raw = body[(begin[own] + head[own])[:, None] + np.arange((block * w + 7) // 8)]
            out[own] = _unpack_bits(raw, int(w), block)
    row = np.repeat(np.arange(blocks), exceptions)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        pos = take(begin[row] + 7 + 2 * nth, "<u2")
        high = take(begin[row] + 7 + 2 * exceptions[row] + 4 * nth, "<u4")
        out[row, pos] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    out += low.astype(np.uint32)[:, None]
    return out.reshape(-1)[:n]


def block_ids(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, found through the index of block starts."""
    _, block, n, blocks = HEAD.unpack_from(data)
    if not 0 <= k < blocks:
        raise IndexError(k)
    starts = np.frombuffer(data, "<u4", blocks + 1, HEAD.size)
    at = HEAD.size + 4 * (blocks + 1)
    one = data[at + int(starts[k]) : at + int(starts[k + 1])]
    count = min(block, n - k * block)
    return unpack(HEAD.pack(MAGIC, block, count, 1) + np.array([0, len(one)], "<u4").tobytes() + one)


def _segment_writer(path: str, end_id: int, target: int):
    def write(batches):
        enc, shard, number = encoder(path), TaskContext.get().partitionId(), 0
        ids, lens, parts, held = [], [], [], 0

        def segment():
            payload = pack(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["shard", "segment", "n_ids", "doc_ids", "doc_lens", "payload"],
            )

        end = np.array([end_id], enc.width)
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                own = enc.ids(text.as_py() or "")
                parts += [own, end]
                ids.append(doc)
                lens.append(len(own) + 1)
                held += len(own) + 1
                if held >= target:
                    yield segment()
                    ids, lens, parts, held, number = [], [], [], 0, number + 1
        if ids:
            yield segment()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text (null: empty), append `end_id` to each, and write segments in ascending doc_id order to `path`.

    Texts are range-partitioned by id before they are encoded, so nothing is encoded twice and shards follow the order.
    Null ids come first; rows of one id are ordered by their texts' hash. An empty table writes no segments.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(sliced(_segment_writer(tokenizer_path(tokenizer), end_id, segment_ids)), SEGMENTS).write.parquet(path)


def _document_reader(batches):
    for b in batches:
        cols = {k: [] for k in ("shard", "segment", "nth", "doc_id", "n_tokens", "ids_crc32")}
        for r in b.to_pylist():
            ids = unpack(r["payload"]).astype("<u4")
            if len(ids) != r["n_ids"] or sum(r["doc_lens"]) != r["n_ids"]:
                raise ValueError("a segment's documents do not add up to its ids")
            at = 0
            for k, (doc, n) in enumerate(zip(r["doc_ids"], r["doc_lens"], strict=True)):
                for name, v in zip(cols, (r["shard"], r["segment"], k, doc, n, zlib.crc32(ids[at : at + n].tobytes())), strict=True):
                    cols[name].append(v)
                at += n
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))


def read_documents(spark, path: str) -> DataFrame:
    """Per document of the written segments: doc_id, start (ids before it), n_tokens, ids_crc32, shard, segment."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    found = segments.mapInArrow(_document_reader, "shard int, segment int, nth long, doc_id long, n_tokens long, ids_crc32 long")
    # Offsets: one row per shard (as many as partitions wrote) is summed in order, then segments inside each shard.
    sizes = segments.select("shard", "segment", "n_ids", "doc_lens")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("segment_start"))
    starts = starts.join(F.broadcast(shards), "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    nth = Window.partitionBy("shard", "segment").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.join(starts, ["shard", "segment"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(nth), F.lit(0)))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment")


def token_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", path: str | None = None, **names) -> DataFrame:
    """Write `docs` as token blocks (to `path`, else the shared folder) and read the documents back from them."""
    at = path or fresh_path(docs.sparkSession, "token-blocks")
    write_tokens(docs, at, tokenizer, **names)
    return read_documents(docs.sparkSession, at)
