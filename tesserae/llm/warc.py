"""Zstandard WARC archives: one frame per record, the dictionary in the leading skippable frame.

`write_archives` stores each page as a response record, or as a revisit of the page with the smallest id that has the
same payload. An archive is one binary value of bounded size in a table, written by Spark's committer, so it works on
any store and survives lost executors; `read_archives` takes such a table or `spark.read.format("binaryFile")` rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_materialized, fresh_path, materialize

#: Skippable frame that holds the dictionary, and the magic of a data frame (fixed by the formats).
DICT_FRAME, DATA_FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes that a frame may decode to: what an archive claims is not trusted.
MAX_RECORD_BYTES = 1 << 30
#: Bytes that a block decodes to at most (fixed by the format); the largest window and dictionary that are accepted.
BLOCK_BYTES, MAX_WINDOW, MAX_DICT_BYTES = 1 << 17, 1 << 27, 16 << 20
ARCHIVE_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS, DICT_BYTES = 32 << 20, 4 << 20, 400, 32 << 10
DATE = "2025-01-01T00:00:00Z"
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "path string, content binary"
RECORDS = "path string, record long, record_type string, record_id string, refers_to string, target_uri string, payload binary, payload_bytes long, payload_digest string, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record. A revisit (refers_to given) carries the HTTP head only, and the full payload's size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or f"{URN}{page_id}" if c.isprintable() and c != " ")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    """Frames of the records behind a dictionary trained on the first of them (none if they are too few to train one)."""
    sample, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        if size + len(r) > SAMPLE_BYTES:
            break
        sample.append(r)
        size += len(r)
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, sample) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        trained = None
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    raw = trained.as_bytes() if trained else b""
    lead = struct.pack("<II", DICT_FRAME, len(raw)) + raw
    return lead + b"".join(packer.compress(r) for r in records)


def _frame_end(data: bytes, at: int) -> tuple[int, int]:
    """(where the frame at `at` ends, the bytes that its blocks decode to at most), from its headers alone."""
    view = memoryview(data)
    try:
        p = at + zstandard.frame_header_size(view[at : at + 18])
        checked = zstandard.get_frame_parameters(view[at : at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise zstandard.ZstdError("the frame is cut off" if len(data) - at < 18 else str(e)) from e
    last, blocks = 0, 0
    while not last:
        if p + 3 > len(data):
            raise zstandard.ZstdError("the frame is cut off")
        head = int.from_bytes(view[p : p + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise zstandard.ZstdError("a block of an unknown kind")
        p += 3 + (1 if kind == 1 else size)  # a run is one byte
        blocks += 1
    p += 4 * checked
    if p > len(data):
        raise zstandard.ZstdError("the frame is cut off")
    return p, blocks * BLOCK_BYTES


def _decoded(decoder: zstandard.ZstdDecompressor, frame: bytes, most: int, bound: int) -> bytes:
    """A frame's bytes, if there are no more than `most`; never more than one byte beyond is made."""
    told = zstandard.get_frame_parameters(frame[:18]).content_size
    known = told if told < zstandard.CONTENTSIZE_UNKNOWN else bound
    if told < zstandard.CONTENTSIZE_UNKNOWN and told > most:
        raise zstandard.ZstdError(f"the frame holds more than {most} bytes")
    want, out = min(most, known, bound) + 1, []
    with decoder.stream_reader(frame) as reader:
        while want and (piece := reader.read(want)):
            out.append(piece)
            want -= len(piece)
    made = b"".join(out)
    if len(made) > most:
        raise zstandard.ZstdError(f"the frame holds more than {most} bytes")
    return made


def frames(data: bytes, max_record_bytes: int = MAX_RECORD_BYTES):
    """(frame number, record bytes or None, error or None) of an archive; decoding stops at the first broken or too large frame.

    Where a frame ends is read from its block headers. It is decoded only so far as its bound allows, so a small archive
    that decodes to a large one costs no more than the bound; windows beyond MAX_WINDOW are refused.
    """
    dictionary, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) < size:
            yield 0, None, "the dictionary frame is cut off"
            return
        if raw[:4] == struct.pack("<I", DATA_FRAME):  # the dictionary may itself be compressed
            try:
                raw = _decoded(zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW), raw, MAX_DICT_BYTES, _frame_end(raw, 0)[1])
            except zstandard.ZstdError as e:
                yield 0, None, f"dictionary: {e}"
                return
        dictionary, at = (zstandard.ZstdCompressionDict(raw) if raw else None), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary, max_window_size=MAX_WINDOW)
    number = 0
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if len(data) - at >= 8 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        try:
            end, bound = _frame_end(data, at)
            out = _decoded(decoder, data[at:end], max_record_bytes, bound)
        except zstandard.ZstdError as e:
            yield number, None, f"frame: {e}"
            return
        at = end
        yield number, out, None
        number += 1


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ValueError if a header or a length is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or no end of the headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header: {line[:60]}")
        fields.setdefault(name.lower(), value.strip())
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"missing {', '.join(missing)}")
    if fields["warc-type"] not in TYPES:
        raise ValueError(f"unknown type {fields['warc-type']}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("content length is not a number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content length is {length}, the record has {len(rest) - 4}")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    http, split, body = block.partition(b"\r\n\r\n")
    payload = body if split and fields.get("content-type", "").startswith("application/http") else block
    sizes = [line.split(b":")[1].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    size = int(sizes[0]) if sizes and sizes[0].isdigit() else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if fields["warc-type"] == "revisit":
        payload = None
        if "warc-refers-to" not in fields:
            raise ValueError("a revisit refers to nothing")
    else:
        if size != len(payload):
            raise ValueError(f"the HTTP length is {size}, the payload has {len(payload)}")
        own = base32_sha1(payload)
        if digest not in (None, own):
            raise ValueError("payload digest differs")
        digest = own
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return {"record_type": fields["warc-type"], "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": size, "payload_digest": digest}


def _archive_writer(batches):
    task, number, records, held = TaskContext.get().partitionId(), 0, [], 0

    def archive():
        return pa.RecordBatch.from_arrays([pa.array([f"{task:05d}-{number:05d}.warc.zst"]), pa.array([make_archive(records)], pa.binary())], ["path", "content"])

    for b in batches:
        for page, url, html, ref in zip(*(b.column(k) for k in ("page_id", "url", "payload", "refers_to")), strict=True):
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            r = make_record(page.as_py(), url.as_py(), payload, base32_sha1(payload), ref.as_py())
            records.append(r)
            held += len(r)
            if held >= ARCHIVE_BYTES:
                yield archive()
                records, held, number = [], 0, number + 1
    if records:
        yield archive()


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", url: str = "url", min_payload: int = 0) -> None:
    """A record per row of `pages` into archives at `path` (null payload: empty).

    Of rows with equal payloads of at least `min_payload` bytes the smallest id is the response, the others revisit it;
    rows without an id are responses; repeated rows of the smallest id are all responses. Equal payloads are found by
    their SHA-1 on rows of id and digest, so copies of one payload never meet as payloads: what each revisits comes to
    the payloads by page.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    uri = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), uri.alias("url"), body.alias("payload"), F.unhex(F.sha1(F.encode(body, "UTF-8"))).alias("digest"))
    known = rows.where((F.octet_length("payload") >= min_payload) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    groups = materialize(groups, "payload-groups")
    links = known.join(groups.hint("merge"), "digest").where("page_id > first").distinct()
    links = links.select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), F.col("first").alias("refers_to"))
    linked = rows.join(links.hint("merge"), (F.col("page_id") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left").select("page_id", "url", "payload", "refers_to")
    linked.mapInArrow(_archive_writer, ARCHIVES).write.parquet(path)
    drop_materialized(groups)


def read_archives(archives: DataFrame, strict: bool = True, max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """One row per record of archives (columns path, content): RECORDS.

    A broken frame, header or length, or a frame of more than `max_record_bytes`, raises, or, if not `strict`, gives a
    row with `error` set; an archive is decoded up to its first broken frame. A null or empty archive has no records.
    """

    def read(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, held = [], 0
                for number, raw, error in frames(content.as_py() or b"", max_record_bytes):
                    row = {"path": path, "record": number, "error": error}
                    if raw is not None:
                        try:
                            row |= parse_record(raw)
                        except (ValueError, UnicodeDecodeError) as e:
                            row["error"] = str(e)
                    if strict and row["error"]:
                        raise ValueError(f"{path}, record {number}: {row['error']}")
                    rows.append(row)
                    held += len(raw or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_ARROW)

    return archives.select("path", "content").mapInArrow(read, RECORDS)


RECORDS_ARROW = pa.schema([("path", pa.string()), ("record", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])


def archive_table(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Write archives (to `path`, else the shared folder) and read their records back."""
    at = path or fresh_path(pages.sparkSession, "archives")
    write_archives(pages, at, **names)
    return read_archives(pages.sparkSession.read.schema(ARCHIVES).parquet(at))


def page_rows(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS BIGINT)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
