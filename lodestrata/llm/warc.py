"""Zstandard WARC archives: a writer with a shared dictionary and a validating reader.

Layout of an archive: a skippable frame with the dictionary, then one zstd frame per record. Records are WARC/1.1
``response`` (HTTP headers and payload) or ``revisit`` (HTTP headers only, refers to the response with the same
payload). Files are bounded in size, written in the shared folder under names of their own; only a manifest that
Spark commits says which of them count, so a task that is run again leaves nothing behind that is read.

Defined results: null html is an empty payload; of equal payloads of at least ``revisit_min`` bytes the largest
page_id is the response (all rows that repeat that id are), a null page_id never wins unless alone, when it stays
a response; an empty table gives no records. Extra columns are ignored. Payloads are equal if their SHA-256 and lengths are;
the SHA-1 of the format only names them. The join of pages and winners is an equi-join by that key, of which AQE splits the
partition that a very common page fills.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.storage import materialise, shared_dir

#: Skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
#: An archive is closed beyond this many compressed bytes.
ARCHIVE_BYTES = 8_000_000
#: At most this many pages of at most this many characters are looked at to train the dictionary.
DICT_PAGES, DICT_CHARS, DICT_BYTES = 200, 8_000, 32_000
RECORD = "urn:lodestrata:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-31T00:00:00Z"

MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, offset long"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {target}"] if target else []),
        *([f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"WARC-Block-Digest: sha1:{_digest(block)}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, first: bytes) -> tuple[dict[str, str], int]:
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(first):
        raise WarcError("no header block")
    try:
        lines = raw[:end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("a header is no UTF-8") from e
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out, end + 4


def _page(urn: str) -> int | None:
    if not urn.startswith(f"<{RECORD}") or not urn.endswith(">"):
        raise WarcError(f"unknown record id {urn[:80]!r}")
    number = urn[len(RECORD) + 1 : -1]
    return _whole(number, "record id", signed=True) if number else None


def _whole(text: str | None, what: str, signed: bool = False) -> int:
    """A whole number as the format writes it."""
    digits = (text or "").removeprefix("-") if signed else text or ""
    if not (digits.isascii() and digits.isdigit()):
        raise WarcError(f"no {what}: {(text or '')[:80]!r}")
    return int(text)


def _header(head: dict[str, str], name: str) -> str:
    if name not in head:
        raise WarcError(f"no {name}")
    return head[name]


def decode_record(raw: bytes) -> dict:
    """Fields of one record; raises WarcError if a header, a length or a digest is wrong."""
    head, at = _headers(raw, b"WARC/1.1\r\n")
    size = _whole(head.get("content-length"), "Content-Length")
    if len(raw) != at + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    block = raw[at : at + size]
    if head.get("warc-block-digest") != f"sha1:{_digest(block)}":
        raise WarcError("block digest differs")
    http, start = _headers(block, b"HTTP/1.1 ")
    kind, payload, length = head.get("warc-type"), block[start:], _whole(http.get("content-length"), "Content-Length of the response")
    algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1":
        raise WarcError("no payload digest")
    if kind == "response" and (len(payload) != length or _digest(payload) != digest):
        raise WarcError("payload differs from its length or digest")
    if kind == "revisit" and (payload or head.get("warc-profile") != PROFILE):
        raise WarcError("a revisit with a payload or another profile")
    if kind not in ("response", "revisit"):
        raise WarcError(f"unknown type {kind!r}")
    return {
        "page_id": _page(_header(head, "warc-record-id")), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(_header(head, "warc-refers-to")) if kind == "revisit" else None, "target_uri": head.get("warc-target-uri"), "payload": payload,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame that starts at ``at`` ends, from its block headers alone."""
    if bytes(data[at : at + 4]) != b"\x28\xb5\x2f\xfd":
        raise WarcError("not a zstd frame")
    pos = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    checksum = data[at + 4] & 4
    while True:
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if pos > len(data):
            raise WarcError("a frame is cut off")
        if block & 1:
            return pos + (4 if checksum else 0)


def split_archive(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The dictionary of the leading skippable frame, and the byte range of every record's frame."""
    view = memoryview(data)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        raise WarcError("no leading dictionary frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise WarcError("the dictionary is cut off")
    dictionary, frames = bytes(view[8:at]), []
    while at < len(data):
        end = frame_end(view, at)
        frames.append((at, end))
        at = end
    return dictionary, frames


def read_archive(data: bytes) -> Iterator[tuple[int, dict]]:
    """Offset and fields of every record."""
    dictionary, frames = split_archive(data)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    for at, end in frames:
        yield at, decode_record(reader.decompress(data[at:end]))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty if there is too little to learn from."""
    rows = pages.where("html IS NOT NULL").select(F.substring("html", 1, DICT_CHARS)).limit(DICT_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r[0].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_winners(pages: DataFrame, revisit_min: int = 0) -> DataFrame:
    """page_id, url, html and the page_id whose response a record revisits (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.concat(F.unhex(F.sha2(F.col("html").cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.octet_length("html").cast("long")), 16, "0"))))
    best = rows.groupBy("key").agg(F.max("page_id").alias("best"))
    again = (F.octet_length("html") >= revisit_min) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return rows.join(best, "key").select("page_id", "url", "html", F.when(again, F.col("best")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, revisit_min: int = 0) -> DataFrame:
    """Write every page as a record under ``folder``; returns the committed manifest."""
    trained = train_dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
        parts, size, count, done = [], 0, 0, []

        def close() -> None:
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            body = struct.pack("<II", DICT_MAGIC, len(trained)) + trained + b"".join(parts)
            with fs.open_output_stream(name) as out:
                out.write(body)
            done.append((f"{folder}/{name.rpartition('/')[2]}", count, len(body)))

        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.append(packer.compress(encode_record(page_id, url, html or b"", refers)))
                size, count = size + len(parts[-1]), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    parts, size, count = [], 0, 0
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    rows = with_winners(pages, revisit_min).withColumn("html", F.col("html").cast("binary"))
    return materialise(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the manifest's archives, one archive at a time in memory; raises on any that is not valid."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for f in frames:
            for archive, expected in zip(f["archive"], f["records"], strict=True):
                fs, path = pafs.FileSystem.from_uri(archive)
                with fs.open_input_stream(path) as stream:
                    rows = [r | {"archive": archive, "offset": at} for at, r in read_archive(stream.read())]
                if len(rows) != expected:
                    raise WarcError(f"{archive}: {len(rows)} records, {expected} written")
                out = pd.DataFrame(rows, columns=names + ["payload"] * payload)
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "archive")
    return spread.mapInPandas(read, RECORDS + ", payload binary" * payload)


def warc_round_trip(pages: DataFrame, revisit_min: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, then read them back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, revisit_min))
