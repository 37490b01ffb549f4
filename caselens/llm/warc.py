"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts_for

DICT_MAGIC = 0x184D2A5D  # skippable frame that holds the dictionary
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20  # payload that one archive is meant to hold
DICT_BYTES = 32 << 10
DICT_SAMPLE = 200  # records of an archive that its dictionary is made from
MAX_RECORD_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """The bytes aren't a well-formed archive."""


def record_bytes(page_id: int | str | None, url: str, payload: bytes | None, digest: str, length: int, refers_to: int | str | None) -> bytes:
    """One WARC/1.1 record. payload None: a revisit, whose block ends after the HTTP header. A null id is named null."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive: the skippable dictionary frame, then a frame per record.

    A raw-content dictionary of the first records' heads and bodies serves; a trained one needs more records than a
    small archive has.
    """
    sample = b"".join(r[: max(256, DICT_BYTES // DICT_SAMPLE)] for r in records[:DICT_SAMPLE])[-DICT_BYTES:]
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=True, write_content_size=True)
    stored = zstandard.ZstdCompressor(level=9).compress(sample)
    return struct.pack("<II", DICT_MAGIC, len(stored)) + stored + b"".join(map(packer.compress, records))


def split_frames(data: bytes) -> tuple[bytes, Iterator[bytes]]:
    """The dictionary and the decoded frames. Raises BadArchive."""
    if len(data) < 8:
        raise BadArchive("too short for a dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC or 8 + size > len(data):
        raise BadArchive("no whole dictionary frame leads the archive")
    raw = data[8 : 8 + size]
    try:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=MAX_RECORD_BYTES) if raw[:4] == ZSTD_MAGIC else raw
    except zstandard.ZstdError as e:
        raise BadArchive(f"dictionary: {e}") from e

    def frames() -> Iterator[bytes]:
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at, view = 8 + size, memoryview(data)
        while at < len(view):
            if bytes(view[at : at + 4]) != ZSTD_MAGIC:
                raise BadArchive(f"no frame at byte {at}")
            one, out, pos = reader.decompressobj(), [], at
            try:
                while not one.eof:
                    if pos >= len(view):
                        raise BadArchive(f"the frame at byte {at} is cut off")
                    step = view[pos : pos + (64 << 10)]
                    out.append(one.decompress(step))
                    pos += len(step)
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at byte {at}: {e}") from e
            at = pos - len(one.unused_data)
            yield b"".join(out)

    return raw, frames()


def parse_record(data: bytes) -> dict:
    """The fields of one record. Raises BadArchive if a header, a length or the digest doesn't fit."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"header line without a colon: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    if lacking := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise BadArchive(f"headers lacking: {sorted(lacking)}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length doesn't fit the record")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
    if not gap or not told:
        raise BadArchive("no HTTP header with a length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != int(told[1]) or hashlib.sha256(payload).hexdigest() != digest):
        raise BadArchive("the payload doesn't fit its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise BadArchive("a revisit needs a target and no payload")

    def page(k: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+|null)>", fields.get(k, "<urn:page:null>"))
        if not found:
            raise BadArchive(f"{k} names no page: {fields[k][:80]!r}")
        return None if found[1] == "null" else int(found[1])

    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": int(told[1]), "payload_digest": digest, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def _first_copies(pages: DataFrame) -> DataFrame:
    """page_id and _digest of every row whose payload an earlier page holds, with that page's id. Null ids take no part."""
    light = pages.where(F.col("page_id").isNotNull() & (F.col("_bytes") >= MIN_REVISIT_BYTES)).select("page_id", "_digest")
    first = light.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return light.join(first, "_digest").where("page_id <> _first").select("page_id", "_digest", F.col("_first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per row, in archives of about ARCHIVE_BYTES: archive long, content binary (a whole .warc.zst file).

    Of payloads equal and at least MIN_REVISIT_BYTES long the least id is the response and the others revisit it, so a
    payload is stored once however many pages hold it. A page is held whole by one task. Null html: an empty payload. Null url: an empty target. Null id:
    a response named <urn:page:null>, read back as null. Repeated ids with equal payloads: each a response; with other
    payloads each row is judged by its own. Other columns are ignored.
    """
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), html.alias("_html")).withColumns({"_digest": F.sha2("_html", 256), "_bytes": F.octet_length("_html").cast("long")})
    total = rows.agg(F.sum("_bytes")).first()[0]
    archives = parts_for(total, ARCHIVE_BYTES, 12)
    archive = F.pmod(F.xxhash64("page_id", "_digest"), F.lit(archives)).alias("archive")
    as_text = F.col("page_id").cast("string").alias("page_id")  # pandas makes long ids with nulls floats

    def pack(key: tuple, pdf: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        order = [(p is None, int(p or 0)) for p in (x if isinstance(x, str) else None for x in pdf["page_id"])]
        pdf = pdf.iloc[sorted(range(len(order)), key=order.__getitem__)]
        ids = [p if isinstance(p, str) else None for p in pdf["page_id"]]
        first = {(p, d): to for p, d, to in zip(copies["page_id"], copies["_digest"], copies["refers_to"], strict=True)}
        records = [record_bytes(p, u, None if (p, d) in first else h, d, n, first.get((p, d))) for p, u, h, d, n in zip(ids, pdf["_url"], pdf["_html"], pdf["_digest"], pdf["_bytes"].tolist(), strict=True)]
        return pd.DataFrame({"archive": [key[0]], "content": [archive_bytes(records)]})

    copies = materialise(_first_copies(rows).select(as_text, "_digest", F.col("refers_to").cast("string").alias("refers_to"), archive))
    # As many tasks as archives, so what a task reads doesn't grow with the input.
    dealt = rows.select(as_text, "_url", "_html", "_digest", "_bytes", archive).repartition(archives, "archive")
    return dealt.groupBy("archive").cogroup(copies.repartition(archives, "archive").groupBy("archive")).applyInPandas(pack, "archive long, content binary")


def export_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Each archive as a file of its own, <uri>/<archive>.warc.zst, on any file system that pyarrow opens by URI; returns
    archive and path. A file is written under another name and then moved, so a repeated task leaves whole files only."""

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(uri)
        where.create_dir(root, recursive=True)
        for pdf in it:
            names = [f"{archive:08d}.warc.zst" for archive in pdf["archive"]]
            for name, content in zip(names, pdf["content"], strict=True):
                part = f"{root}/_{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(content)
                where.move(part, f"{root}/{name}")
            yield pd.DataFrame({"archive": pdf["archive"], "path": [f"{uri.rstrip('/')}/{name}" for name in names]})

    return archives.select("archive", "content").mapInPandas(write, "archive long, path string")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Records of whole .warc.zst files, as `spark.read.format("binaryFile")` gives them or write_archives() returns.

    Every frame is one record; its headers, lengths and the digest of a response's payload are checked, and a bad
    archive fails the read. An archive with no record, or null content: no rows.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                part, held = [], 0
                for frame in split_frames(bytes(content))[1] if content is not None else ():
                    part.append(parse_record(frame))
                    held += len(frame)
                    if held > ARCHIVE_BYTES:
                        yield _frame(part)
                        part, held = [], 0
                if part:
                    yield _frame(part)

    return files.select(F.col(content_col).alias("content")).mapInPandas(decode, RECORD)


def _frame(records: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(records).assign(**{k: pd.array([r[k] for r in records], "Int64") for k in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, then read every record back."""
    return read_archives(materialise(write_archives(pages)))
