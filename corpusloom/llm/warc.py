"""Web archives packed in ZIP files: written by tasks, then read back by range, without extraction.

An archive is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member per record), ``indexes/index.cdxj`` (one line
per record, with its place in that member) and ``datapackage.json``. The reader takes from the end of the file the
directories, ZIP64 ones included, finds where the stored members begin, reads the index, and then only the bytes of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .common import lookup, map_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the format: ZIP signatures and the profile of records whose payload is stored elsewhere.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records after which a task begins a new archive, and bytes of index or records read at once.
ARCHIVE_RECORDS, READ_BYTES = 100_000, 1 << 22
#: Bytes of records that one task reads, about.
STRETCH_BYTES = 1 << 23
_DATE = "2000-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI that executors share (file, hdfs, s3, gs, abfs) or of an absolute path."""
    return arrow_fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Member:
    """A ZIP member: its name, method (0: stored), size, and the place of its local header."""

    name: str
    method: int
    size: int
    packed: int
    header: int


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def members(file, size: int) -> list[Member]:
    """Central directory of a ZIP file, by reads of its end only. Wide sizes and places come from the ZIP64 fields."""
    tail_at = max(0, size - 65_557)
    tail = _read(file, tail_at, size - tail_at)
    found = tail.rfind(END)
    if found < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, found + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _read(file, tail_at + found - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no locator of the ZIP64 directory")
        record = _read(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no end of the ZIP64 directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory = _read(file, start, length)
    out, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken ZIP directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = _zip64(extra)
        if plain == 0xFFFFFFFF:
            plain = next(wide)
        if packed == 0xFFFFFFFF:
            packed = next(wide)
        if header == 0xFFFFFFFF:
            header = next(wide)
        out.append(Member(name, method, plain, packed, header))
        at += 46 + n_name + n_extra + n_note
    return out


def _zip64(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
        at += 4 + n


def stored_at(file, member: Member) -> int:
    """First byte of a stored member's data."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in the ZIP file")
    head = _read(file, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(root: str):
    """Task function: (record_id, url, payload, refers_to) to one row per archive written.

    Names are new for each attempt, and only archives that a finished task names are read; what a lost task left is unused.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from batch.slice(at, 500).to_pylist()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(root)
        fs.create_dir(folder, recursive=True)
        rows = rows_of(batches)
        row = next(rows, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            index, at = [], 0
            with fs.open_output_stream(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as packed:
                with packed.open(DATA, "w", force_zip64=True) as member:
                    while row is not None and len(index) < ARCHIVE_RECORDS:
                        payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
                        kind, digest = ("revisit" if row["refers_to"] else "response"), _digest(payload)
                        data = _record(kind, row["record_id"], row["url"], payload, digest, row["refers_to"])
                        member.write(data)
                        index.append((row["url"] or "", {"url": row["url"], "digest": f"sha1:{digest}", "offset": str(at), "length": str(len(data)), "filename": "data.warc.gz"}))
                        at += len(data)
                        row = next(rows, None)
                index.sort(key=lambda x: x[0])
                with packed.open(INDEX, "w", force_zip64=True) as member:
                    for url, entry in index:
                        member.write(f"{json.dumps(url)} {_DATE[:4]}0101000000 {json.dumps(entry)}\n".encode())
                packed.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([len(index)], pa.int64())], names=["archive", "records"])

    return write


def write_archives(pages: DataFrame, root: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (``page_id, url, html``) to archives below ``root``: ``archive, records``.

    Of equal payloads of at least ``min_revisit_bytes`` that with the smallest page is a response, the others are revisits
    that refer to it and hold no payload. Null html is an empty payload. Rows that repeat the smallest page with the same
    payload are all responses; a null page counts as larger than any.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.sha1(F.col("payload").cast("binary"))).withColumn("_size", F.octet_length("payload"))
    least = rows.where(F.col("_size") >= min_revisit_bytes).groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    repeated = written(least.where("n > 1"), "repeated")
    total = pages.count()
    told = lookup(rows, repeated, ["key"], "n", total, how="left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    records = told.select(name("page_id").alias("record_id"), "url", "payload", F.when(revisit, name("least")).alias("refers_to"))
    return written(map_batches(records, _writer(root), "archive string, records long"), "archives")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to the places of their records, from the index member."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as file:
                by_name = {m.name: m for m in members(file, file.size())}
                data = stored_at(file, by_name[DATA])
                at, left, rest = stored_at(file, by_name[INDEX]), by_name[INDEX].size, b""
                while left or rest:
                    lines = (rest + _read(file, at, min(left, READ_BYTES))).split(b"\n")
                    at, left = at + min(left, READ_BYTES), left - min(left, READ_BYTES)
                    rest = lines.pop() if left else b""
                    entries = [json.loads(x[x.index(b" {") + 1 :]) for x in lines if x]
                    if entries:
                        offsets = [data + int(e["offset"]) for e in entries]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([uri] * len(entries)), pa.array(offsets, pa.int64()), pa.array([int(e["length"]) for e in entries], pa.int64())],
                            names=["archive", "at", "length"],
                        )


def _parse(data: bytes, keep_payload: bool) -> dict:
    plain = gzip.decompress(data)
    head, _, block = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(":")[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("WARC-Target-URI"),
        "refers_to": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if keep_payload and kind == "response" else None,
    }


_RECORDS = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _reader(keep_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = []
                for x in batch.slice(k, 200).to_pylist():
                    if x["archive"] != uri:
                        uri = x["archive"]
                        fs, path = open_fs(uri)
                        file = fs.open_input_file(path)
                    rows.append(_parse(_read(file, x["at"], x["length"]), keep_payload))
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return read


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of the archives named in ``archive``, range-read by the places in their indexes and checked by digest.

    Columns: ``record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest`` (base32 SHA-1; both of the full
    payload, also for a revisit), ``payload`` (null for a revisit, or without ``keep_payload``). Stretches of an archive are
    read by different tasks, so one large archive is no single task; the bytes of all records say how many. A damaged record
    raises.
    """
    places = written(map_batches(archives.select("archive"), _places, "archive string, at long, length long"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = int(total // STRETCH_BYTES) + 1
    stretch = F.floor(F.col("at") / STRETCH_BYTES)
    dealt = places.withColumn("stretch", stretch).repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "at").select("archive", "at", "length")
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return map_batches(dealt, _reader(keep_payload), schema)


def archive_round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives (below ``root``, or a new folder of the shared one) and reads them back, payloads left out."""
    return read_archives(write_archives(pages, root or scratch_path(pages.sparkSession, "wacz")), keep_payload=False)
