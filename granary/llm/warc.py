"""WARC archives, compressed record by record with a Zstandard dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the file's
dictionary, itself a Zstandard frame; then each record is a frame of its own that
needs only this dictionary, so a record can be read from its offset. The
dictionary is trained on the file's own first records (at most SAMPLE_BYTES),
which nothing but the size of the file depends on.

A task writes under a name of its own and renames at the end, so a lost executor
or a second attempt leaves no half file under a final name. Files are written
through pyarrow's file systems at the uri given, a folder that all machines share.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import small
from .common import column, fresh, shared_path, table, written

MAGIC = b"\x5d\x2a\x4d\x18"
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES, READ_BYTES = 4 << 20, 110 << 10, 1 << 30, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _fs(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """Type, headers and block of one record; raises ValueError on anything else."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers.get("Content-Length", -1))
    if first != "WARC/1.1" or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers["WARC-Type"], headers, rest[:n]


def dictionary(samples: list[bytes]):  # noqa: ANN201
    """A trained dictionary; of too few or too short samples, their end as raw content."""
    import zstandard as zstd

    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 1024:
        try:
            return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples)
        except zstd.ZstdError:
            pass  # samples that have nothing in common
    return zstd.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Writer:
    """Files ``<name>-<attempt>-<k>.warc.zst`` in a folder; ``done()`` gives their manifest.

    Each attempt of a task has names of its own, so a speculative or repeated one
    never touches a file that another one's manifest names. A file counts only if
    the manifest that was written has it.
    """

    def __init__(self, uri: str, name: str, level: int = 3, date: str = "1970-01-01T00:00:00Z"):
        self.fs, self.folder = _fs(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.name, self.level, self.date = uri.rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}", level, date
        self.waiting: list[bytes] = []
        self.sample, self.out, self.files = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            self.sample += len(data)
            if self.sample >= SAMPLE_BYTES:
                self._open()
        else:
            self._put(data)
            if self.size >= FILE_BYTES:
                self._close()

    def _open(self) -> None:
        import zstandard as zstd

        own = dictionary(self.waiting)
        self.pack = zstd.ZstdCompressor(level=self.level, dict_data=own, write_checksum=True)
        packed = zstd.ZstdCompressor(level=19).compress(own.as_bytes())
        self.temp = f"{self.folder}/.{self.name}-{len(self.files)}.tmp"
        self.out, self.size, self.n = self.fs.open_output_stream(self.temp, compression=None), 0, 0
        self._raw(MAGIC + struct.pack("<I", len(packed)) + packed)
        info = f"software: granary\r\nformat: WARC File Format 1.1\r\npart: {self.name}\r\n".encode()
        self._raw(self.pack.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:granary:file:{self.name}-{len(self.files)}>", "WARC-Date": self.date, "Content-Type": "application/warc-fields"}, info)))
        waiting, self.waiting, self.sample = self.waiting, [], 0
        for x in waiting:
            self._put(x)

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _put(self, data: bytes) -> None:
        self._raw(self.pack.compress(data))
        self.n += 1

    def _close(self) -> None:
        self.out.close()
        final = f"{self.name}-{len(self.files):04d}.warc.zst"
        self.fs.move(self.temp, f"{self.folder}/{final}")
        self.files.append((f"{self.uri}/{final}", self.n, self.size))
        self.out = None

    def done(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._open()
        if self.out is not None:
            self._close()
        return self.files


def read_file(uri: str) -> Iterator[bytes]:
    """The records of one file, one at a time, each from its own frame."""
    import zstandard as zstd

    fs, path = _fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        head = f.read(8)
        if head[:4] != MAGIC:
            raise ValueError(f"{uri} doesn't begin with a dictionary frame")
        data = f.read(struct.unpack("<I", head[4:])[0])
        if data[:4] == ZSTD_MAGIC:
            data = zstd.ZstdDecompressor().decompress(data)
        unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data))
        left = f.read(READ_BYTES)
        while left:
            frame, parts = unpack.decompressobj(), []
            while not frame.eof:
                if not left and not (left := f.read(READ_BYTES)):
                    raise ValueError(f"{uri} ends within a record")
                parts.append(frame.decompress(left))
                left = frame.unused_data if frame.eof else b""
            yield b"".join(parts)
            left = left or f.read(READ_BYTES)


def page_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit record without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:granary:page:{i}>"
    headers = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": name(first) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record("revisit" if revisit else "response", headers, http + (b"" if revisit else payload))


def write_archives(pages: DataFrame, uri: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row under ``uri``; the manifest (path, n_records, n_bytes), already computed.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads
    of at least ``min_revisit_bytes``, those with the smallest id are responses
    (all repeated rows with that id), the others revisit it; a group without any
    id is all responses, as is a single row without one. Rows without a url get
    no target uri. Very long payloads pass through one task's memory one at a
    time. An empty table gives an empty manifest. Extra columns don't matter.

    Only digests that repeat are joined, by broadcast where they are few; else
    payloads are dealt by digest, and one with very many copies is split by the
    adaptive skew join.
    """
    own = pages.select(column(pages, page_id).cast("long").alias("i"), column(pages, url).alias("u"), F.encode(F.coalesce(column(pages, html), F.lit("")), "UTF-8").alias("p"))
    own = own.withColumn("d", F.sha2("p", 256))
    firsts = own.where(F.octet_length("p") >= min_revisit_bytes).groupBy("d").agg(F.min("i").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    marked = own.join(small(written(firsts, "firsts")), "d", "left").withColumn("revisit", F.expr("first is not null and not (i <=> first)"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for b in batches:
            for i, u, p, d, first, revisit in zip(b["i"], b["u"], b["p"], b["d"], b["first"], b["revisit"], strict=True):
                out = out or Writer(uri, f"part-{TaskContext.get().partitionId():05d}", date=date)
                out.add(page_record(None if pd.isna(i) else int(i), u, bytes(p), d, None if pd.isna(first) else int(first), revisit, date))
        yield pd.DataFrame(out.done() if out else [], columns=["path", "n_records", "n_bytes"])

    columns = marked.select("i", "u", "p", "d", "first", "revisit")
    return written(columns.mapInPandas(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of all files of a manifest, warcinfo aside.

    A response's digest and size are taken from the payload read, and a digest
    that differs from its header raises ValueError; a revisit's come from its
    headers. ``payloads=False`` leaves the payload null.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [x.split()[0] for x in RECORDS.split(", ")]
        rows, held = [], 0
        for path in (p for b in batches for p in b["path"]):
            for data in read_file(path):
                kind, headers, block = parse(data)
                if kind == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{path}: {headers['WARC-Record-ID']} isn't what was written")
                rows.append((headers["WARC-Record-ID"], kind, headers.get("WARC-Target-URI"), digest, size, headers.get("WARC-Refers-To"), payload if payloads and kind == "response" else None))
                held += len(payload) if payloads else 100
                if held >= 4 << 20:
                    yield pd.DataFrame(rows, columns=fields)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=fields)

    files = manifest.repartitionByRange(max(1, manifest.count()), "path")  # a task each: a number asked for isn't coalesced
    return files.mapInPandas(read, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:granary:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    return read_archives(manifest, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM r
"""
