"""WARC records in ZIP packages: writing pages, and reading records by range.

A package is a ZIP archive with two stored members: ``archive/data.warc.gz``, where each record is a
gzip member of its own, and ``indexes/index.cdx``, one line per record (offset, length and record id in
the first). Records of equal payloads are written once as ``response``; the others are ``revisit``
records that name it. The reader parses the central (or ZIP64) directory, finds the index, hands the
records' places out to tasks, and reads each record by its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import materialize, shared_dir, shuffle_partitions, utf8
from pellucid.llm.files import create, open_fs, open_input
from pellucid.llm.zip_reader import ZipReader

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed when its archive has so many bytes.
PACKAGE_BYTES = 1 << 30
#: Salts of the payload digest in the exchange, so that pages of one payload reach several tasks.
SALTS = 16

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    # a URL takes one line of the header, whatever stands in it
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields, in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


class PackageWriter:
    """Streams records into the stored archive member; the index follows when the package is closed."""

    def __init__(self, folder: str, name: str):
        self.name, self.sink = name, create(folder, name)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.member.write(data)
        self.lines.append(f"{self.size} {len(data)} {_name(page_id)}\n")
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.sink.close()


def _write(folder: str, limit: int):
    def run(batches):
        writer, names = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")]
            for page_id, url, refers_to, body in zip(*columns, batch.column("body"), strict=True):
                if writer is None:
                    # an attempt that is lost or repeated leaves another name, which no list has
                    names.append(f"pages-{TaskContext.get().taskAttemptId()}-{len(names)}.wacz")
                    writer = PackageWriter(folder, names[-1])
                payload = body.as_buffer().to_pybytes()
                writer.add(page_id, warc_record(page_id, url, payload, payload_digest(payload), refers_to))
                if writer.size >= limit:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])

    return run


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every page; returns the packages' names.

    Of pages whose payloads are equal and have at least ``min_bytes`` bytes, the one with the smallest
    page_id is the response and the others revisit it. Pages that have that smallest id too, and pages
    with a null id in a group without any other id, are responses. A null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("body")))
    counted = rows.where(F.length("body") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.min("page_id").alias("first"))
    repeated = counted.where("k > 1 AND first IS NOT NULL").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(repeated, ["digest", "salt"], "left")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    joined = joined.select("page_id", "url", "body", refers_to.alias("refers_to"))
    return materialize(joined.mapInArrow(_write(folder, package_bytes), "name string"))


def _places(folder: str):
    """The places of all records of a package, from its index."""

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                system, path = open_fs(f"{folder}/{name}")
                with system.open_input_file(path) as source:
                    reader = ZipReader(source, source.size())
                    first = reader.data_offset(ARCHIVE)
                    lines = reader.read(INDEX).decode().splitlines()
                at = [line.split(" ", 2)[:2] for line in lines]
                for k in range(0, len(at), 1 << 14):
                    part = at[k : k + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([first + int(a) for a, _ in part], pa.int64()), pa.array([int(b) for _, b in part], pa.int64())], names=["name", "offset", "length"])

    return run


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(folder: str, with_payload: bool):
    names = [f.split()[0] for f in _RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        opened, source = None, None
        for batch in batches:
            out = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    opened, source = name, open_input(f"{folder}/{name}")
                source.seek(offset)
                fields, block = parse_record(zlib.decompress(source.read(length), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, refers_to = fields["warc-type"], fields.get("warc-refers-to")
                if kind == "response":
                    size, digest = len(payload), payload_digest(payload)
                else:  # a revisit tells both of the payload that it stands for
                    size = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
                    digest, payload = fields["warc-payload-digest"].removeprefix("sha1:"), None
                out.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, None if refers_to is None else _page(refers_to), size, digest, payload if with_payload else None))
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def read_packages(packages: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the named packages: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Revisits have no payload of their own. The records of a large package are dealt to many tasks.
    """
    n = shuffle_partitions(packages.sparkSession)
    places = packages.select("name").repartition(n, "name").mapInArrow(_places(folder), "name string, offset long, length long")
    stretch = F.expr("offset div 4194304")
    dealt = places.repartition(n, "name", stretch).sortWithinPartitions("name", "offset")
    return dealt.mapInArrow(_read(folder, with_payload), _RECORD)


def warc_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page (page_id, url, html) to packages in the shared folder and read them all back.

    One row per page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    Repeated rows give one record each; other columns are ignored; an empty table writes nothing and
    gives an empty result.
    """
    folder = f"{shared_dir(pages.sparkSession)}-packages"
    records = read_packages(write_packages(pages, folder, min_bytes), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
