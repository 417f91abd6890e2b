"""Web archives in ZIP packages: written from pages, read back by ranges without extraction.

A package is an uncompressed ZIP file (members are stored; ZIP64 where sizes need it) with
``archive/data.warc.gz`` (WARC/1.1 records, one gzip member each) and ``indexes/index.cdx``
(JSON lines: offset and length of each record within the archive member).

Writing: payload digests are aggregated first (digest -> smallest page_id); the pages whose
payload occurs again join that, and each task streams its pages into one package in the shared
folder. The response that others refer to has a record id made from its digest, every other
record one made from its package and offset, so ids are unique whatever the page_ids are.
Reading: a package's end-of-central-directory record (also ZIP64's), central directory and
local headers give the place of each stored member; index entries are grouped into ranges that
tasks read with seeks. Nothing is unpacked to disk and no package is read as a whole.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.storage import cut, scratch, table

MIN_REVISIT_BYTES = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records that are read at once.
RANGE_BYTES = 4 << 20
#: Most tasks that the ranges of a read are dealt over.
MAX_TASKS = 20_000


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def members(f) -> list[Member]:
    """Central directory of a ZIP file, also ZIP64, from a seekable binary file."""
    f.seek(0, 2)
    size = f.tell()
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    # the comment may hold the signature too: the record must end with its comment
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail_at + at - 20
    if locator >= 0 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        f.seek(locator)
        found = f.read(20)
        if found[:4] == b"PK\x06\x07":
            f.seek(struct.unpack_from("<Q", found, 8)[0])
            end64 = f.read(56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
    f.seek(start)
    data, out, at = f.read(length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, unpacked, n, x, c = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + n : at + 46 + n + x], 0
        while e + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                values = list(struct.unpack_from(f"<{k // 8}Q", extra, e + 4))
                if unpacked == 0xFFFFFFFF:
                    unpacked = values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if header == 0xFFFFFFFF:
                    header = values.pop(0)
            e += 4 + k
        out.append(Member(name, method, packed, header))
        at += 46 + n + x + c
    return out


def member_start(f, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; ranges need stored members")
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, x = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + x


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to, name: str) -> bytes:
    """A WARC response record, or a revisit record without its payload; ``name`` makes the record's id."""
    kind = "revisit" if revisit else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(name)}",
        f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn('payload:' + digest)}",
            f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a WARC record that the reader returns."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, refers = field["warc-type"], field.get("x-refers-to-page")
    size, digest = int(field["x-payload-bytes"]), field["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    return {
        "page_id": int(field["x-page-id"]) if field["x-page-id"] else None,
        "url": field["warc-target-uri"] or None,
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to": int(refers) if refers else None,
        "record_id": field["warc-record-id"],
        "refers_to_record": field.get("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


class _Counted(io.RawIOBase):
    """Counts what goes to an output stream that can't seek."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self):
        return True

    def write(self, data):
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def tell(self):
        return self.at

    def flush(self):
        pass


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        where, root = pafs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        # a retried task writes a package of its own; only the one it reports is read
        name = f"pages-{uuid.uuid4().hex}.wacz"
        index, at = [], 0
        with where.open_output_stream(f"{root}/{name}") as sink, zipfile.ZipFile(_Counted(sink), "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            with package.open(zipfile.ZipInfo(ARCHIVE, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as out:

                def put(batch):
                    nonlocal at
                    for page, url, html, digest, refers, again, lead in zip(*(c.to_pylist() for c in batch.columns)):
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        own = f"payload:{digest}" if lead else f"record:{name}:{at}"
                        raw = packer.compress(record(page, url, html.encode(), digest, again, refers, own)) + packer.flush()
                        out.write(raw)
                        index.append(json.dumps({"offset": at, "length": len(raw)}))
                        at += len(raw)

                put(first)
                for batch in batches:
                    put(batch)
            package.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "\n".join(index))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], ["package", "records"])

    return run


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``page_id, url, html`` as packages into ``folder``; (package, records) of those that count.

    Of the records with equal payloads of at least MIN_REVISIT_BYTES the one with the smallest
    page_id (null last, then the first url) is the response, all others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # short and null payloads share digests, but are all responses: they join nothing
    big = F.octet_length("html") >= MIN_REVISIT_BYTES
    large, plain = rows.where(big), rows.where(~big)
    per_id = large.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = per_id.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "n")).alias("f"), F.sum("n").alias("all"))
    first = cut(first.where("all > 1").select("digest", F.lit(True).alias("again"), F.col("f.page_id").alias("first"), F.col("f.n").alias("same")), "first-pages")
    marked = large.join(first, "digest", "left").withColumn("lead", F.col("again") & F.col("page_id").eqNullSafe(F.col("first")))
    if not first.where("same > 1").isEmpty():
        # rows that repeat the smallest id: one of them, the first by url, is the response
        order = Window.partitionBy("digest", "lead").orderBy("url")
        several = marked.where("lead and same > 1").withColumn("lead", F.row_number().over(order) == 1)
        marked = marked.where("not coalesce(lead and same > 1, false)").union(several)
    lead = F.coalesce("lead", F.lit(False))
    refers = F.when(F.col("again") & ~lead, F.struct(F.col("first").alias("page")))
    columns = ["page_id", "url", "html", "digest"]
    packed = marked.select(*columns, refers["page"].alias("refers_to"), refers.isNotNull().alias("revisit"), lead.alias("lead"))
    packed = packed.union(plain.select(*columns, F.lit(None).cast("long"), F.lit(False), F.lit(False)))
    return cut(packed.mapInArrow(_write(folder), "package string, records long"), "packages")


def _ranges(batches):
    """(package, start, lengths) of ranges of about RANGE_BYTES, from each package's index."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, name = pafs.FileSystem.from_uri(path)
            with where.open_input_file(name) as f:
                named = {m.name: m for m in members(f)}
                base = member_start(f, named[ARCHIVE])
                f.seek(member_start(f, named[INDEX]))
                lines = f.read(named[INDEX].size).decode().splitlines()
            start, lengths = 0, []
            out = []
            for e in map(json.loads, lines):
                if lengths and e["offset"] + e["length"] - start > RANGE_BYTES:
                    out.append((base + start, lengths))
                    lengths = []
                if not lengths:
                    start = e["offset"]
                lengths.append(e["length"])
            if lengths:
                out.append((base + start, lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(out), pa.string()), pa.array([s for s, _ in out], pa.int64()), pa.array([n for _, n in out], pa.list_(pa.int64()))],
                ["package", "start", "lengths"],
            )


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary())])


def _read(batches):
    for batch in batches:
        for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            where, name = pafs.FileSystem.from_uri(path)
            with where.open_input_file(name) as f:
                f.seek(start)
                data = f.read(sum(lengths))
            at, rows = 0, []
            for n in lengths:
                rows.append(parse(zlib.decompress(data[at : at + n], 31)))
                at += n
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages named in ``package``, read by ranges over tasks."""
    ranges = cut(packages.select("package").mapInArrow(_ranges, "package string, start long, lengths array<long>"), "ranges")
    # the ranges take a few KB, so Spark would merge them into one task: they are dealt by their number
    dealt = ranges.repartition(min(max(1, ranges.count()), MAX_TASKS), F.col("package"), F.col("start"))
    return dealt.mapInArrow(_read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, refers_to_record string, payload binary")


def op8_warc_zip(spark, sf_dir: str) -> DataFrame:
    """Archives every page and reads the records back.

    Null html is an empty payload; a null url is written as an empty target and read as null. A
    null page_id comes after all others and is read back as null. Rows that repeat a page_id get
    a record each, of which one at most is the response of its payload (if that has 100 bytes).
    Other columns are not read. An empty table gives an empty one.
    """
    packages = write_packages(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc_zip": op8_warc_zip}
SQL = {
    "op8_warc_zip": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, octet_length(encode(h)) >= 100 AND row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) > 1 AS again,
  min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
""",
}
