"""Web archives: pages to ARC files, and a converter from ARC to WARC that reads back what it wrote.

An ARC file starts with a version block, which says what fields its header lines have (five in version 1, ten in
version 2).  A record is a header line, whose last field declares a length, then so many bytes (here an HTTP
response), then a line feed.  The converter takes records by their declared lengths and writes for each the
equivalent WARC record: identifier, 14-digit date as a timestamp, type, and digests of payload and block.  Of equal
payloads the smallest page id is a response, the others are revisits of it, with HTTP headers alone.

Files are written and read by Spark, so any file system will do: a record is text to Spark's writer, its bytes
unchanged.  An archive holds about ``ARCHIVE`` bytes or one larger record, whatever the partitions.  Only identifiers,
digests and compressed archives are shuffled, payloads are not.

Defined results: null html is an empty payload; a null url is "-" in ARC and no target URI in WARC; bytes that a
header line cannot hold are percent-encoded in urls; null page ids are larger than all others; of rows equal in
page id and payload the first in its archive is the response; smaller payloads than ``least`` are all responses;
an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.llm.heavy import COUNTERS, heavy_keys
from hushframe.session import fresh_path, written

# The formats' own field lists and names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = 16_000_000  # bytes of the records of one archive, unpacked
UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff]")


class ArchiveError(ValueError):
    """A file that does not hold what its format declares."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gunzipped(content: bytes) -> bytes:
    """All members of a gzip file; other files as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


# -- ARC ------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    lines = f"{version} 0 origin\n{ARC_FIELDS[version]}\n".encode()
    extra = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(lines)}\n".encode() + lines


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes, name: str, date: str) -> bytes:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload
    safe = UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "-").encode()).decode() or "-"
    extra = f"200 {base32_sha1(payload)} - 0 {name} " if version == 2 else ""
    return f"{safe} 0.0.0.0 {date} text/html {extra}{len(body)}\n".encode() + body


@dataclass
class ArcRecord:
    offset: int
    url: str | None
    ip: str
    date: str
    page_id: int | None
    http: bytes
    payload: bytes


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, of either version, taken by their declared lengths."""
    at, fields = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at:end if end >= 0 else len(content)].decode("utf-8", "replace").split(" ")
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ArchiveError("no version block")
            version = content[end + 1:content.find(b"\n", end + 1)].split(b" ")[0]
            if version not in (b"1", b"2"):
                raise ArchiveError(f"unknown version {version!r}")
            fields = ARC_FIELDS[int(version)].split(" ")
        if len(line) != len(fields) or not line[-1].isdigit() or end + 1 + int(line[-1]) > len(content):
            raise ArchiveError(f"bad header line at byte {at}")
        values, start = dict(zip(fields, line)), end + 1
        body = content[start:start + int(line[-1])]
        if not line[0].startswith("filedesc://"):
            head, gap, payload = body.partition(b"\r\n\r\n")
            if not head.startswith(b"HTTP/") or not gap:
                head, payload = b"", body
            page = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
            url = None if line[0] == "-" else line[0]
            yield ArcRecord(at, url, values["IP-address"], values["Archive-date"], int(page[1]) if page else None, head + gap if head else b"", payload)
        at = start + int(line[-1])
        at += content[at:at + 1] == b"\n"


# -- WARC -----------------------------------------------------------------------------------------------------


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_date(date: str) -> str:
    digits = (re.sub(r"\D", "", date) + "19700101000000"[min(14, len(re.sub(r"\D", "", date))):])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(kind: str, identifier: str, date: str, block: bytes, **more: str | None) -> bytes:
    """A record without the last of its two closing line ends, which the writer adds."""
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": date, **{k.replace("_", "-"): v for k, v in more.items() if v is not None},
            "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n"


def converted(path: str, record: ArcRecord, first: dict | None) -> bytes:
    """An ARC record as a response, or as a revisit of ``first``."""
    common = {"WARC_Target_URI": record.url, "WARC_IP_Address": record.ip, "Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": f"sha1:{base32_sha1(record.payload)}",
              "X_Page_Id": None if record.page_id is None else str(record.page_id), "X_Payload_Length": str(len(record.payload))}
    identifier, date = record_id(path, record.offset), warc_date(record.date)
    if first is None:
        return warc_record("response", identifier, date, record.http + record.payload, **common)
    return warc_record("revisit", identifier, date, record.http, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=record_id(first["path"], first["offset"]),
                       X_Refers_To_Page=None if first["page_id"] is None else str(first["page_id"]), **common)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one file, taken by their declared lengths."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ArchiveError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, length = end + 4, int(head["content-length"])
        if content[start + length:start + length + 4] != b"\r\n\r\n":
            raise ArchiveError(f"declared length of the record at byte {at} is wrong")
        yield head, content[start:start + length]
        at = start + length + 4


# -- on Spark -------------------------------------------------------------------------------------------------


def _archives(records: Iterable[bytes], head: Callable[[], bytes], separator: bytes) -> Iterator[pa.RecordBatch]:
    """Whole archives of about ``ARCHIVE`` bytes, one a row; an archive without records if there are none."""
    held, size = [head()], 0
    for r in records:
        if size and size + len(r) > ARCHIVE:
            yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary()).view(pa.string())], ["value"])
            held, size = [head()], 0
        held.append(r)
        size += len(r)
    yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary()).view(pa.string())], ["value"])


def _store(rows: DataFrame, path: str, separator: str) -> None:
    rows.write.option("compression", "gzip").option("lineSep", separator).option("maxRecordsPerFile", 1).text(path)  # a file is one archive


def write_arc(pages: DataFrame, path: str, version: int = 2, date: str = "20250101000000", id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as gzipped ARC files of bounded size under ``path``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-v{version}.arc"
        records = (arc_record(version, u.as_py(), i.as_py(), h.as_py() or b"", name, date) for b in batches for i, u, h in zip(*b.columns))
        yield from _archives(records, lambda: arc_version_block(version, name, date), b"\n")

    rows = pages.select(F.col(f"`{id}`").cast("bigint"), F.col(f"`{url}`"), F.col(f"`{html}`").cast("binary"))
    _store(rows.mapInArrow(run, "value string"), path, "\n")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(files: DataFrame) -> DataFrame:
    """What the records of ARC files are, without their payloads: path, offset, page_id, url, digest, size."""
    names = ["path", "offset", "page_id", "url", "digest", "size"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*[b.column(c) for c in ("path", "content")]):
                rows = [(path.as_py(), r.offset, r.page_id, r.url, base32_sha1(r.payload), len(r.payload)) for r in arc_records(gunzipped(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, "path string, offset bigint, page_id bigint, url string, digest string, size bigint")


def first_records(records: DataFrame, least: int = 0, counters: int = COUNTERS) -> DataFrame:
    """Adds ``first``, the record that a revisit refers to, null for responses.

    Digests with a large share of the records are settled by a broadcast of at most ``counters`` winners.
    """
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "path", "offset")
    heavy = heavy_keys(records, "digest", counters).select("digest")
    hot = written(records.join(F.broadcast(heavy), "digest").groupBy("digest").agg(F.min(order).alias("first")), "archive-winners")
    direct = records.join(F.broadcast(hot), "digest", "left").filter(F.col("first").isNotNull())
    rest = records.join(F.broadcast(hot), "digest", "left_anti")
    rest = rest.join(rest.groupBy("digest").agg(F.min(order).alias("first")), "digest")
    same = (F.col("first.path") == F.col("path")) & (F.col("first.offset") == F.col("offset"))
    return direct.unionByName(rest).withColumn("first", F.when(~same & (F.col("size") >= least), F.col("first")))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Converts the ARC files under one path to gzipped WARC files under another, revisits made out across all."""
    files = archive_files(spark, arc_path)
    records = written(read_arc(files), "arc-records")
    firsts = first_records(records, least).filter(F.col("first").isNotNull())
    by_file = firsts.groupBy("path").agg(F.collect_list(F.struct("offset", "first")).alias("revisits"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: ARC to WARC converter\r\nformat: WARC File Format 1.1\r\n"

        def records() -> Iterator[bytes]:
            for b in batches:
                for path, content, revisits in zip(*[b.column(c) for c in ("path", "content", "revisits")]):
                    first = {x["offset"]: x["first"] for x in revisits.as_py() or ()}
                    for r in arc_records(gunzipped(content.as_py())):
                        yield converted(path.as_py(), r, first.get(r.offset))

        def head() -> bytes:
            return warc_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", warc_date(""), info, Content_Type="application/warc-fields")

        yield from _archives(records(), head, b"\r\n")

    _store(files.join(by_file, "path", "left").mapInArrow(run, "value string"), warc_path, "\r\n")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Response and revisit records of WARC files: page_id, url, date, record_type, payload_bytes, payload_digest, record_id, refers_to and, if asked for, payload."""
    names = ["page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "record_id", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 2, pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: None if text is None else int(text)
        for b in batches:
            for content in b.column("content"):
                rows = []
                for head, block in warc_records(gunzipped(content.as_py())):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ArchiveError("a payload differs from its digest")
                    row = (number(head.get("x-page-id")), head.get("warc-target-uri"), head["warc-date"], kind, size, digest, head["warc-record-id"], number(head.get("x-refers-to-page")))
                    rows.append((*row, payload) if payloads else row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, url string, date string, record_type string, payload_bytes bigint, payload_digest string, record_id string, refers_to bigint" + ", payload binary" * payloads
    return archive_files(spark, path).mapInArrow(run, schema)


SQL = """
with p as (select page_id, url, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html) as payload_bytes, sha1(html) as digest, min(page_id) over (partition by html) as first, url from p)
select page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
       ((('0x' || substr(digest, (i // 4)::int * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1) for i in range(0, 32)], '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, url
from h
"""


@query("op10_archives", SQL)
def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back."""
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
