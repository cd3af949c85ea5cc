"""Legacy archives to WARC: parse ARC records, synthesise WARC records, write and read files.

An ARC file starts with a version block whose second line names the version; version 1 record
headers have five fields, version 2 ten, the last of both being the declared length of the
content that follows. ``parse_arc`` walks by these lengths. ``convert`` turns each record into a
WARC record: an identifier derived from the record itself, an ISO timestamp from the 14 digits,
a type (``response``, or ``revisit`` of the record with the smallest key and an equal payload)
and SHA-1 digests of block and payload. Files hold one gzip member per record.

Defined results: null content or html is an empty payload; keys may be null (such records are
never chosen as the original while another has a key, and come last); repeated keys keep their
rows; an empty table gives no records; malformed header lines and lengths that run over the end
raise, naming the file and offset; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.common import bare, new_folder, read_blobs, slices, staged, write_blobs

# The field names of the two ARC versions.
FIELDS = {
    "1": ["url", "ip", "date", "mime", "length"],
    "2": ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename",
          "length"],
}
KEY_HEADER = b"x-record-key"
#: Bytes of compressed records after which a file is closed.
FILE_BYTES = 8 << 20


@dataclass
class ArcRecord:
    url: str
    date: str
    version: str
    content: bytes
    fields: dict[str, str] = field(default_factory=dict)

    def split(self) -> tuple[bytes, bytes]:
        """HTTP head with its blank line, and payload; all is payload if no head is there."""
        if self.content.startswith(b"HTTP/"):
            head, mark, body = self.content.partition(b"\r\n\r\n")
            if mark:
                return head + mark, body
        return b"", self.content

    def key(self) -> int | None:
        for line in self.split()[0].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == KEY_HEADER:
                return int(value)
        return None


def write_arc(name: str, version: str, records: list[ArcRecord]) -> bytes:
    """An ARC file image (uncompressed) with its version block."""
    info = f"{version} 0 archive\n{'URL IP-address Archive-date Content-type Archive-length' if version == '1' else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n".encode()
    out = [_arc_header(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", version,
                       info, name), info, b"\n"]
    for r in records:
        out += [_arc_header(r.url, "0.0.0.0", r.date, "text/html", version, r.content, name),
                r.content, b"\n"]
    return b"".join(out)


def _arc_header(url, ip, date, mime, version, content, name) -> bytes:
    middle = ["200", "-", "-", "0", name] if version == "2" else []
    return (" ".join([url.replace(" ", "%20") or "-", ip, date, mime, *middle,
                      str(len(content))]) + "\n").encode()


def parse_arc(data: bytes, name: str = "") -> Iterator[tuple[int, ArcRecord]]:
    """(offset, record) of every record of an ARC file; gzip members are unpacked first."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(gzip_members(data))
    at, version = 0, None
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r", b"\0"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at:stop if stop >= 0 else len(data)].decode("utf-8", "replace").strip("\r")
        values = line.split(" ")
        names = FIELDS.get(version or "", None) or FIELDS["2" if len(values) == 10 else "1"]
        if stop < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{name}: no ARC header line at {at}: {line[:80]!r}")
        size, begin = int(values[-1]), stop + 1
        if begin + size > len(data):
            raise ValueError(f"{name}: record at {at} declares {size} bytes beyond the end")
        content = data[begin:begin + size]
        if version is None:
            if not line.startswith("filedesc:"):
                raise ValueError(f"{name}: the first record is not a version block")
            version = content.split(b" ", 1)[0].decode()
            if version not in FIELDS:
                raise ValueError(f"{name}: unknown ARC version {version!r}")
        else:
            f = dict(zip(names, values))
            yield at, ArcRecord(f["url"], f["date"], version, content, f)
        at = begin + size


def gzip_members(data: bytes) -> Iterator[bytes]:
    """Content of each gzip member; zero bytes between or after members are padding."""
    while data := data.lstrip(b"\0"):
        member = zlib.decompressobj(31)
        yield member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("gzip member ends early")
        data = member.unused_data


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    """WARC-Date of an ARC date; missing parts are filled with their first value."""
    d = (digits + "00000101000000"[len(digits):]) if digits.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None),
             f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a WARC file."""
    for member in gzip_members(data):
        at = 0
        while at < len(member):
            stop = member.find(b"\r\n\r\n", at)
            lines = member[at:stop].decode("utf-8", "replace").split("\r\n")
            if stop < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"{name}: no WARC header at {at}")
            headers = {k.strip().lower(): v.strip()
                       for k, _, v in (x.partition(":") for x in lines[1:])}
            size, begin = int(headers["content-length"]), stop + 4
            if member[begin + size:begin + size + 4] != b"\r\n\r\n":
                raise ValueError(f"{name}: record at {at} does not end at its declared length")
            yield headers, member[begin:begin + size]
            at = begin + size + 4


# ---------------------------------------------------------------- on Spark

RECORDS = ("key long, url string, date string, version string, head binary, payload_bytes long, "
           "payload_digest string, member binary")


def parse_archives(archives: DataFrame, members: bool = True) -> DataFrame:
    """Records of ARC files (``path``, ``content``). ``member`` is the finished ``response``
    record as a gzip member, so payloads travel compressed from here on; it can be left out
    where only digests are wanted."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [record_row(r, members)
                        for _, r in parse_arc(content.as_py() or b"", path)]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[i:i + 256]), TYPES)], NAMES)

    return archives.select("path", "content").mapInArrow(run, RECORDS)


NAMES = [c.split()[0] for c in RECORDS.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]
         for c in RECORDS.split(", ")]


def record_row(r: ArcRecord, whole: bool) -> tuple:
    head, payload = r.split()
    sha, key = digest(payload), r.key()
    member = None if not whole else gzip_member(warc_record([
        ("WARC-Type", "response"), *common_headers(r.url, r.date, key, sha),
        ("WARC-Record-ID", record_id(r.url, r.date, key, sha)),
        ("X-Payload-Length", len(payload))], head + payload))
    return key, r.url, r.date, r.version, head, len(payload), sha, member


def common_headers(url, date, key, sha) -> list[tuple[str, object]]:
    return [("WARC-Target-URI", url), ("WARC-Date", iso_date(date)),
            ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Record-Key", key),
            ("Content-Type", "application/http; msgtype=response")]


def originals(records: DataFrame, least: int = 0) -> DataFrame:
    """For every record that repeats a payload: its key and the smallest key with that payload.

    Equal payloads meet as (digest, length, smallest key), combined before the shuffle; the
    join back splits hot digests at run time.
    """
    equal = ["payload_digest", "payload_bytes"]
    found = staged(records.select("key", *equal).filter(F.col("payload_bytes") >= least),
                   "payloads")
    firsts = found.groupBy(*equal).agg(F.min("key").alias("original"), F.count("*").alias("n")) \
        .filter("n > 1 AND original IS NOT NULL").drop("n")
    return found.join(firsts, equal).filter("NOT key <=> original").distinct()


def convert(archives: DataFrame, path: str, least: int = 0) -> None:
    """Write the records of ARC files as WARC files below ``path``."""
    again = originals(parse_archives(archives, members=False), least).select(
        F.col("key").alias("k"), F.col("payload_digest").alias("d"),
        F.col("payload_bytes").alias("b"), "original")
    decided = parse_archives(archives).join(
        again, F.col("key").eqNullSafe(F.col("k")) & (F.col("payload_digest") == F.col("d"))
        & (F.col("payload_bytes") == F.col("b")), "left").select(*NAMES, "original")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "member"):
            for row in batch.to_pylist():
                member = row["member"] if row["original"] is None else revisit_member(row)
                held.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    yield file_of(held)
                    held, size = [], 0
        if held:
            yield file_of(held)

    write_blobs(decided.mapInArrow(run, "blob binary"), "blob", path)


def file_of(members: list[bytes]) -> pa.RecordBatch:
    info = gzip_member(warc_record([
        ("WARC-Type", "warcinfo"), ("WARC-Date", "1996-01-01T00:00:00Z"),
        ("WARC-Record-ID", record_id("warcinfo", *map(zlib.crc32, members))),
        ("Content-Type", "application/warc-fields")],
        b"format: WARC File Format 1.1\r\n"))
    return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *members])], pa.binary())],
                                      ["blob"])


def revisit_member(row: dict) -> bytes:
    """A revisit holds the HTTP head alone; digest and length of the payload are headers."""
    return gzip_member(warc_record([
        ("WARC-Type", "revisit"),
        *common_headers(row["url"], row["date"], row["key"], row["payload_digest"]),
        ("WARC-Record-ID", record_id(row["url"], row["date"], row["key"],
                                     row["payload_digest"])),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("X-Refers-To-Key", row["original"]), ("X-Payload-Length", row["payload_bytes"])],
        row["head"] or b""))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files. A response's length and digest are computed from
    its payload and must equal its headers."""
    schema = ("key long, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, url string, warc_date string, record_id string")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [r for h, b in read_warc(content.as_py(), name)
                        for r in [read_row(h, b, name)] if r]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if i in (0, 1, 4) else pa.string())
                         for i, c in enumerate(zip(*rows))],
                        [c.split()[0] for c in schema.split(", ")])

    return read_blobs(spark, path).mapInArrow(run, schema)


def read_row(h: dict[str, str], block: bytes, name: str) -> tuple | None:
    if h["warc-type"] == "warcinfo":
        return None
    sha, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
    if h["warc-type"] == "response":
        payload = ArcRecord("", "", "", block).split()[1]
        if (digest(payload), len(payload)) != (sha, size):
            raise ValueError(f"{name}: payload of {h['warc-record-id']} does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return (number("x-record-key"), size, sha, h["warc-type"], number("x-refers-to-key"),
            h["warc-target-uri"], h["warc-date"], h["warc-record-id"])


def arc_of_pages(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """ARC images of crawled pages (page_id, url, html), alternately of version 1 and 2."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in slices(batches, "html"):
            for part in (batch.slice(i, per_file) for i in range(0, batch.num_rows, per_file)):
                count += 1
                name = f"pages-{count}.arc"
                records = []
                for key, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    label = b"" if key is None else b"X-Record-Key: %d\r\n" % key
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + label + b"\r\n"
                    records.append(ArcRecord(
                        "%20".join((url or "-").split()) or "-", "19960101000000", "",
                        head + (html or "").encode()))
                data = write_arc(name, "12"[count % 2], records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([data], pa.binary())], ["path", "content"])

    return bare(pages, page_id="page_id", url="url", html="html").mapInArrow(
        run, "path string, content binary")


def pages_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to ARC images, converted to WARC files, which are then read."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    convert(arc_of_pages(pages), path, least)
    return read_archives(spark, path)
