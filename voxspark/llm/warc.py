"""WARC archives with an index of byte ranges: written and read by tasks, records found through the index first."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.llm.common import SLICE_BYTES, sliced, text_sizes
from voxspark.session import settle

#: An archive is closed beyond this size; a task starts the next one.
ARCHIVE_BYTES = 256 << 20
#: Payloads below this size are never revisits.
LEAST_BYTES = 1000
#: Records of one span of an archive are read by one task, in reads of at most RUN bytes over gaps of at most GAP bytes.
SPAN_BYTES, RUN_BYTES, GAP_BYTES = 16 << 20, 4 << 20, 64 << 10
#: Names and values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = b"\r\n\r\n"

INDEX = (
    "archive string, offset long, length long, url string, payload_digest string, record_type string, page_id long, record_id string"
)
RECORDS = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long"
_INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if part.endswith(" long") else pa.string() for part in INDEX.split(", ")]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _labelled(digest: str) -> str:
    return "sha1:" + b32encode(bytes.fromhex(digest)).decode()


def _uri(url: str) -> str:
    """A url as a header holds it: what is not visible ASCII, and percent signs, as percent escapes."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E and b != 0x25 else f"%{b:02X}" for b in url.encode("utf-8", "surrogatepass"))


def _url(uri: str) -> str:
    octets = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), uri.encode())
    return octets.decode("utf-8", "surrogatepass")


def pack_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    """One record as a gzip member; a revisit has ``refers_to``, and leaves its payload to the record of that page."""
    revisit = refers_to is not None
    block = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields.append(("WARC-Payload-Digest", _labelled(digest)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + END) + packer.flush()


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        number = self.fields.get("page-id")
        return None if number is None else int(number)

    @property
    def url(self) -> str | None:
        uri = self.fields.get("warc-target-uri")
        return None if uri is None else _url(uri)


def unpack_record(member: bytes) -> Record:
    """The record of one gzip member; a damaged one is an error, as is a response whose payload has another digest."""
    octets = zlib.decompress(member, 31)
    head, found, rest = octets.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields.get("content-length", -1))
    if not found or not lines[0].startswith("WARC/") or len(rest) != length + len(END) or rest[length:] != END:
        raise ValueError("not a whole WARC record")
    payload = rest[:length].partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != _labelled(hashlib.sha1(payload).hexdigest()):
        raise ValueError("a payload differs from its digest")
    return Record(fields, payload)


@dataclass
class _Archive:
    """An archive being written: the bytes go out as records come, the file gets its name when it is whole."""

    folder: str
    limit: int
    name: str = ""
    size: int = 0
    _out: object = None
    _paths: tuple[str, str] = field(default=("", ""))

    def add(self, member: bytes) -> tuple[str, int]:
        from pyarrow import fs

        if self._out is not None and self.size + len(member) > self.limit:
            self.close()
        if self._out is None:
            self._system, path = fs.FileSystem.from_uri(self.folder)
            self._system.create_dir(path, recursive=True)
            self.name, self.size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
            self._paths = (f"{path}/_{self.name}.part", f"{path}/{self.name}")
            self._out = self._system.open_output_stream(self._paths[0], compression=None)
        offset = self.size
        self._out.write(member)
        self.size += len(member)
        return self.name, offset

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._system.move(*self._paths)
            self._out = None


def choose_responses(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages (page_id, url, payload) with their ``digest`` and ``refers_to``: the page whose equal payload stands for theirs.

    Payloads are equal if their sha1, 64-bit hash and size are. Copies are counted in tasks before they meet, and only
    groups of several rows are joined back, so payloads that occur once meet nothing.
    """
    size = F.octet_length("payload")
    keyed = pages.withColumn("digest", F.sha1("payload")).withColumn("size", size).withColumn("check", F.xxhash64("payload"))
    key = ["digest", "size", "check"]
    groups = keyed.where(F.col("size") >= least_bytes).groupBy(*key).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    groups = settle(groups.where("copies > 1 AND kept IS NOT NULL").drop("copies"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return keyed.join(groups, key, "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 3, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """Writes a record per row of (page_id, url, html) to archives in ``folder``, and returns their index.

    Of rows with equal payloads (html in UTF-8, null: empty) of at least ``least_bytes`` bytes, the one with the largest
    page_id is a response and the others are revisits that refer to it; all other rows are responses. The index has a row
    a record: archive, offset, length, url, payload digest, type, page_id and record id. Every record is a gzip member of
    its own, so a byte range of the index is a whole record.

    ``folder`` is a path or URI that all executors reach. Archives are named by chance and renamed when they are whole;
    the index holds those of the tasks that Spark counted, so a task that runs again leaves at most a file that no index
    names. A null url has no target header; a null page_id never stands for others while a row of equal payload has one,
    and has no page header; rows that repeat the largest page_id of a group are all responses. An empty table writes no
    archive. Other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    rows = choose_responses(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload), least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder, archive_bytes)
        for batch in sliced(batches, text_sizes("payload")):
            found = []
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, octets, digest, refers_to in zip(*columns, strict=True):
                member = pack_record(page_id, url, octets, digest, refers_to, date, level)
                name, offset = archive.add(member)
                kind = "response" if refers_to is None else "revisit"
                found.append((name, offset, len(member), url, digest, kind, page_id, record_id(page_id, digest)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)
        archive.close()

    return settle(rows.mapInArrow(write, INDEX))


def runs(ranges: list[tuple[int, int]], run_bytes: int = RUN_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, places) of the reads that cover sorted ranges (offset, length), near ones in one read."""
    start, end, places = 0, 0, []
    for place, (offset, length) in enumerate(ranges):
        if places and (offset - end > gap_bytes or max(end, offset + length) - start > run_bytes):
            yield start, end, places
            places = []
        if not places:
            start, end = offset, offset + length
        end = max(end, offset + length)
        places.append(place)
    if places:
        yield start, end, places


def read_records(index: DataFrame, folder: str, payload: bool = True, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The records that rows of an index name, read from the archives: fields, digest and size of the payload, and the payload.

    Select the rows of the index first, by url, digest or type. They are dealt by spans of archives and sorted there, and
    neighbouring ranges are fetched in one read. Every payload is checked against its digest. Digest and size of a
    revisit are those it states; with ``payload``, its own is null, as it is in the record it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            archives = batch.column("archive").to_pylist()
            ranges = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            first = 0
            while first < len(archives):
                last = first
                while last < len(archives) and archives[last] == archives[first]:
                    last += 1
                if opened[0] != archives[first]:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = (archives[first], system.open_input_file(f"{path}/{archives[first]}"))
                for start, end, places in runs(ranges[first:last]):
                    octets = opened[1].read_at(end - start, start)
                    yield from _read_rows((octets[o - start : o - start + n] for o, n in (ranges[first + p] for p in places)), payload)
                first = last
        if opened[1] is not None:
            opened[1].close()

    # As many tasks as there are spans to read: the index is too small for adaptive execution to see that work.
    tasks = int((index.agg(F.sum("length")).first()[0] or 0) // span_bytes) + 1
    span = F.floor(F.col("offset") / span_bytes)
    placed = index.select("archive", "offset", "length").repartition(tasks, "archive", span).sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(read, RECORDS + (", payload binary" if payload else ""))


def _read_rows(members: Iterator[bytes], payload: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for member in members:
        record = unpack_record(member)
        revisit = record.fields["warc-type"] == "revisit"
        row = {
            "page_id": record.page_id,
            "url": record.url,
            "record_type": record.fields["warc-type"],
            "record_id": record.fields["warc-record-id"],
            "refers_to_id": record.fields.get("warc-refers-to"),
            "payload_digest": b32decode(record.fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "payload_bytes": None if revisit else len(record.payload),
        }
        if payload:
            row["payload"] = None if revisit else record.payload
            held += len(record.payload)
        rows.append(row)
        if held >= SLICE_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in rows[0]], names=list(rows[0]))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records read back: revisits get size and digest
    from the payload of the response that they name. Only responses that a revisit names take part in the join."""
    records = settle(records.drop("payload", "url"))
    revisits = records.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    responses = records.where("record_type = 'response'").join(named, "record_id", "left_semi")
    responses = settle(responses.groupBy("record_id").agg(*(F.first(c).alias(a) for c, a in (("page_id", "refers_to"), ("payload_bytes", "bytes"), ("payload_digest", "digest")))))
    known = revisits.join(responses, F.col("refers_to_id") == responses["record_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no payload for "), F.col("refers_to_id")))
    told = known.select(
        "page_id",
        F.coalesce("bytes", missing.cast("long")).alias("payload_bytes"),
        F.coalesce(F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")), missing.cast("string")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    plain = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(told)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages to archives, reads every record back through the index, and tells what was read."""
    return resolve_revisits(read_records(write_archives(pages, folder), folder, payload=False))
