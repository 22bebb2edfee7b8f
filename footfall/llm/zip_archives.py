"""WARC records in ZIP packages, read by ranges without unpacking.

A package is a ZIP file of stored (uncompressed) members:

    archive/data.warc.gz   records, each a gzip member of its own
    indexes/index.cdx      a line for each record: URL key, time, JSON with offset and length
    datapackage.json       size and SHA-256 of the members

As members are stored, a record is a byte range of the package itself. The reader parses the
end record, the central directory (and the ZIP64 forms of both, which the writer always uses)
and the local headers, finds archives and indexes, and turns index lines into runs of neighbouring
records. Spark spreads the runs, and a task reads only their ranges. An archive without an index
is read from its start.

Equal payloads of at least ``LEAST_SHARED`` bytes are kept once: the record with the largest
(page_id, url) is a response, others revisit it. Payload digests are found in a first scan and
looked up (see ``look_up``), so a payload shared by a third of the pages stays spread.

Tasks write under names of their own and return them; only names returned by the tasks that
counted are read, so a repeated task does no harm.

Edge cases: a null html is an empty payload; null page_id and url are left out of the record
and come back as null, a null page_id is the smallest. Of rows equal in all three columns one is
the response. A record of any size is held once in memory. An empty table gives no package, and
no package no row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import importable, look_up, only, stash

LEAST_SHARED = 1000
# A package is closed beyond these.
PACKAGE_BYTES = 64 << 20
PACKAGE_RECORDS = 100_000
# Bytes read at once, also of neighbouring records.
READ_BYTES = 4 << 20
# Archived bytes that a reading task is given.
TASK_BYTES = 16 << 20
# Copies of one row written by one task.
COPIES_AT_ONCE = 10_000
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"

ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"

# ZIP records: signatures and layouts.
LOCAL, LOCAL_SIGN = struct.Struct("<4s5H3I2H"), b"PK\x03\x04"
ENTRY, ENTRY_SIGN = struct.Struct("<4s6H3I5H2I"), b"PK\x01\x02"
END, END_SIGN = struct.Struct("<4s4H2IH"), b"PK\x05\x06"
END64, END64_SIGN = struct.Struct("<4sQ2H2I4Q"), b"PK\x06\x06"
LOCATOR, LOCATOR_SIGN = struct.Struct("<4sIQI"), b"PK\x06\x07"
DESCRIPTOR, DESCRIPTOR_SIGN = struct.Struct("<4sI2Q"), b"PK\x07\x08"
MOST32, MOST16, ZIP64 = 0xFFFFFFFF, 0xFFFF, 1
VERSION, STREAMED, MIDNIGHT_1980 = 45, 8, 33


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop escapes nothing and writes file:/x for what others call file:///x
    uri = quote(path, safe="/:@,=")
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


# -- ZIP -----------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, written front to back: sizes follow the data, directory at the end."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc = name.encode(), self.at, 0
        extra = struct.pack("<2H2Q", ZIP64, 16, 0, 0)
        fields = VERSION, STREAMED, 0, 0, MIDNIGHT_1980, 0, MOST32, MOST32
        self._put(LOCAL.pack(LOCAL_SIGN, *fields, len(self.name), len(extra)))
        self._put(self.name + extra)
        self.start = self.at
        self.hash = hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.hash.update(data)
        self._put(data)

    def end(self) -> dict:
        size = self.at - self.start
        self._put(DESCRIPTOR.pack(DESCRIPTOR_SIGN, self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.header))
        name = self.name.decode()
        return {"path": name, "bytes": size, "hash": f"sha256:{self.hash.hexdigest()}"}

    def close(self) -> None:
        start = self.at
        for name, crc, size, header in self.entries:
            extra = struct.pack("<2H3Q", ZIP64, 24, size, size, header)
            fields = VERSION, VERSION, STREAMED, 0, 0, MIDNIGHT_1980, crc, MOST32, MOST32
            tail = len(name), len(extra), 0, 0, 0, 0, MOST32
            self._put(ENTRY.pack(ENTRY_SIGN, *fields, *tail) + name + extra)
        end, n = self.at, len(self.entries)
        sizes = n, n, end - start, start
        self._put(END64.pack(END64_SIGN, END64.size - 12, VERSION, VERSION, 0, 0, *sizes))
        self._put(LOCATOR.pack(LOCATOR_SIGN, 0, end, 1))
        self._put(END.pack(END_SIGN, 0, 0, MOST16, MOST16, MOST32, MOST32, 0))


class Member(NamedTuple):
    name: str
    start: int
    size: int


class ZipReader:
    """The stored members of a ZIP file as byte ranges of the file."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.block, self.block_at = b"", 0

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes at ``at``; small reads are served from one larger one."""
        if not self.block_at <= at <= at + n <= self.block_at + len(self.block):
            most = max(0, min(max(n, 1 << 16), self.size - at))
            self.block, self.block_at = self.file.read_at(most, at), at
        a = at - self.block_at
        found = self.block[a : a + n]
        if len(found) < n:
            raise ValueError("the ZIP file ends too early")
        return found

    def _directory(self) -> tuple[int, int, int]:
        """Place, size and number of entries of the directory; place of what precedes the ZIP."""
        tail_at = max(0, self.size - END.size - MOST16)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END_SIGN)
        # the signature may occur in the comment behind the record
        while at >= 0:
            if len(tail) - at >= END.size:
                *_, n, size, offset, comment = END.unpack_from(tail, at)
                if at + END.size + comment == len(tail):
                    break
            at = tail.rfind(END_SIGN, 0, at)
        else:
            raise ValueError("not a ZIP file")
        end = tail_at + at
        if MOST32 in (size, offset) or n == MOST16:
            located = end - LOCATOR.size
            if located >= 0 and self.read(located, 4) == LOCATOR_SIGN:
                _, _, told, _ = LOCATOR.unpack(self.read(located, LOCATOR.size))
                for place in (told, located - END64.size):
                    if 0 <= place <= located - END64.size and self.read(place, 4) == END64_SIGN:
                        found = END64.unpack(self.read(place, END64.size))
                        n, size, offset = found[7:]
                        end = place
                        break
                else:
                    raise ValueError("the ZIP64 end record is missing")
        return end - size, n, end - size - offset

    def members(self) -> Iterator[Member]:
        at, n, shift = self._directory()
        for _ in range(n):
            entry = ENTRY.unpack(self.read(at, ENTRY.size))
            sign, method, packed, size = entry[0], entry[4], entry[8], entry[9]
            name_size, extra_size, comment_size, header = *entry[10:13], entry[16]
            if sign != ENTRY_SIGN:
                raise ValueError("the ZIP directory is damaged")
            name = self.read(at + ENTRY.size, name_size).decode()
            extra = self.read(at + ENTRY.size + name_size, extra_size)
            packed, header = self._wide(extra, size, packed, header)
            at += ENTRY.size + name_size + extra_size + comment_size
            if name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
                if method:
                    raise ValueError(f"{name} is compressed, so it has no ranges")
                local = LOCAL.unpack(self.read(header + shift, LOCAL.size))
                if local[0] != LOCAL_SIGN:
                    raise ValueError("a local header is damaged")
                yield Member(name, header + shift + LOCAL.size + local[9] + local[10], packed)

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int]:
        """Size and place of the local header, from the ZIP64 field where 32 bits are too few."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<2H", extra, at)
            if kind == ZIP64:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
                size = next(wide) if size == MOST32 else size
                packed = next(wide) if packed == MOST32 else packed
                header = next(wide) if header == MOST32 else header
            at += 4 + length
        return packed, header


# -- WARC ----------------------------------------------------------------------------------


def _line(text: str) -> str:
    """A header value: line ends would begin another header."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def response_id(digest: bytes) -> str:
    """The record that all others with this payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, digest.hex())}>"


def record_bytes(row: dict) -> bytes:
    """A record. ``row`` has page_id, url, digest, size, html (a response) or refers (a revisit)."""
    payload, refers = (row["html"] or "").encode(), row["refers"]
    page = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['size']}\r\n\r\n"
    ).encode()
    block = page if refers else page + payload
    shared = row["size"] >= LEAST_SHARED and not refers
    number = response_id(row["digest"]) if shared else f"<{uuid.uuid4().urn}>"
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", number),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if row["url"] is None else _line(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(row['digest']).decode()}"),
        ("X-Payload-Length", row["size"]),
        ("X-Page-Id", row["page_id"]),
    ]
    if refers:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", response_id(row["digest"])),
            ("WARC-Refers-To-Target-URI", refers["url"] and _line(refers["url"])),
            ("X-Refers-To-Page-Id", refers["page_id"]),
        ]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head_end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:head_end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    start = head_end + 4
    size = int(fields["content-length"])
    if len(raw) < start + size:
        raise ValueError("the WARC record ends too early")
    return fields, raw[start : start + size]


def _index_line(url: str | None, fields: dict) -> str:
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
        key = f"{host}){parts.path or '/'}{'?' * bool(parts.query)}{parts.query}"
    except ValueError:  # not an address
        key = url
    key = re.sub(r"\s", "%20", key)
    return f"{key} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(fields)}\n"


class PackageWriter:
    """Packages of one task; a closed one is returned as (path, records, bytes)."""

    def __init__(self, folder: str):
        self.files, self.folder = file_system(folder)
        self.folder_uri, self.zip = folder, None
        self.files.create_dir(self.folder, recursive=True)

    def _open(self) -> None:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        self.path = f"{self.folder_uri}/{name}"
        self.out = self.files.open_output_stream(f"{self.folder}/{name}")
        self.zip, self.index = ZipWriter(self.out), []
        self.zip.begin(ARCHIVE)

    def add(self, row: dict) -> None:
        if self.zip is None:
            self._open()
        packer = zlib.compressobj(LEVEL, wbits=31)
        packed = packer.compress(record_bytes(row)) + packer.flush()
        fields = {
            "url": row["url"],
            "digest": f"sha1:{base64.b32encode(row['digest']).decode()}",
            "mime": "warc/revisit" if row["refers"] else "text/html",
            "offset": self.zip.at - self.zip.start,
            "length": len(packed),
            "filename": ARCHIVE.rpartition("/")[2],
        }
        self.index.append(_index_line(row["url"], fields))
        self.zip.write(packed)

    @property
    def full(self) -> bool:
        return self.zip.at > PACKAGE_BYTES or len(self.index) >= PACKAGE_RECORDS

    def close(self) -> pa.RecordBatch | None:
        if self.zip is None:
            return None
        resources = [self.zip.end()]
        self.zip.begin(INDEX)
        for line in sorted(self.index):
            self.zip.write(line.encode())
        resources.append(self.zip.end())
        self.zip.begin(PACKAGE)
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}
        self.zip.write(json.dumps(about).encode())
        self.zip.end()
        self.zip.close()
        self.out.close()
        row = [[self.path], [len(self.index)], [self.zip.at]]
        self.zip = None
        return pa.RecordBatch.from_arrays(
            [pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64())],
            ["path", "records", "bytes"],
        )


def _told_apart(plain: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, refers): refers is set for a revisit.

    Rows equal in all columns are one response and, without its html, as many revisits.
    """
    shareable = plain.filter(F.col("size") >= LEAST_SHARED)
    alike = shareable.groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    repeated = (
        alike.groupBy("digest")
        .agg(F.sum("n").alias("total"), F.max(F.struct("page_id", "url", "n")).alias("best"))
        .filter("total > 1")
        .select("digest", "best")
    )
    repeated = stash(repeated, "repeated")
    # small payloads have no key: nothing is looked up, and they stay spread
    keyed = plain.withColumn("key", F.when(F.col("size") >= LEAST_SHARED, F.col("digest")))
    known = look_up(keyed, repeated.withColumnRenamed("digest", "key"), ["key"])
    is_best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(
        F.col("best.url")
    )
    best = F.coalesce(is_best, F.lit(False)) & F.col("best").isNotNull()
    several = best & (F.col("best.n") > 1)
    refers = F.struct(F.col("best.page_id").alias("page_id"), F.col("best.url").alias("url"))
    columns = "page_id", "url", "html", "digest", "size", "refers"
    rows = known.withColumn("refers", F.when(F.col("best").isNotNull() & ~best, refers))
    rows = rows.withColumn("html", F.when(F.col("refers").isNull(), F.col("html")))
    found = rows.filter(~several).select(*columns)
    twins = repeated.filter("best.n > 1")
    if twins.isEmpty():
        return found
    # interchangeable rows: any one is the response
    first = rows.filter(several).dropDuplicates(["digest"])
    chunks = F.sequence(F.lit(0).cast("long"), F.expr("(best.n - 2) div " + str(COPIES_AT_ONCE)))
    copies = (
        first.select("page_id", "url", "digest", "size", "best", F.explode(chunks).alias("chunk"))
        .repartition("digest", "chunk")
        .withColumn(
            "i",
            F.explode(
                F.sequence(
                    F.lit(1).cast("long"),
                    F.least(
                        F.lit(COPIES_AT_ONCE).cast("long"),
                        F.col("best.n") - 1 - F.col("chunk") * COPIES_AT_ONCE,
                    ),
                )
            ),
        )
        .select(
            "page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size",
            refers.alias("refers"),
        )
    )
    return found.union(first.select(*columns)).union(copies)


def write_packages(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record for every page; (path, records, bytes) of each package."""
    importable(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    plain = only(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        html.alias("html"),
        F.unhex(F.sha1(html)).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )

    def run(batches):
        writer = PackageWriter(folder)
        for batch in batches:
            for row in _rows(batch):
                writer.add(row)
                if writer.full:
                    yield writer.close()
        last = writer.close()
        if last is not None:
            yield last

    written = _told_apart(plain).mapInArrow(run, "path string, records long, bytes long")
    return stash(written, "packages")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dictionaries, few at a time, so that a batch is not held twice."""
    for at in range(0, batch.num_rows, 100):
        yield from batch.slice(at, 100).to_pylist()


# -- reading -------------------------------------------------------------------------------


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the ZIP files of a folder, whoever wrote them; no content is read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def _entries(zip_file: ZipReader, index: Member) -> Iterator[dict]:
    """The JSON parts of the lines of an index."""
    rest = b""
    for at in range(index.start, index.start + index.size, READ_BYTES):
        size = min(READ_BYTES, index.start + index.size - at)
        *lines, rest = (rest + zip_file.read(at, size)).split(b"\n")
        for line in lines:
            if b"{" in line:
                yield json.loads(line[line.index(b"{") :])
    if b"{" in rest:
        yield json.loads(rest[rest.index(b"{") :])


def _runs(path: str) -> Iterator[tuple[str, int, int, list[int]]]:
    """(path, place, size, lengths): neighbouring records; no lengths where no index tells them."""
    files, local = file_system(path)
    with files.open_input_file(local) as file:
        zip_file = ZipReader(file)
        members = list(zip_file.members())
        archives = {m.name.rpartition("/")[2]: m for m in members if m.name.startswith("archive/")}
        ranges: dict[str, list] = {name: [] for name in archives}
        for index in (m for m in members if m.name.endswith((".cdx", ".cdxj"))):
            for entry in _entries(zip_file, index):
                ranges[entry["filename"]].append((int(entry["offset"]), int(entry["length"])))
    for name, member in archives.items():
        if not ranges[name]:
            yield path, member.start, member.size, []
            continue
        found = np.unique(np.array(ranges[name], np.int64), axis=0)
        ends = found.sum(axis=1)
        if ends.max() > member.size:
            raise ValueError(f"the index of {path} leaves the archive")
        first = 0
        for i in range(1, len(found) + 1):
            if i < len(found) and found[i, 0] == ends[i - 1] and ends[i] - found[first, 0] <= READ_BYTES:
                continue
            at, size = int(found[first, 0]), int(ends[i - 1] - found[first, 0])
            yield path, member.start + at, size, found[first:i, 1].tolist()
            first = i


def _unpacked(file, at: int, size: int, lengths: list[int]) -> Iterator[bytes]:
    """The records of a run."""
    if lengths:
        data, start = memoryview(file.read_at(size, at)), 0
        for n in lengths:
            raw = bytes(data[start : start + n])
            yield zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw
            start += n
        return
    unpacker, whole = zlib.decompressobj(wbits=31), io.BytesIO()
    for place in range(at, at + size, READ_BYTES):
        data = file.read_at(min(READ_BYTES, at + size - place), place)
        while data:
            whole.write(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield whole.getvalue()
                unpacker, whole = zlib.decompressobj(wbits=31), io.BytesIO()
    if whole.tell():
        raise ValueError("the archive ends inside a record")


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _record_row(raw: bytes, with_payload: bool) -> tuple | None:
    fields, block = parse_record(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    told = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    payload, size = None, _number(fields.get("x-payload-length"))
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if digest != told:
            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return (
        _number(fields.get("x-page-id")),
        fields.get("warc-target-uri"),
        kind,
        size,
        told,
        _number(fields.get("x-refers-to-page-id")),
        payload if with_payload else None,
    )


RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
RUNS = pa.schema(
    [("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("lengths", pa.list_(pa.int64()))]
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def read_records(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of packages (path, bytes).

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload). The payload
    of a revisit is null; its size and digest are those of the record it refers to. Every
    payload read is checked against its digest.
    """
    importable(packages.sparkSession)

    def locate(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                some = []
                for run in _runs(path):
                    some.append(run)
                    if len(some) == 1000:
                        yield _table(some, RUNS)
                        some = []
                if some:
                    yield _table(some, RUNS)

    def fetch(batches):
        opened, file, rows, held = None, None, [], 0
        for batch in batches:
            for run in batch.to_pylist():
                if run["path"] != opened:
                    if file:
                        file.close()
                    files, local = file_system(run["path"])
                    opened, file = run["path"], files.open_input_file(local)
                for raw in _unpacked(file, run["at"], run["size"], run["lengths"]):
                    row = _record_row(raw, with_payload)
                    if row:
                        rows.append(row)
                        held += len(row[-1] or b"")
                    if held > READ_BYTES or len(rows) == 5000:
                        yield _table(rows, RECORDS)
                        rows, held = [], 0
        if rows:
            yield _table(rows, RECORDS)
        if file:
            file.close()

    # tasks by the bytes that paths and runs stand for, not by their own few
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    runs = (
        packages.select("path")
        .repartition(size // PACKAGE_BYTES + 1, "path")
        .mapInArrow(locate, "path string, at long, size long, lengths array<long>")
    )
    return runs.repartition(size // TASK_BYTES + 1, "path", "at").mapInArrow(
        fetch,
        "page_id long, url string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long, payload binary",
    )
