"""Web archives inside ZIP packages: written by tasks, read back by byte ranges.

*Writing.* Every page becomes a WARC record. Payload digests are computed by Spark and those found more than once are
summed to their largest page_id; that page's record is a response, the others of that payload are revisits that name it.
The table of these digests is written out before pages meet it: where it is small, pages stay where they are; where not,
a digest of very many pages is split over tasks, and only length and digest of a revisit's payload travel on. Each task
writes its records, each a gzip member of its own, to archives of a bounded size: a ZIP (or ZIP64) package with two
stored members, ``archive/data.warc.gz`` and ``indexes/index.cdxj``. A package is written under a temporary name and
renamed. Names hold the task attempt: the table of archives that is returned names those of the attempts that succeeded,
and what a lost attempt leaves in the folder is in no table and is not read.

*Reading.* The reader takes a package's end record, its ZIP64 end record if there is one, and the central directory;
finds the stored members; reads the index; and from then on reads single records by their byte ranges. Nothing is
extracted, and a part of an archive's records can be read by any task.

The archives lie in the shared folder and are opened through ``pyarrow.fs``, which takes file, hdfs, s3 and gs addresses.

Defined results: a null html is an empty payload and counts as payload like any other; a null url is an empty target;
rows with a null page_id are records without a page (they can only be responses if no page with an id has the payload);
rows of equal page_id and payload stay separate records with one record id; extra columns are ignored; an empty table gives no archive and
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_width, staged

#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records that one reading task takes of an archive at a time.
READ_RECORDS = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"


def page_uri(page_id: int | None, digest: str) -> str:
    """The id of a page's record: rows that repeat a page_id with another payload have another id."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(uri: str) -> int | None:
    page = uri.removeprefix("<urn:page:").partition(":")[0]
    return int(page) if page else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed; without a payload a revisit, whose block ends with its HTTP headers. They tell the
    full payload's length."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_uri(page_id, digest)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_uri(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: dict(x.split(": ", 1) for x in lines if ": " in x)
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


class PackageWriter:
    """Writes stored members one after the other; the format's 64-bit fields are used where a size or place asks for them."""

    def __init__(self, out, zip64_from: int = 0xFFFFFFFF):
        self.out, self.at, self.entries, self.limit = out, 0, [], zip64_from

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        # sizes follow the data in a descriptor, of 8 bytes each because the local header has a ZIP64 field
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        directory = self.at
        for name, crc, size, start in self.entries:
            wide = [x for x in (size, size, start) if x >= self.limit]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            cut = lambda x: 0xFFFFFFFF if x >= self.limit else x
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, cut(size), cut(size), len(name), len(extra), 0, 0, 0, 0, cut(start)) + name + extra)
        size, n = self.at - directory, len(self.entries)
        if directory >= self.limit or size >= self.limit or n >= 0xFFFF:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, directory) + struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, directory, 0))


class PackageReader:
    """``read(at, n)`` gives bytes of the package; nothing but the asked ranges is read."""

    def __init__(self, read, size: int):
        self.read, self.members = read, {}
        tail_at = max(0, size - 65557)
        tail = read(tail_at, size - tail_at)
        if (at := tail.rfind(b"PK\x05\x06")) < 0:
            raise ValueError("not a ZIP package: no end of central directory")
        n, length, directory = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF in (n,) or 0xFFFFFFFF in (length, directory):
            locator = read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("ZIP64 end locator is missing")
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record is missing")
            n, length, directory = struct.unpack_from("<QQQ", end64, 32)
        data, p = read(directory, length), 0
        for _ in range(n):
            if data[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, full = struct.unpack_from("<H", data, p + 10)[0], *struct.unpack_from("<II", data, p + 20)
            names, extras, notes = struct.unpack_from("<HHH", data, p + 28)
            start = struct.unpack_from("<I", data, p + 42)[0]
            name, extra = data[p + 46 : p + 46 + names].decode(), data[p + 46 + names : p + 46 + names + extras]
            while len(extra) >= 4:
                kind, size_of = struct.unpack_from("<HH", extra)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{size_of // 8}Q", extra, 4))
                    full, packed, start = (next(values) if x == 0xFFFFFFFF else x for x in (full, packed, start))
                extra = extra[4 + size_of :]
            self.members[name] = (method, start, packed)
            p += 46 + names + extras + notes

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes start, and how many there are."""
        method, start, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        names, extras = struct.unpack_from("<HH", self.read(start, 30), 26)
        return start + 30 + names + extras, size


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system, path


def _reader(uri: str) -> tuple[PackageReader, object]:
    system, path = _open(uri)
    source = system.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return PackageReader(read, source.size()), source


def settle(pages: DataFrame) -> DataFrame:
    """page_id, url, size, payload (null for revisits), sha1, response (of revisits) of every page; ids as text."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.unhex(F.sha1(html)).alias("sha1"))
    found = rows.select("page_id", "sha1").groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response"))
    shared = staged(found.where("n > 1").select("sha1", "response"), "payloads")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = rows.join(shared, "sha1", "left")
    return joined.select(F.col("page_id").cast("string"), "url", F.length("payload").cast("long").alias("size"), F.when(~revisit, F.col("payload")).alias("payload"), "sha1", F.when(revisit, F.col("response")).cast("string").alias("response"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` to archives below ``folder``; returns archive and records of each, after they are written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, done, package = TaskContext.get(), [], None

        def begin():
            name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.wacz"
            system, path = _open(name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            out = system.open_output_stream(path + ".part")
            writer = PackageWriter(out)
            writer.begin(WARC_NAME)
            return name, system, path, out, writer, []

        def finish(name, system, path, out, writer, index):
            writer.end()
            writer.begin(INDEX_NAME)
            writer.write("".join(index).encode())
            writer.end()
            writer.close()
            out.close()
            system.move(path + ".part", path)
            done.append((name, len(index)))

        for pdf in batches:
            for page_id, url, size, payload, digest, response in zip(pdf["page_id"], pdf["url"], pdf["size"], pdf["payload"], pdf["sha1"], pdf["response"], strict=True):
                page_id, response = (None if x is None else int(x) for x in (page_id, response))
                package = package or begin()
                pack = zlib.compressobj(1, wbits=31)
                data = pack.compress(record(page_id, url, payload, size, base64.b32encode(bytes(digest)).decode(), response)) + pack.flush()
                writer, index = package[4], package[5]
                index.append(f"{'%20'.join(url.split()) or '-'} 20240101000000 {json.dumps({'offset': writer.size, 'length': len(data)})}\n")
                writer.write(data)
                if writer.size >= archive_bytes:
                    finish(*package)
                    package = None
        if package:
            finish(*package)
        yield pd.DataFrame(done, columns=["archive", "records"])

    return staged(settle(pages).mapInPandas(write, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, records_at_once: int = READ_RECORDS) -> DataFrame:
    """Every record of the archives (a column ``archive``, and ``records`` if known): page_id, url, type, digest,
    payload_bytes, refers_to and the payload (null for revisits). Each archive is read in parts."""
    if "records" not in archives.columns:
        archives = archives.withColumn("records", F.lit(1))
    n = F.greatest(F.ceil(F.col("records") / records_at_once).cast("int"), F.lit(1))
    parts = archives.withColumn("n", n).select("archive", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "n").select("archive", "part", (F.col("part") == F.col("n") - 1).alias("last"))
    parts = parts.repartition(shuffle_width(archives.sparkSession))  # dealt out in turn: the parts of one archive to many tasks

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        for pdf in batches:
            for archive, part, last in zip(pdf["archive"], pdf["part"], pdf["last"], strict=True):
                package, source = _reader(archive)
                base, _ = package.place(WARC_NAME)
                index = package.read(*package.place(INDEX_NAME)).decode().splitlines()
                rows = []
                for line in index[part * records_at_once : None if last else (part + 1) * records_at_once]:
                    at = json.loads(line.split(" ", 2)[2])
                    warc, http, payload = parse_record(zlib.decompress(package.read(base + at["offset"], at["length"]), 31))
                    revisit = warc["WARC-Type"] == "revisit"
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"{archive}: the payload of {warc['WARC-Record-ID']} does not have its digest")
                    rows.append((page_of(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI", ""), warc["WARC-Type"], digest, int(http["Content-Length"]) if revisit else len(payload), page_of(warc["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
                    if len(rows) == 500:
                        yield _typed(rows, names)
                        rows = []
                source.close()
                if rows:
                    yield _typed(rows, names)

    return parts.mapInPandas(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pd.DataFrame({name: pd.array(values, "Int64") if name in ("page_id", "refers_to") else list(values) for name, values in columns.items()})


def query(pages: DataFrame) -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    back = read_archives(write_archives(pages, folder))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
