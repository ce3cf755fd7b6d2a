"""WARC records in ZIP packages: written with revisit records, and range-read without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages

DATE = "2024-01-01T00:00:00Z"
#: Signatures and sizes of the ZIP format's records.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, CENTRAL_SIZE, LOCAL_SIZE, LONGEST_COMMENT = 22, 20, 46, 30, 65_535


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    """The page of one of our own record ids; null for ids of other archives."""
    found = re.fullmatch(r"<?urn:x-page:(-?\d+)>?", urn or "")
    return int(found[1]) if found else None


def one_line(text: str) -> str:
    """A header's value: no line break in an address may start another header."""
    return re.sub(r"[\r\n\x00]", " ", text)


def warc_record(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member holding a response, or a revisit whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one WARC record, plain or a gzip member of its own."""
    head, _, rest = (zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member).partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def zip_members(read_at: Callable[[int, int], bytes], size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, place of the data, stored size) of each member, from the central directory.

    Only the archive's tail, its directory and 30 bytes of each local header are read. The ZIP64
    records are used where the 32-bit fields are full.
    """
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT - LOCATOR64_SIZE)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if (entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail[at - LOCATOR64_SIZE : at - 16] == LOCATOR64:
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        record = read_at(end64, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack("<QQQ", record[32:56])
    directory, p = read_at(start, length), 0
    for _ in range(entries):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        stored, whole = struct.unpack("<II", directory[p + 20 : p + 28])
        n_name, n_extra, n_comment = struct.unpack("<HHH", directory[p + 28 : p + 34])
        (local,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + CENTRAL_SIZE : p + CENTRAL_SIZE + n_name].decode("utf-8")
        extra = directory[p + CENTRAL_SIZE + n_name : p + CENTRAL_SIZE + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values, of those fields alone that are full, in this order
                wide = [x for (x,) in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                whole = wide.pop(0) if whole == 0xFFFFFFFF and wide else whole
                stored = wide.pop(0) if stored == 0xFFFFFFFF and wide else stored
                local = wide.pop(0) if local == 0xFFFFFFFF and wide else local
            extra = extra[4 + n :]
        header = read_at(local, LOCAL_SIZE)
        if header[:4] != LOCAL:
            raise ValueError("broken local header")
        n_name_here, n_extra_here = struct.unpack("<HH", header[26:30])
        yield name, method, local + LOCAL_SIZE + n_name_here + n_extra_here, stored
        p += CENTRAL_SIZE + n_name + n_extra + n_comment


def open_range(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    system, path = fs.FileSystem.from_uri(uri)
    f = system.open_input_file(path)
    return (lambda at, n: f.read_at(n, at)), f.size()


class Package:
    """One archive in the making: records in archive/data.warc.gz, their places in indexes/index.cdxj."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"  # a retried task writes another file
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, page_id, url: str, record: bytes) -> None:
        self.member.write(record)
        place = {"url": url, "filename": "data.warc.gz", "offset": str(self.size), "length": str(len(record))}
        self.index.append(f"{'null' if page_id is None else page_id} {json.dumps(place)}")
        self.size += len(record)

    def close(self) -> tuple[str, int]:
        n = len(self.index)
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(x + "\n" for x in self.index))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        self.zip.close()
        self.out.close()
        return self.uri, n


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    revisit_min_bytes: int = 0, package_bytes: int = 64_000_000,
) -> DataFrame:
    """Writes every row as a record; returns the manifest (path, n_records). Evaluating it writes.

    Of rows with equal payloads (SHA-256) of at least ``revisit_min_bytes`` bytes, those with the
    largest id are responses and the others revisit it. Null payloads and addresses are empty; a
    null id sorts below all others. Largest ids are aggregated before the shuffle, and rows meet
    them in a join that adaptive execution may split.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    largest = rows.groupBy("digest").agg(F.max("id").alias("first"))
    rows = rows.join(largest, "digest").select(
        "id", "url", "payload", "first",
        ((F.octet_length("payload") >= revisit_min_bytes) & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, data, first, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
                package = package or Package(folder)
                page_id, url = page_id.as_py(), url.as_py()
                package.add(page_id, url, warc_record(page_id, url, data.as_py(), first.as_py(), revisit.as_py()))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist([{"path": p, "n_records": n} for p, n in done], pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return rows.mapInArrow(run, "path string, n_records long")


INDEX = re.compile(r"indexes/.*\.cdxj?(\.gz)?")
ARCHIVE = re.compile(r"archive/.*\.warc(\.gz)?")
STEP = 1 << 20


def index_lines(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of each record that an index names: lines with a JSON object, or
    columns under a header of their letters (S size, V offset, g file)."""
    letters: list[str] = []
    for line in io.BytesIO(data):
        if line.startswith((b" CDX ", b"CDX ")):
            letters = line.decode().split()[1:]
        elif line[:1] != b"!" and b"{" in line:
            place = json.loads(line[line.index(b"{") :])
            yield place["filename"], int(place["offset"]), int(place["length"])
        elif letters and len(cells := line.decode("utf-8", "replace").split()) == len(letters):
            size, offset, name = (cells[letters.index(x)] for x in "SVg")
            yield name, int(offset), int(size)


def gzip_members(read_at: Callable[[int, int], bytes], at: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the gzip members that stand one behind another; bounded memory, one pass."""
    start, here, end, left = at, at, at + size, b""
    while start < end:
        member = zlib.decompressobj(31)
        while not member.eof:
            data = left or read_at(here, min(STEP, end - here))
            here += 0 if left else len(data)
            left = b""
            if not data:
                return  # cut short
            member.decompress(data, STEP)
            while member.unconsumed_tail and not member.eof:
                member.decompress(member.unconsumed_tail, STEP)
        left = member.unused_data
        yield start, here - len(left) - start
        start = here - len(left)


def plain_records(read_at: Callable[[int, int], bytes], at: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the records of an archive that isn't compressed; only headers are read."""
    start, end = at, at + size
    while start < end:
        head, n = b"", 8192
        while b"\r\n\r\n" not in head and len(head) < end - start:
            head = read_at(start, min(n, end - start))
            n *= 4
        top = head.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:\s*(\d+)", top)
        if not found:
            return
        length = len(top) + 4 + int(found[1])
        yield start, length
        start += length + 4


def record_places(read_at: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of every record of a package: those that its indexes name, by the file's name
    wherever the index was made, and those of archive members that no index names, found by reading
    these through. Secondary indexes (of blocks of an index) name no records."""
    members = {name: (method, at, n) for name, method, at, n in zip_members(read_at, size)}
    archives = {name.rpartition("/")[2]: name for name in members if ARCHIVE.fullmatch(name)}
    named = set()
    for name, (method, at, n) in members.items():
        if not INDEX.fullmatch(name):
            continue
        data = read_at(at, n)
        data = zlib.decompress(data, -15) if method else data
        for file, offset, length in index_lines(gzip.decompress(data) if name.endswith(".gz") else data):
            archive = archives.get(file.rpartition("/")[2])
            if archive is None:
                raise ValueError(f"the index names {file!r}, which the package lacks")
            named.add(archive)
            yield stored_at(members[archive]) + offset, length
    for name in sorted(set(archives.values()) - named):
        at, n = stored_at(members[name]), members[name][2]
        yield from (gzip_members if name.endswith(".gz") else plain_records)(read_at, at, n)


def stored_at(member: tuple[int, int, int]) -> int:
    if member[0] != zipfile.ZIP_STORED:
        raise ValueError("range reads need stored members")
    return member[1]


def read_index(packages: DataFrame) -> DataFrame:
    """(path, start, length) of every record of the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = list(record_places(*open_range(path)))
                columns = [pa.array([path] * len(found), pa.string()), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "start", "length"])

    return packages.select("path").mapInArrow(run, "path string, start long, length long")


def read_records(places: DataFrame, range_bytes: int = 8_000_000) -> DataFrame:
    """One row per record, read by range: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits, which hold none). Page ids are null for records of other
    archives; where a length or digest isn't said, the payload's own is given. Places near each other in
    a package go to one task, and there are as many tasks as the records' bytes ask for."""
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(1, -(-total // range_bytes))
    near = places.repartition(tasks, "path", F.floor(F.col("start") / range_bytes)).sortWithinPartitions("path", "start")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def record(data: bytes) -> dict:
        headers, block = parse_record(data)
        kind = headers.get("warc-type", "")
        http, _, payload = block.partition(b"\r\n\r\n") if "http" in headers.get("content-type", "") else (b"", b"", block)
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(said[1]) if said else len(payload)
        named, _, digest = headers.get("warc-payload-digest", "").rpartition(":")
        own = sha1_base32(payload) if kind == "response" or not digest else ""
        if kind == "response" and digest and named in ("", "sha1") and (len(payload) != length or own != digest):
            raise ValueError(f"broken payload of {headers.get('warc-record-id')}")
        digest = digest or own
        return {
            "page_id": urn_page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri", ""), "record_type": kind,
            "refers_to": urn_page(headers.get("warc-refers-to")), "payload_bytes": length, "payload_digest": digest,
            "payload": payload if kind == "response" else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, read_at, rows, held = None, None, [], 0
        for batch in batches:
            for path, start, length in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if path != at:
                    at, (read_at, _) = path, open_range(path)
                rows.append(record(read_at(start, length)))
                held += rows[-1]["payload_bytes"]
                if held >= range_bytes:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return near.mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes packages to the shared folder and reads every record back.

    An empty table writes no package and gives no rows; repeated rows are repeated records.
    """
    stages = Stages(spark, "warc")
    manifest = stages.save(write_packages(pages, stages.path("packages"), **options), "manifest")
    places = stages.save(read_index(manifest.repartition("path")), "places")
    return read_records(places).drop("payload", "url")
