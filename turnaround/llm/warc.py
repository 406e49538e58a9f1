"""Web archives in ZIP packages: WARC records written as stored members and read back in place.

A package holds `archive/data.warc.gz` (every record its own gzip member) and `indexes/index.cdxj` (a
line per record: its file, offset and length in the member). Members are stored, not
compressed, so a record is one range of the package. Packages made elsewhere may hold any number of
archives and indexes under these two folders. Files are reached through the file system that
the folder's address names, from executors, and listed in a stored table of those that were committed.
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

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.sources.storage import materialize, new_path

ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes read at once from an archive that no index covers.
CHUNK = 1 << 20
#: A package is closed when its records reach so many bytes, or so many records.
PACKAGE_BYTES = 64 << 20
PACKAGE_RECORDS = 100_000
LEVEL = 3


def _open(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, block = ("response", http + payload) if refers_to is None else ("revisit", http)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def planned(pages: DataFrame) -> DataFrame:
    """`(page_id, url, html, refers_to)`: `refers_to` is the largest id with an equal payload, null for
    that page itself. Payloads are compared by SHA-256; ids are reduced to their maximum before the
    shuffle, and a payload many pages share is split by adaptive execution in the join back."""
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("key", F.sha2("html", 256))
    latest = rows.groupBy("key").agg(F.max("page_id").alias("latest"))
    return rows.join(latest, "key").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes packages under `folder` and returns their stored list, `(path, n_records)`.

    A failed task's files are in no list, so a retry repeats nothing. Of pages with equal payloads
    that with the largest id is the response and the others revisit it. A null html is an empty
    payload, a null url an empty address. Pages with a null id are written; they revisit a page with
    an id where there is one. Rows that repeat a page are records of the same type. An empty table
    writes no package. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        package = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                package = package or _Package(system, f"{root}/{uuid.uuid4().hex}.zip")
                package.add(record(page_id, url, html.encode(), refers_to))
                if package.size >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                    yield package.close(folder)
                    package = None
        if package:
            yield package.close(folder)

    listed = common.map_batches(planned(pages), run, "path string, n_records long")
    return materialize(listed, "package-list")


class _Package:
    """A package being written, one record after the other."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.path, self.size, self.lines = path, 0, []
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, content: bytes) -> None:
        packed = _gzip(content)
        self.data.write(packed)
        entry = {"record": len(self.lines), "filename": DATA.removeprefix(ARCHIVES), "offset": self.size, "length": len(packed)}
        self.lines.append(json.dumps(entry))
        self.size += len(packed)

    def close(self, folder: str) -> pa.RecordBatch:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.file.close()
        name = self.path.rsplit("/", 1)[1]
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([len(self.lines)], pa.int64())})


# --- Reading --------------------------------------------------------------------------------------

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


class Ranges:
    """A file read by ranges."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, length: int) -> bytes:
        if at < 0 or at + length > self.size:
            raise ValueError(f"range {at}+{length} lies outside the package of {self.size} bytes")
        self.file.seek(at)
        return self.file.read(length)


def directory(source: Ranges) -> dict[str, tuple[int, int, int]]:
    """`{name: (method, offset of the data, size)}` from the central directory, ZIP64 included."""
    tail = source.read(max(0, source.size - 65557), min(source.size, 65557))
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if (entries == _MAX16 or length == _MAX32 or start == _MAX32) and tail[max(0, at - 20) :].startswith(_LOCATOR):
        end64 = source.read(struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if not end64.startswith(_END64):
            raise ValueError("the ZIP64 locator points to no ZIP64 directory end")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    listing, out, at = source.read(start, length), {}, 0
    for _ in range(entries):
        if listing[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", listing, at + 10)[0]
        packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", listing, at + 20)
        local = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46 : at + 46 + n_name].decode()
        extra = listing[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                size = wide.pop(0) if size == _MAX32 else size
                packed = wide.pop(0) if packed == _MAX32 else packed
                local = wide.pop(0) if local == _MAX32 else local
            extra = extra[4 + n :]
        head = source.read(local, 30)
        if not head.startswith(_LOCAL):
            raise ValueError(f"{name}: no local header where the directory says")
        skip = sum(struct.unpack_from("<HH", head, 26))
        out[name] = (method, local + 30 + skip, packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def stored(members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    method, at, size = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed: its records cannot be read in place")
    return at, size


def parse(data: bytes) -> dict:
    """A record's headers and payload; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"),
        "html": payload.decode() if kind == "response" else None,
    }


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def index_entries(source: Ranges, members: dict[str, tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """`(archive member, offset, length)` of every record that an index under `indexes/` names. A line
    may have a sort key before its JSON; one without a file name means the package's only archive.
    Indexes may be gzip files; other files than indexes of records (`.cdx`, `.cdxj`) are passed over."""
    archives = [n for n in members if n.startswith(ARCHIVES) and not n.endswith("/")]
    for name in sorted(members):
        if not name.startswith(INDEXES) or not name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            continue
        data = source.read(*stored(members, name))
        for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines():
            if "{" not in line:
                continue
            entry = json.loads(line[line.index("{") :])
            member = ARCHIVES + entry["filename"].removeprefix(ARCHIVES) if "filename" in entry else None
            if member is None and len(archives) == 1:
                member = archives[0]
            if member not in members:
                raise ValueError(f"{name}: a record lies in {entry.get('filename', 'no named archive')}, which the package lacks")
            yield member, int(entry["offset"]), int(entry["length"])


def walk(source: Ranges, at: int, size: int) -> Iterator[bytes]:
    """The records of an archive in order, a gzip member each, read in chunks."""
    unpack, parts, rest, end = zlib.decompressobj(31), [], b"", at + size
    while rest or at < end:
        if not rest:
            rest = source.read(at, min(CHUNK, end - at))
            at += len(rest)
        parts.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def records(source: Ranges) -> Iterator[bytes]:
    """Every record of a package, once: those that indexes name by their ranges, then the archives that
    no index names from end to end. A package without archives has none."""
    members, seen = directory(source), set()
    for member, offset, length in dict.fromkeys(index_entries(source, members)):
        at, size = stored(members, member)
        if offset + length > size:
            raise ValueError(f"{member}: a record at {offset}+{length} lies outside its {size} bytes")
        seen.add(member)
        yield zlib.decompress(source.read(at + offset, length), 31)
    for member in sorted(members):
        if member.startswith(ARCHIVES) and member.endswith(".warc.gz") and member not in seen:
            yield from walk(source, *stored(members, member))


def read(packages: DataFrame, with_html: bool = False) -> DataFrame:
    """Every record of the listed packages (`path`), a task per package.

    Only directories, indexes and the records' own ranges are read; archives that no index names are
    read from end to end. The list is read twice, so store it first. An empty list has no records.
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + ["html"] * with_html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            system, name = _open(path)
            with system.open_input_file(name) as file:
                rows = []
                for data in records(Ranges(file, file.size())):
                    rows.append(parse(data))
                    if len(rows) == common.BATCH_ROWS:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    # Ranges of paths, as many as there are packages: adaptive execution leaves a stated number alone.
    listed = packages.select("path").repartitionByRange(max(1, packages.count()), "path")
    return common.map_batches(listed, run, RECORD + ", html string" * with_html)


_TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES.get(n, pa.string())) for n in names], names)
