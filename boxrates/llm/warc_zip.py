"""WARC records in ZIP packages, read in place.

A package is a ZIP archive whose members are stored, not compressed: WARC files under
``archive/`` and an index of their records under ``indexes/``. The reader parses the end
record, the ZIP64 records and the central directory, finds where stored members lie,
reads their indexes, and then reads single records by byte range. Nothing is extracted.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of
from boxrates.session import work_dir

MEMBER_BYTES = 4 << 20
PACKAGE_BYTES = 64 << 20
LEAST_REVISITED = 100
READ_GAP = 64 << 10
READ_BYTES = 4 << 20

# Signatures and marks of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = (
    b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04",
)
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED = 0


class ZipError(ValueError):
    """A package that is no ZIP archive, or one whose members can't be read in place."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int
    encrypted: bool


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, ..) and the path in it."""
    return fs.FileSystem.from_uri(uri if ":" in uri.partition("/")[0] else f"file://{uri}")


def directory(file, size: int) -> list[Member]:
    """The members of an archive, by its central directory; ``file`` has ``read_at``."""
    tail_size = min(size, 22 + FULL16)
    tail = file.read_at(tail_size, size - tail_size)
    at = tail.rfind(END)
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ZipError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    position = size - tail_size + at
    if FULL16 == count or FULL32 in (length, offset):
        if position < 20:
            raise ZipError("no ZIP64 locator")
        mark, _, where, _ = struct.unpack("<4sIQI", file.read_at(20, position - 20))
        if mark != LOCATOR64:
            raise ZipError("no ZIP64 locator")
        end64 = file.read_at(56, where)
        if end64[:4] != END64:
            raise ZipError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end64, 32)
    raw = file.read_at(length, offset)
    members, at = [], 0
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ZipError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored_size, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name]
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, stored_size, header = _extended(extra, full, stored_size, header)
        text = name.decode("utf-8" if flags & 0x800 else "cp437")
        members.append(Member(text, method, full, stored_size, header, bool(flags & 1)))
        at += 46 + n_name + n_extra + n_note
    return members


def _extended(extra: bytes, *fields: int) -> list[int]:
    """Size, stored size and place of a member, from its ZIP64 field where they are too large."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            try:
                return [next(wide) if f == FULL32 else f for f in fields]
            except StopIteration:
                raise ZipError("short ZIP64 field") from None
        at += 4 + n
    return list(fields)


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header."""
    if member.method != STORED or member.encrypted:
        raise ZipError(f"{member.name} is not stored plainly")
    local = file.read_at(30, member.header)
    if local[:4] != LOCAL:
        raise ZipError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


# --- records ---------------------------------------------------------------------------


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _field(value) -> str:
    """A value for a header line: no line breaks."""
    return " ".join(str(value).split())


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A response or revisit record with its HTTP headers; a revisit carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ZipError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# --- writing ---------------------------------------------------------------------------


class Package:
    """One archive being written; members are written whole, so each is bounded."""

    def __init__(self, folder: str, member_bytes: int):
        self.system, base = filesystem(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.file = self.system.open_output_stream(f"{base}/{self.name}")
        self.archive = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member_bytes = member_bytes
        self.buffer, self.index, self.members, self.bytes = io.BytesIO(), [], 0, 0

    def add(self, raw: bytes) -> None:
        if self.buffer.tell() and self.buffer.tell() + len(raw) > self.member_bytes:
            self._member()
        self.index.append(
            {"filename": f"data-{self.members}.warc", "offset": self.buffer.tell(), "length": len(raw)}
        )
        self.buffer.write(raw)
        self.bytes += len(raw)

    def _member(self) -> None:
        self._write(f"archive/data-{self.members}.warc", self.buffer.getvalue())
        self.members += 1
        self.buffer = io.BytesIO()

    def _write(self, name: str, data: bytes) -> None:
        self.archive.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)

    def close(self) -> str:
        self._member()
        lines = "".join(json.dumps(entry) + "\n" for entry in self.index)
        self._write("indexes/index.jsonl", lines.encode())
        self.archive.close()
        self.file.close()
        return self.name


def _write(folder: str, member_bytes: int, package_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, package = [], None
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                raw = record(
                    row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["revisit"]
                )
                package = package or Package(folder, member_bytes)
                package.add(raw)
                if package.bytes >= package_bytes:
                    names.append(package.close())
                    package = None
        if package:
            names.append(package.close())
        yield pa.RecordBatch.from_pydict({"package": pa.array(names, pa.string())})

    return write


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    least: int = LEAST_REVISITED,
    member_bytes: int = MEMBER_BYTES,
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write one record per row of ``pages`` (``page_id, url, html``); the packages' names.

    Of records with equal payloads of at least ``least`` bytes, those with the smallest
    ``page_id`` are responses and the others revisits of it. Payloads are compared by SHA-256
    and length; only digests and ids are shuffled for that, and pages are then joined by id
    to what they revisit. ``folder`` must be shared by all machines. A task that is run
    again writes packages anew; only those of finished tasks are named in the result.
    """
    text = text_of("html")
    keyed = pages.select(
        "page_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("n")
    ).filter(F.col("n") >= least)
    first = keyed.groupBy("digest", "n").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    )
    shared = first.filter("copies > 1").drop("copies")
    # Stored, so that Spark knows its size: where few pages revisit, pages stay where they are.
    revisits = stored(
        keyed.join(shared, ["digest", "n"])
        .filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"))
        .agg(F.min("first").alias("refers_to")),
        "revisits",
    )
    whole = pages.select(
        "page_id",
        (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"),
        text.alias("html"),
        F.sha2(text, 256).alias("digest"),
    )
    same = whole["page_id"].eqNullSafe(revisits["_page"]) & (whole["digest"] == revisits["_digest"])
    rows = whole.join(revisits, same, "left").select(
        "page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit")
    )
    write = _write(folder, member_bytes, package_bytes)
    return stored(rows.mapInArrow(write, "package string"), "packages")


# --- reading ---------------------------------------------------------------------------


def _entries(folder: str):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                with system.open_input_file(f"{base}/{name}") as file:
                    members = {m.name: m for m in directory(file, file.size())}
                    starts = {n: data_start(file, m) for n, m in members.items() if n.startswith("archive/")}
                    places, lengths = [], []
                    for index in members.values():
                        if not index.name.startswith("indexes/"):
                            continue
                        for line in file.read_at(index.size, data_start(file, index)).splitlines():
                            entry = json.loads(line)
                            places.append(starts[f"archive/{entry['filename']}"] + entry["offset"])
                            lengths.append(entry["length"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "package": pa.array([name] * len(places), pa.string()),
                        "place": pa.array(places, pa.int64()),
                        "length": pa.array(lengths, pa.int64()),
                    }
                )

    return entries


def read_index(packages: DataFrame, folder: str) -> DataFrame:
    """Where each record of the packages lies: ``package, place, length`` in bytes."""
    spread = packages.repartition("package")
    return spread.mapInArrow(_entries(folder), "package string, place bigint, length bigint")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list]]:
    """Neighbouring records as one read each: package, from, to and the records in it."""
    name, start, end, inside = None, 0, 0, []
    for package, place, length in sorted(rows):
        near = package == name and place - end <= READ_GAP and place + length - start <= READ_BYTES
        if inside and not near:
            yield name, start, end, inside
            inside = []
        if not inside:
            name, start = package, place
        inside.append((place, length))
        end = place + length
    if inside:
        yield name, start, end, inside


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("intact", pa.bool_()),
    ]
)
READ = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, intact boolean"
)


def _whole(text: str | None) -> int | None:
    return None if text is None else int(text)


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            rows, name, file = [], None, None
            columns = [batch.column(c).to_pylist() for c in ("package", "place", "length")]
            for package, start, end, inside in ranges(list(zip(*columns, strict=True))):
                if package != name:
                    name, file = package, system.open_input_file(f"{base}/{package}")
                raw = file.read_at(end - start, start)
                for place, length in inside:
                    headers, payload = parse_record(raw[place - start : place - start + length])
                    kind = headers["WARC-Type"]
                    noted = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    found = hashlib.sha256(payload).hexdigest()
                    own = kind == "response"
                    rows.append(
                        (
                            _whole(headers.get("X-Page-ID")),
                            len(payload) if own else None,
                            found if own else noted,
                            kind,
                            _whole(headers.get("X-Refers-To-Page-ID")),
                            found == noted if own else None,
                        )
                    )
            arrays = list(zip(*rows, strict=True)) or [[] for _ in _READ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, f.type) for a, f in zip(arrays, _READ, strict=True)], schema=_READ
            )

    return read


def read_archives(packages: DataFrame, folder: str) -> DataFrame:
    """Every record of the packages, read by byte range.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``: digests of
    responses are computed from their payloads, and ``intact`` says whether they equal those
    noted. A revisit has no payload of its own; its length is that of the response it
    refers to, found by joining, and ``intact`` is the response's.
    """
    index = read_index(packages, folder)
    spread = index.repartition("package", F.floor(F.col("place") / READ_BYTES))
    records = stored(spread.mapInArrow(_read(folder), READ), "records")
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "intact")
    referred = revisits.select("refers_to", "payload_digest").distinct()
    # Few responses are referred to; the join finds them once, however many refer to them.
    wanted = (
        responses.select(
            F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", "intact"
        )
        .join(referred, ["refers_to", "payload_digest"], "left_semi")
        .dropDuplicates(["refers_to", "payload_digest"])
    )
    resolved = revisits.join(wanted, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(resolved.select(*responses.columns))


def archived(pages: DataFrame, **params) -> DataFrame:
    """``pages`` written to packages in the shared work folder and read back from them.

    - NULL html is the empty payload. NULL ids are written without an id; as NULLs come
      last, they revisit, unless all equal payloads lack an id.
    - Rows that repeat an id and payload are all responses, or all revisits of one id.
    - Payloads below the least length are responses always.
    - Other columns are ignored. An empty table gives an empty table.
    """
    folder = work_dir(pages.sparkSession, "wacz")
    return read_archives(write_archives(pages, folder, **params), folder)
