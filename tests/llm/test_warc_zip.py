import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from boxrates.llm import warc_zip as W
from boxrates.session import work_dir

LONG = "<p>" + "text " * 40 + "</p>"
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG + "é"), (4, "u\r\nX: y", ""), (5, "u", None),
    (6, "u", "short"), (7, "u", "short"), (8, "u", "a\r\n\r\nb" * 50), (9, "u", "x" * 300_000), (10, "u", "x" * 300_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, n int")


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        lead = first.get(html or "")
        again = len(raw) >= 100 and lead is not None and lead != i
        kind = "revisit" if again else "response"
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), kind, lead if again else None, True))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark):
    assert found(W.archived(pages(spark, ROWS).repartition(3), member_bytes=1000, package_bytes=5000)) == brute(ROWS)


def test_repeats_nulls_and_empty_table(spark):
    rows = [*ROWS, *ROWS[:3], (None, None, LONG), (None, None, "y" * 200), (None, None, "y" * 200)]
    assert found(W.archived(pages(spark, rows))) == brute(rows)
    assert W.archived(pages(spark, [])).count() == 0


def test_hot_payload(spark):
    rows = [(i, "u", LONG if i % 3 else LONG + str(i)) for i in range(500)]
    assert found(W.archived(pages(spark, rows).repartition(6))) == brute(rows)


class Bytes:
    """A file of bytes that notes what is read of it."""

    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def read_at(self, n, offset):
        assert 0 <= offset and offset + n <= len(self.raw)
        self.read += n
        return self.raw[offset : offset + n]


def archive(members, note=b"", method=zipfile.ZIP_STORED, zip64=False):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in members.items():
            with z.open(name, "w", force_zip64=zip64) as file:
                file.write(data)
        z.comment = note
    return raw.getvalue()


@pytest.mark.parametrize("note", [b"", b"a note", b"PK\x05\x06 in a note of some length"])
@pytest.mark.parametrize("zip64", [False, True])
def test_directory_and_members(note, zip64):
    members = {"archive/a.warc": b"abc" * 50_000, "indexes/ü.jsonl": b"{}", "empty": b""}
    raw = archive(members, note, zip64=zip64)
    file = Bytes(raw)
    listed = W.directory(file, len(raw))
    assert [m.name for m in listed] == list(members)
    for m in listed:
        start = W.data_start(file, m)
        assert raw[start : start + m.size] == members[m.name]
    assert file.read < 70_000  # the large member was not read


def test_zip64_directory(monkeypatch):
    """Records of ZIP64, which real archives have beyond 65,535 members or 4 GB."""
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    members = {f"m{i}": b"data" * 10 + bytes([i]) for i in range(5)}
    raw = archive(members, zip64=True)
    assert W.LOCATOR64 in raw
    listed = W.directory(Bytes(raw), len(raw))
    assert {m.name: raw[(s := W.data_start(Bytes(raw), m)) : s + m.size] for m in listed} == members


def test_what_cannot_be_read_in_place_is_refused():
    with pytest.raises(W.ZipError):
        W.directory(Bytes(b"no archive"), 10)
    raw = archive({"a": b"abc" * 100}, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(W.ZipError):
        W.data_start(Bytes(raw), W.directory(Bytes(raw), len(raw))[0])


def test_reads_are_joined_but_bounded():
    rows = [("p", 0, 10), ("p", 10, 10), ("q", 0, 5), ("p", 10_000_000, 3)]
    assert [r[:3] for r in W.ranges(rows)] == [("p", 0, 20), ("p", 10_000_000, 10_000_003), ("q", 0, 5)]
    assert list(W.ranges([])) == []


def test_packages_are_stored_and_indexed(spark):
    folder = work_dir(spark, "wacz")
    one = pages(spark, ROWS).coalesce(1)  # a package holds what a partition does
    names = [r.package for r in W.write_archives(one, folder, member_bytes=1000).collect()]
    system, base = W.filesystem(folder)
    for name in names:
        with system.open_input_file(f"{base}/{name}") as file:
            z = zipfile.ZipFile(pa.PythonFile(file, "r"))
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert len(z.namelist()) > 2 and z.testzip() is None
