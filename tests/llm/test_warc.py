import gzip
import hashlib
import io
import os
import struct
import zipfile
import zlib

import pytest

from cohortlab.llm import warc as w

BIG = "<html>" + "x" * 200 + "é</html>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (3, None, "small"), (4, "http://a/ 4\n", "small"),
         (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "y" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id long, url string, html string, size int, digest string")


def test_round_trip(pages):
    man = w.write_pages(pages.repartition(3))
    got = sorted(((w_["p"], w_["record_type"], w_["r"], w_["payload_bytes"], w_["payload_digest"], w_["payload"]) for w_ in
                  w.read_records(man, payload=True).select("*", w.page_of("record_id").alias("p"), w.page_of("refers_to").alias("r"))
                  .collect()), key=str)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(body) >= 100 else i
        revisit = len(body) >= 100 and i != first
        want.append((i, "revisit" if revisit else "response", first if revisit else None, len(body),
                     hashlib.sha256(body).hexdigest(), b"" if revisit else body))
    assert got == sorted(want, key=str)


def test_many_small_packages_and_ranges(pages, monkeypatch):
    monkeypatch.setattr(w, "RANGE_BYTES", 50)
    man = w.write_pages(pages.coalesce(1), package_bytes=200)
    assert man.count() > 1 and w.read_records(man).count() == len(PAGES)
    assert man.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_no_pages(pages):
    man = w.write_pages(pages.limit(0))
    assert man.count() == 0 and w.read_records(man).count() == 0


def zip64(members):
    """A ZIP file all of whose sizes and offsets stand in ZIP64 fields."""
    out, entries = io.BytesIO(), []
    for name, data in members:
        at, n = out.tell(), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1, len(n), len(extra)))
        out.write(n + extra + data)
        entries.append((n, data, at))
    start = out.tell()
    for n, data, at in entries:
        extra = struct.pack("<HHHH", 0x7777, 4, 1, 2) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        out.write(b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1,
                                             len(n), len(extra), 0, 0, 0, 0, 2**32 - 1) + n + extra)
    end = out.tell()
    out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(entries), len(entries), end - start, start))
    out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
    out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 3) + b"end")
    return out.getvalue()


def record(i):
    body = f"page {i}".encode()
    return w.record(i, f"http://a/{i}", body, hashlib.sha256(body).hexdigest(), None, len(body), False)


@pytest.mark.parametrize("packed", [True, False])
def test_zip64_and_archives_without_an_index(spark, tmp_path, packed):
    data = b"".join(gzip.compress(record(i)) if packed else record(i) for i in range(5))
    p = tmp_path / "x.wacz"
    p.write_bytes(zip64([("datapackage.json", b"{}"), (f"archive/a.warc{'.gz' if packed else ''}", data)]))
    man = spark.createDataFrame([(str(p),)], "path string")
    got = {r["record_id"]: r["payload_bytes"] for r in w.read_records(man).collect()}
    assert got == {f"urn:page:{i}": 6 for i in range(5)}


def test_damage_is_an_error(tmp_path):
    def ranges(path):
        data = open(path, "rb").read()
        return list(w.package_ranges(lambda a, n: data[a:a + n], len(data)))

    p = tmp_path / "x.wacz"
    with zipfile.ZipFile(p, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", record(1) * 50)
    with pytest.raises(ValueError, match="compressed"):
        ranges(p)
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("archive/data.warc.gz", gzip.compress(record(1))[:-9])
    with pytest.raises(ValueError, match="cut short"):
        ranges(p)
    p.write_bytes(os.urandom(100))
    with pytest.raises(ValueError):
        ranges(p)
    with pytest.raises(ValueError, match="digest"):
        w._row(w.parse_record(record(1).replace(b"page 1", b"page 2")))
