"""WARC records in ZIP packages: writer and range reader.

A package is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member per WARC record, and ``indexes/index.cdxj``, one line per record
with its place.  The reader never extracts a package: it reads the end of the file,
follows the ZIP64 locator where there is one, parses the central directory, finds
the stored archive members and their indexes, and then reads byte ranges of records.
Archives without an index are walked record by record.  Deflated members cannot be
range-read and raise an error.

Spark deals the work: pages are written by task into packages of bounded size, the
manifest of which is a written table (files of lost or repeated tasks are not in it);
directories are read one package per row, and the record ranges they give are dealt
anew, so a large package is read by many tasks.

Defined results: a NULL payload is empty; a NULL URL is left out; among equal payloads
of at least ``MIN_REVISIT`` bytes the smallest page id is the response (all rows of
that id, if repeated) and the others revisit it, rows without an id included; an
empty table writes no package and reads no record; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import shuffle_partitions, stage
from cohortlab.session import scratch_path

MIN_REVISIT = 100
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records -------------------------------------------------------------------
def record(page_id, url, payload: bytes, digest: str, refers_to, size: int, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_id(page_id)}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{_id(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _id(page_id) -> str:
    return "" if page_id is None else str(page_id)


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-case names) and the block's HTTP header and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"fields": fields, "payload": payload, "http_length": sizes[0] if sizes else len(payload)}


# -- packages: writing -------------------------------------------------------------
def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Package:
    """One ZIP package being written to a stream."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, at = _filesystem(self.path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, key: str, raw: bytes, kind: str) -> None:
        z = gzip.compress(raw, compresslevel=1, mtime=0)
        self.member.write(z)
        self.lines.append(f"{key} {json.dumps({'offset': self.at, 'length': len(z), 'type': kind})}\n")
        self.at += len(z)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines).encode())
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, len(self.lines)


def write_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
                html: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every page as a WARC record; returns the manifest ``(path, size, records)``."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                     F.coalesce(html, F.lit("")).alias("html"))
    p = p.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    large = stage(p.filter(F.col("size") >= MIN_REVISIT).select("page_id", "digest"), "warc-digests")
    firsts = stage(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
                   .filter("n > 1 AND refers_to IS NOT NULL").select(F.col("digest").alias("d"), "refers_to"), "warc-firsts")
    revisits = (large.join(firsts, F.col("digest") == F.col("d"))
                .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct())
    rows = p.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest",
                       "size", "refers_to")

    def run(batches):
        done, pkg = [], None
        for b in batches:
            for r in b.to_pylist():
                if pkg is None:
                    pkg = _Package(folder)
                revisit = r["refers_to"] is not None
                raw = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], r["size"], revisit)
                pkg.add(_id(r["page_id"]) or "-", raw, "revisit" if revisit else "response")
                if pkg.at >= package_bytes:
                    done.append(pkg.close())
                    pkg = None
        if pkg is not None:
            done.append(pkg.close())
        cols = list(zip(*done)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "records"])

    return stage(rows.mapInArrow(run, "path string, size long, records long"), "warc-manifest")


# -- packages: reading ---------------------------------------------------------------
def zip_members(read, size: int) -> list[dict]:
    """Members of a ZIP file from its central directory; ``read(offset, length)`` reads a range."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack("<HII", tail[at + 10:at + 20])
    if tail_at + at >= 20:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            end = read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack("<QQQ", end[32:56])
    data, out, p = read(start, length), [], 0
    for _ in range(count):
        if data[p:p + 4] != b"PK\x01\x02":
            raise ValueError("the ZIP central directory is damaged")
        flags, method = struct.unpack("<HH", data[p + 8:p + 12])
        crc, packed, plain, n, m, k = struct.unpack("<IIIHHH", data[p + 16:p + 34])
        (local,) = struct.unpack("<I", data[p + 42:p + 46])
        name = data[p + 46:p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[p + 46 + n:p + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[e:e + 4])
            if tag == 1:  # ZIP64: eight bytes for each field that is full in the entry, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[e + 4:e + 4 + width // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            e += 4 + width
        out.append({"name": name, "method": method, "packed": packed, "size": plain, "local": local, "crc": crc})
        p += 46 + n + m + k
    return out


def member_start(read, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ValueError(f"member {member['name']} is compressed; only stored members can be range-read")
    head = read(member["local"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member['name']}")
    n, m = struct.unpack("<HH", head[26:30])
    return member["local"] + 30 + n + m


def package_ranges(read, size: int):
    """``(start, lengths)`` of consecutive records, about ``RANGE_BYTES`` each, of all archive members."""
    members = zip_members(read, size)
    index = [m for m in members if m["name"].startswith("indexes/") and m["name"].endswith((".cdxj", ".cdx"))]
    archives = [m for m in members if m["name"].startswith("archive/") and m["name"].endswith((".warc.gz", ".warc"))]
    known: dict[str, list[tuple[int, int]]] = {}
    for m in index:
        text = read(member_start(read, m), m["size"])
        if zlib.crc32(text) != m["crc"]:
            raise ValueError(f"checksum of {m['name']}")
        for line in text.decode().splitlines():
            x = json.loads(line[line.index("{"):])
            name = "archive/" + x["filename"] if "filename" in x else archives[0]["name"]
            known.setdefault(name, []).append((int(x["offset"]), int(x["length"])))
    for m in archives:
        start = member_start(read, m)
        places = sorted(known[m["name"]]) if m["name"] in known else list(walk(read, start, m["size"], m["name"]))
        if m["name"] in known and sum(n for _, n in places) != m["size"]:
            raise ValueError(f"the index of {m['name']} does not cover it")
        held: list[int] = []
        first = 0
        for offset, n in places:
            if not held:
                first = offset
            held.append(n)
            if sum(held) >= RANGE_BYTES:
                yield start + first, held
                held = []
        if held:
            yield start + first, held


def walk(read, start: int, size: int, name: str):
    """Places of the records of an archive member that has no index."""
    at = 0
    while at < size:
        if name.endswith(".gz"):
            d, n = zlib.decompressobj(31), 0
            while not d.eof:
                part = read(start + at + n, min(1 << 16, size - at - n))
                if not part:
                    raise ValueError(f"{name} is cut short")
                d.decompress(part)
                n += len(part) - len(d.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                part = read(start + at + len(head), min(1 << 12, size - at - len(head)))
                if not part:
                    raise ValueError(f"{name} is cut short")
                head += part
            head = head[:head.index(b"\r\n\r\n") + 4]
            length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            n = len(head) + length + 4
        yield at, n
        at += n


def _reader(path: str):
    files, at = _filesystem(path)
    f = files.open_input_file(at)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return f, read


def read_records(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the packages ``(path, ...)``: one row each, with its fields and payload digest.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: measured on
    a response (and compared with the record's own digest), declared by a revisit.
    """
    spark = manifest.sparkSession

    def directories(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                f, read = _reader(path)
                with f:
                    ranges = list(package_ranges(read, f.size()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(ranges), pa.string()), pa.array([s for s, _ in ranges], pa.int64()),
                     pa.array([n for _, n in ranges], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    n = shuffle_partitions(spark)
    ranges = (manifest.select("path").repartition(n, "path")
              .mapInArrow(directories, "path string, start long, lengths array<long>").repartition(n, "path", "start"))
    names = ["record_id", "record_type", "uri", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payload]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][:len(names)]

    def records(batches):
        for b in batches:
            for path, start, lengths in zip(*(b.column(c).to_pylist() for c in ("path", "start", "lengths"))):
                f, read = _reader(path)
                with f:
                    data = read(start, sum(lengths))
                rows, at = [], 0
                for n_ in lengths:
                    raw = data[at:at + n_]
                    at += n_
                    rows.append(_row(parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string"
    return ranges.mapInArrow(records, schema + ", payload binary" * payload)


def _row(r: dict) -> tuple:
    f = r["fields"]
    declared = f.get("warc-payload-digest", "").removeprefix("sha256:")
    if f["warc-type"] == "revisit":
        size, digest = r["http_length"], declared
    else:
        size, digest = len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()
        if declared and declared != digest:
            raise ValueError(f"payload digest of {f.get('warc-record-id')}")
    bare = lambda x: x.strip("<>") if x else None
    return (bare(f.get("warc-record-id")), f["warc-type"], f.get("warc-target-uri"), bare(f.get("warc-refers-to")), size,
            digest, r["payload"])


def page_of(column: str):
    """The page id of a record id written by ``write_pages``."""
    return F.nullif(F.substring_index(column, ":", -1), F.lit("")).cast("long")
