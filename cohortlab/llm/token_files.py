"""Binary token files: ids in id order, coded in independently reset, checksummed blocks.

File: header, coded blocks, index, footer.

- header (16 bytes): ``TOKMIX01``, then the end id and ``BLOCK`` as unsigned 32-bit;
- block: the output of ``mixing_coder`` for up to ``BLOCK`` ids;
- index (zstd): blocks (offset, bytes, ids, crc32 of the ids), documents (id, whether
  it is NULL, number of ids with the end id);
- footer (24 bytes): offset, bytes and crc32 of the index, then ``TOKMIX01``.

All integers are little-endian; ids are below 65,536, checksums are those of the ids
as unsigned 32-bit integers.

Documents are range-partitioned and sorted by id; every task writes one file, the
written manifest orders the files, and a document's start is the sum of what comes
before it in its file and of the files before.  Files are read back one per row, a
group of blocks at a time; a block or index with a wrong checksum raises.

Defined results: a NULL or empty text is one end id; rows with a NULL id come first;
repeated rows are stored each; an empty table writes no file and reads no row; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from cohortlab.llm import mixing_coder
from cohortlab.llm.common import release_memory, shuffle_partitions, slices, stage
from cohortlab.llm.tokens import encoder
from cohortlab.llm.warc import _filesystem
from cohortlab.session import scratch_path

MAGIC = b"TOKMIX01"
BLOCK = 4096
#: blocks coded side by side
LANES = 1024
END_ID = 0


class _Writer:
    def __init__(self, folder: str, part: int):
        self.path, self.part = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok", part
        files, at = _filesystem(self.path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(at)
        self.out.write(MAGIC + struct.pack("<II", END_ID, BLOCK))
        self.at = 16
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, ids: np.ndarray, doc_ids: list, sizes: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.docs += [(i or 0, i is None, n) for i, n in zip(doc_ids, sizes.tolist())]
        if self.n_held >= BLOCK * LANES:
            self._flush(final=False)

    def _flush(self, final: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK
        for lo in range(0, whole, LANES):
            self._code(ids[lo * BLOCK:min(whole, lo + LANES) * BLOCK].reshape(-1, BLOCK))
        rest = ids[whole * BLOCK:]
        if final and len(rest):
            self._code(rest.reshape(1, -1))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _code(self, rows: np.ndarray) -> None:
        rows = np.ascontiguousarray(rows.astype("<u4"))
        for x, z in zip(rows, mixing_coder.encode(rows)):
            self.out.write(z)
            self.blocks.append((self.at, len(z), len(x), zlib.crc32(x)))
            self.at += len(z)

    def close(self) -> tuple[int, str, int, int]:
        self._flush(final=True)
        body = struct.pack("<QQ", len(self.blocks), len(self.docs)) + np.array(self.blocks, "<i8").tobytes() + np.array(
            self.docs, "<i8").tobytes()
        index = zstandard.ZstdCompressor(level=3).compress(body)
        self.out.write(index + struct.pack("<QII", self.at, len(index), zlib.crc32(index)) + MAGIC)
        self.out.close()
        return self.part, self.path, self.n_ids, len(self.docs)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id",
                 text: str = "text", keep_space: bool = True) -> DataFrame:
    """Write all documents; returns the manifest ``(part, path, n_ids, n_docs)``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    d = d.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("t"))

    def run(batches):
        w = None
        enc = encoder(tokenizer, keep_space)
        for b in batches:
            for lo, hi in slices(b.column("t"), 8 << 20):
                w = w or _Writer(folder, TaskContext.get().partitionId())
                ids, at = enc.encode_documents(b.column("t").slice(lo, hi - lo), END_ID)
                w.add(ids, b.column("doc_id").slice(lo, hi - lo).to_pylist(), np.diff(at))
            release_memory()
        cols = [(x,) for x in w.close()] if w else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            names=["part", "path", "n_ids", "n_docs"])

    return stage(d.mapInArrow(run, "part long, path string, n_ids long, n_docs long"), "tokens-manifest")


class TokenFile:
    """Random access to one file: index, blocks, documents."""

    def __init__(self, path: str):
        files, at = _filesystem(path)
        self.path, self.f = path, files.open_input_file(at)
        tail = self._read(self.f.size() - 24, 24)
        offset, size, crc = struct.unpack("<QII", tail[:16])
        index = self._read(offset, size)
        if tail[16:] != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path}: damaged index")
        body = zstandard.ZstdDecompressor().decompress(index)
        n, m = struct.unpack("<QQ", body[:16])
        x = np.frombuffer(body, "<i8", offset=16)
        self.blocks, self.docs = x[:4 * n].reshape(n, 4), x[4 * n:].reshape(m, 3)

    def _read(self, offset: int, size: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(size)

    def ids(self):
        """All ids, some blocks at a time; blocks of one size are decoded side by side."""
        size = self.blocks[:, 2]
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:]):
            for lo in range(a, b, LANES):
                part = self.blocks[lo:min(b, lo + LANES)]
                raw = self._read(int(part[0, 0]), int(part[-1, 0] + part[-1, 1] - part[0, 0]))
                zs = [raw[o - part[0, 0]:o - part[0, 0] + n] for o, n in part[:, :2].tolist()]
                rows = mixing_coder.decode(zs, int(size[lo])).astype("<u4")
                for x, crc in zip(rows, part[:, 3].tolist()):
                    if zlib.crc32(x) != crc:
                        raise ValueError(f"{self.path}: damaged block")
                yield rows.reshape(-1)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every stored document."""
    spark = manifest.sparkSession
    # one row per file: the files' starts are a running sum over the manifest
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    parts = manifest.select("part", "path", before.alias("first")).repartition(shuffle_partitions(spark), "part")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:len(names)]

    def run(batches):
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                f = TokenFile(path)
                with f.f:
                    held, k, start = np.zeros(0, "<u4"), 0, first
                    for ids in f.ids():
                        held = np.concatenate([held, ids])
                        ends = np.cumsum(f.docs[k:, 2])
                        n = int(np.searchsorted(ends, len(held), "right"))
                        rows, at = [], 0
                        for (i, null, size), end in zip(f.docs[k:k + n].tolist(), ends[:n].tolist()):
                            x = held[at:end]
                            rows.append((None if null else i, start + at, size, zlib.crc32(x), x.tobytes()))
                            at = end
                        held, k, start = held[at:], k + n, start + at
                        cols = list(zip(*rows)) if rows else [()] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                    if len(held) or k < len(f.docs):
                        raise ValueError(f"{path}: ids and documents do not agree")

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
