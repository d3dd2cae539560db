"""Exact repeated passages across documents by fixed-block anchors.

A word goes when a window of ``window`` words that covers it also starts in a
document with a smaller id.  With blocks of ``block = (window + 1) // 2`` words, any
window holds a whole block of its document's grid, so two documents that share a
window share a block of one that is a rolling window of the other:

1. Index and probe.  The hashes of all rolling block-long windows meet in buckets,
   those on their own document's grid marked as index entries.  A hash is live when
   it is an index entry and occurs in two places.
2. Extend.  A window that touches a live anchor is a candidate; the 96-bit hashes of
   candidates meet again, and whoever is not the smallest document that holds one is
   told.  Neighbouring windows that repeat make up the maximal repeat, so the words
   to drop are the union of the windows.
3. Cut.  Each document drops the words its repeated windows cover.

Documents are cut into slices of some megabytes, written once, compressed.  A slice
sends its distinct hashes per bucket in a fixed order (sorted differences in step 1)
and gets one bit per hash back, so little but the compressed text moves; what
documents of one slice share is settled inside it, so a passage in a third of all
documents stays small.  The number of buckets follows the size of the texts.
Documents that equal a smaller one take no part in step 2: all they have goes.  No
pairs of documents are formed.

Defined results: NULL and blank texts have no words; texts shorter than a window
keep everything; repeated rows (equal ids) never remove each other's words; a NULL
id counts as larger than any other; an empty table gives an empty result; columns
other than the id and text are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import release_memory, shuffle_partitions, slices, stage

WINDOW = 13
#: words whose hashes meet in one bucket, on average
BUCKET_WORDS = 2_000_000
SLICE_BYTES = 6 << 20
NO_ID = (1 << 63) - 1
_ODD = np.random.default_rng(13).integers(1, 1 << 63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word and each text's offsets."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64,
                      len(coded.dictionary))
    code = coded.indices.to_numpy()
    blank = np.fromiter((not w for w in coded.dictionary.to_pylist()), bool, len(own))
    real = ~blank[code] if len(code) else np.zeros(0, bool)
    n = np.concatenate([[0], np.cumsum(real)])
    return own[code[real]], n[at]


def rolling(h: np.ndarray, k: int, row: int) -> np.ndarray:
    """Hash of every run of ``k`` words (the caller leaves out runs that cross texts)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j:len(h) - k + 1 + j] * _ODD[row, j]
    out ^= out >> np.uint64(32)
    out *= _ODD[2, row]
    out ^= out >> np.uint64(29)
    return out


def _starts(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run of ``k`` words lies inside its text, and the texts' numbers."""
    n = np.maximum(np.diff(at) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + at[:-1][doc], doc


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First rows of runs of equal rows (sorted input)."""
    first = np.ones(len(columns[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def _cuts(sorted_values: np.ndarray):
    """``(value, lo, hi)`` of the runs of a sorted integer array."""
    at = [*np.flatnonzero(_runs(sorted_values)).tolist(), len(sorted_values)]
    return [(int(sorted_values[lo]), lo, hi) for lo, hi in zip(at, at[1:])]


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzip(z: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), dtype)


class Slice:
    """One slice of documents with the hashes that every step needs again."""

    def __init__(self, a: Anchors, ids: np.ndarray, z: bytes, lens: np.ndarray):
        self.a, self.ids = a, ids
        raw = zstandard.ZstdDecompressor().decompress(z)
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        self.texts = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        self.h, self.at = word_hashes(self.texts)
        self.doc_of = np.repeat(np.arange(len(ids)), np.diff(self.at))

    @cached_property
    def anchors(self):
        """Distinct anchor keys in order, whether each is on a grid and in several documents; and where they are."""
        pos, doc = _starts(self.at, self.a.block)
        key = self.a.key(rolling(self.h, self.a.block, 0)[pos])
        grid = (pos - self.at[:-1][doc]) % self.a.block == 0
        order = np.argsort(key, kind="stable")
        key, doc, grid = key[order], doc[order], grid[order]
        first = _runs(key)
        run = np.cumsum(first) - 1
        n = int(first.sum())
        on_grid = np.bincount(run[grid], minlength=n) > 0
        shared = np.bincount(run[doc != doc[first][run]], minlength=n) > 0
        return key[first], on_grid, shared, pos[order], run

    def candidates(self, live: np.ndarray, copies: np.ndarray):
        """Windows that touch a live anchor: hashes, documents and positions in sending order.

        Sorted by bucket and document; ``mine`` marks the smallest document's one of each
        hash in the slice, ``late`` those behind it.
        """
        key, _, shared, pos, run = self.anchors
        hit = np.zeros(len(self.h) + 1, np.int64)
        hit[pos[(live | shared)[run]]] = 1
        reach = np.concatenate([[0], np.cumsum(hit)])
        w, d = _starts(self.at, self.a.window)
        keep = reach[w + self.a.window - self.a.block + 1] > reach[w]
        keep &= ~copies[d]
        w, d = w[keep], d[keep]
        x = rolling(self.h, self.a.window, 0)[w]
        y = (rolling(self.h, self.a.window, 1)[w] >> np.uint64(32)).astype("<u4")
        ids = self.ids[d]
        order = np.lexsort((ids, y, x))
        x, y, ids, w = x[order], y[order], ids[order], w[order]
        first = _runs(x, y)
        run = np.cumsum(first) - 1
        late = ids > ids[first][run]
        bucket = (x[first] >> np.uint64(64 - self.a.bits)).astype(np.int64)
        send = np.lexsort((ids[first], bucket))
        return bucket[send], x[first][send], y[first][send], ids[first][send], send, run, late, w

    def gone(self, live: np.ndarray, copies: np.ndarray, told: list[tuple[int, bytes]]) -> np.ndarray:
        """Which words go, from the bits that came back for the candidates."""
        bucket, _, _, _, send, run, late, w = self.candidates(live, copies)
        bits = np.zeros(len(bucket), bool)
        for q, b in told:
            lo, hi = np.searchsorted(bucket, [q, q + 1])
            bits[lo:hi] = np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo)
        back = np.zeros(len(bucket), bool)
        back[send] = bits
        starts = w[late | back[run]]
        edge = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.a.window, -1)
        out = np.cumsum(edge[:-1]) > 0
        whole = copies & (np.diff(self.at) >= self.a.window)
        return out | whole[self.doc_of]


class Anchors:
    def __init__(self, window: int = WINDOW, buckets: int = 64):
        self.window, self.block = window, (window + 1) // 2
        self.bits = max(1, int(buckets - 1).bit_length())

    def key(self, h: np.ndarray) -> np.ndarray:
        """Bucket and remainder of an anchor hash: its first ``bits + 30`` bits."""
        return h >> np.uint64(64 - self.bits - 30)

    def live_of(self, keys: np.ndarray, told: list[tuple[int, bytes]]) -> np.ndarray:
        """A slice's live anchors from the bits that came back per bucket."""
        out = np.zeros(len(keys), bool)
        bucket = (keys >> np.uint64(30)).astype(np.int64)
        for q, b in told:
            lo, hi = np.searchsorted(bucket, [q, q + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo)
        return out


def pack_anchors(keys: np.ndarray, grid: np.ndarray, shared: np.ndarray) -> bytes:
    """Sorted remainders as differences: low halves plain, high halves (mostly zero) compressed, then flags."""
    d = np.diff(keys & np.uint64((1 << 30) - 1), prepend=np.uint64(0)).astype("<u4")
    high = _zip((d >> 16).astype("<u2"))
    return (len(d).to_bytes(4, "little") + len(high).to_bytes(4, "little") + high + (d & 0xFFFF).astype("<u2").tobytes()
            + np.packbits(grid).tobytes() + np.packbits(shared).tobytes())


def unpack_anchors(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = int.from_bytes(b[:4], "little"), int.from_bytes(b[4:8], "little")
    high = _unzip(b[8:8 + k], "<u2").astype(np.uint32)
    low = np.frombuffer(b, "<u2", n, 8 + k)
    flags = np.frombuffer(b, np.uint8, offset=8 + k + 2 * n)
    half = (n + 7) // 8
    bits = lambda x: np.unpackbits(x, count=n).astype(bool)
    return np.cumsum((high << 16) | low, dtype=np.uint32), bits(flags[:half]), bits(flags[half:])


def live_bits(packed: list[bytes]) -> list[np.ndarray]:
    """Per sender of a bucket, which of its hashes are index entries that occur in two places."""
    parts = [unpack_anchors(b) for b in packed]
    rem, grid, shared = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(rem, kind="stable")
    first = _runs(rem[order])
    run = np.cumsum(first) - 1
    live = (np.bincount(run, grid[order]) > 0) & ((np.bincount(run) > 1) | (np.bincount(run, shared[order]) > 0))
    out = np.empty(len(rem), bool)
    out[order] = live[run]
    return np.split(out, np.cumsum([len(r) for r, _, _ in parts])[:-1])


def late_bits(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per sender of a bucket, which of its windows a smaller document holds."""
    x, y, ids = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, y, x))
    first = _runs(x[order], y[order])
    own = ids[order]
    out = np.empty(len(x), bool)
    out[order] = own > own[first][np.cumsum(first) - 1]
    return np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])


_SLICE = "slice long, ids binary, z binary, lens binary, hashes binary"


def slice_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written table of slices: comparison ids, compressed texts, their lengths and hashes."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k"),
                    F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("t"), SLICE_BYTES):
                ids = b.column("k").slice(lo, hi - lo).to_numpy().astype("<i8")
                raw = [t.as_buffer().to_pybytes() for t in b.column("t").slice(lo, hi - lo)]
                hashes = b"".join(map(xxhash.xxh3_128_digest, raw))
                row = (xxhash.xxh64_intdigest(ids.tobytes() + hashes) >> 1, ids.tobytes(),
                       zstandard.ZstdCompressor(level=1).compress(b"".join(raw)),
                       np.fromiter(map(len, raw), "<u4", len(raw)).tobytes(), hashes)
                yield _batch([row], _SLICE)

    # a slice of repeated rows may come twice; a number tells the two apart
    rows = d.mapInArrow(run, _SLICE).withColumn("slice", F.xxhash64("slice", F.monotonically_increasing_id()))
    return stage(rows, "substring-slices")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _bucketed(batches, columns: list[str]):
    """Rows of each bucket (sorted input) as tuples of the columns."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in columns)):
            if held and r[0] != held[0][0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _told(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _pairs(rows) -> list[tuple[int, bytes]]:
    return [(r["bucket"], r["bits"]) for r in rows or []]


def copies_of_smaller(table_: DataFrame) -> DataFrame:
    """``(slice, copies)``: numbers of a slice's documents whose whole text a smaller document has."""
    def explode(batches):
        for b in batches:
            for s, ids, hashes in zip(*(b.column(c).to_pylist() for c in ("slice", "ids", "hashes"))):
                k = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(k), pa.int64()), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(k),
                     pa.array([hashes[i:i + 16] for i in range(0, len(hashes), 16)], pa.binary())],
                    names=["slice", "n", "k", "h"])

    rows = table_.select("slice", "ids", "hashes").mapInArrow(explode, "slice long, n int, k long, h binary")
    least = stage(rows.groupBy("h").agg(F.min("k").alias("least"), F.count("*").alias("c")).filter("c > 1")
                  .select(F.col("h").alias("g"), "least"), "substring-copies")
    return (rows.join(least, F.col("h") == F.col("g")).filter("k > least")
            .groupBy("slice").agg(F.collect_list("n").alias("copies")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row; ``kept`` holds the remaining words, one space between."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), total // (5 * BUCKET_WORDS))
    a = Anchors(window, 1 << int(buckets - 1).bit_length())
    n = max(shuffle_partitions(spark), 1 << a.bits)
    table_ = slice_table(docs, doc_id, text)
    copies = copies_of_smaller(table_)

    def slices_of(batches, *told: str):
        for b in batches:
            for r in b.to_pylist():
                s = Slice(a, np.frombuffer(r["ids"], "<i8"), r["z"], np.frombuffer(r["lens"], "<u4"))
                own = np.zeros(len(s.ids), bool)
                own[r.get("copies") or []] = True
                yield r["slice"], s, own, *[_pairs(r.get(t)) for t in told]
            release_memory()

    def send_anchors(batches):
        for i, s, _ in slices_of(batches):
            key, grid, shared, _, _ = s.anchors
            rows = [(q, i, pack_anchors(key[lo:hi], grid[lo:hi], shared[lo:hi]))
                    for q, lo, hi in _cuts((key >> np.uint64(30)).astype(np.int64))]
            yield _batch(rows, "bucket int, slice long, packed binary")

    def answer_anchors(batches):
        for rows in _bucketed(batches, ["bucket", "slice", "packed"]):
            bits = live_bits([r[2] for r in rows])
            yield _batch([(r[1], r[0], np.packbits(x).tobytes()) for r, x in zip(rows, bits) if x.any()],
                         "slice long, bucket int, bits binary")

    def send_windows(batches):
        for i, s, own, live in slices_of(batches, "live"):
            bucket, x, y, ids, *_ = s.candidates(a.live_of(s.anchors[0], live), own)
            rows = [(q, i, x[lo:hi].astype("<u8").tobytes(), y[lo:hi].tobytes(), _zip(ids[lo:hi].astype("<i8")))
                    for q, lo, hi in _cuts(bucket)]
            yield _batch(rows, "bucket int, slice long, x binary, y binary, ids binary")

    def answer_windows(batches):
        for rows in _bucketed(batches, ["bucket", "slice", "x", "y", "ids"]):
            bits = late_bits([(np.frombuffer(r[2], "<u8"), np.frombuffer(r[3], "<u4"), _unzip(r[4], "<i8")) for r in rows])
            yield _batch([(r[1], r[0], np.packbits(v).tobytes()) for r, v in zip(rows, bits) if v.any()],
                         "slice long, bucket int, bits binary")

    def meet(sent: DataFrame, answer) -> DataFrame:
        return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
            answer, "slice long, bucket int, bits binary")

    plain = table_.select("slice", "ids", "z", "lens")
    anchors = plain.mapInArrow(send_anchors, "bucket int, slice long, packed binary")
    live = _told(meet(anchors, answer_anchors), "live")
    marks = stage(table_.select("slice").join(live, "slice", "left").join(copies, "slice", "left"), "substring-live")
    windows = plain.join(marks, "slice").mapInArrow(send_windows, "bucket int, slice long, x binary, y binary, ids binary")
    late = stage(_told(meet(windows, answer_windows), "late"), "substring-late")

    def cut(batches):
        for _, s, own, live, late in slices_of(batches, "live", "late"):
            gone = s.gone(a.live_of(s.anchors[0], live), own, late)
            rows = []
            for k, t, lo, hi in zip(s.ids.tolist(), s.texts, s.at[:-1].tolist(), s.at[1:].tolist()):
                w = t.as_buffer().to_pybytes().split()
                g = gone[lo:hi]
                m = int(g.sum())
                if m:
                    w = [x for x, y in zip(w, g.tolist()) if not y]
                rows.append((None if k == NO_ID else k, hi - lo, m, b" ".join(w).decode()))
            yield _batch(rows, "doc_id long, n_words long, n_removed long, kept string")

    return plain.join(marks, "slice").join(late, "slice", "left").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string")
