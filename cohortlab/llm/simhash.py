"""SimHash near duplicates with pivot distance tables.

A document's fingerprint has a bit set where over half of its shingles' hashes do.
Fingerprints within ``bits`` differing bits are linked; a document's class is the
smallest id reachable over links.

1. Documents with equal fingerprints are one row (fingerprint, smallest id).
2. A pair within 3 bits leaves at least two of five blocks untouched, so it shares
   one of the ten keys made of two blocks: a lossless partition of the pairs.
3. Within a key, every fingerprint has a row of Hamming distances to ``PIVOTS``
   reference fingerprints. By the triangle inequality two fingerprints whose
   distances to any reference differ by more than ``bits`` are no pair: members are
   sorted by the first coordinate, only the window of ``+-bits`` around a member is
   looked at, the largest coordinate difference discards, and survivors are verified
   bit by bit. A member reached once leaves the search, so a dense group costs about
   its size, and one link per reached member is written instead of all pairs.
4. A key with more than ``GROUP`` fingerprints is never gathered: its members are
   grouped by the points of the Hamming space next to them (every pair within 3 bits
   has a point within 1 bit of one and 2 bits of the other; at most 2,146 distinct
   fingerprints can meet at a point), which is exact as well.
5. Connected components over the links.

Pivot coordinates alone cannot partition the pairs: for random 64-bit values each
coordinate keeps 46 % of all pairs, whence the blocks of step 2.

Defined results: NULL, empty and word-free texts have fingerprint zero and are
linked like any other; repeated rows are one class and all returned; rows with a
NULL id take part and are returned (their id never names a class unless alone);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import components, release_memory, row_key, shuffle_partitions, slices, stage

SHINGLE = 3
BITS = 3
BLOCKS = 5
PIVOTS = 16
GROUP = 20_000
#: widths of the blocks, 64 bits together
_WIDTHS = [13, 13, 13, 13, 12]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as a signed 64-bit integer."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    grams = [w[i:] for i in range(min(shingle, len(w)))]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*grams)), itertools.repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, row_key)`` per input row."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), row_key(F.col(text)).alias("row_key"))

    def run(batches):
        for b in batches:
            t = b.column("t")
            fps = [fingerprint(x, shingle) for lo, hi in slices(t) for x in t.slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), b.column("row_key")],
                                             names=["doc_id", "fp", "row_key"])
            release_memory()

    return d.mapInArrow(run, "doc_id long, fp long, row_key long")


def _block_keys(bits: int):
    """One key column per pair of blocks: the pair's number and the two blocks' bits."""
    if not 0 <= bits <= BLOCKS - 2:
        raise ValueError(f"fingerprints are linked at up to {BLOCKS - 2} differing bits")
    ends = np.cumsum([0, *_WIDTHS])
    blocks = [F.shiftrightunsigned("fp", int(a)).bitwiseAND(F.lit((1 << int(b - a)) - 1))
              for a, b in zip(ends, ends[1:])]
    keys = [F.shiftleft(F.shiftleft(blocks[i], 13).bitwiseOR(blocks[j]), 4).bitwiseOR(F.lit(k))
            for k, (i, j) in enumerate(itertools.combinations(range(BLOCKS), 2))]
    return F.explode(F.array(*keys))


def references(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def link_group(fps: np.ndarray, bits: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """A link per fingerprint reached from another of the group (spanning its components)."""
    if len(fps) == 2:
        a, b = fps.tolist()
        return [(a, b)] if (a ^ b).bit_count() <= bits else []
    x = np.unique(fps)
    table = np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    x, table = x[order], table[order]
    first = table[:, 0].copy()
    left = np.ones(len(x), bool)
    out = []
    for root in range(len(x)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            lo, hi = np.searchsorted(first, [first[i] - bits, first[i] + bits + 1])
            near = lo + np.flatnonzero(left[lo:hi])
            near = near[np.abs(table[near] - table[i]).max(axis=1, initial=0) <= bits]
            near = near[np.bitwise_count(x[near] ^ x[i]) <= bits]
            left[near] = False
            todo.extend(near.tolist())
            out.extend((int(x[i]), int(x[j])) for j in near)
    return out


def links(fps: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` that connect every component of fingerprints within ``bits`` bits.

    ``fps`` has one row per distinct fingerprint.
    """
    spark = fps.sparkSession
    keyed = fps.select("fp", _block_keys(bits).alias("key"))
    sizes = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    pivots = references()

    def run(batches):
        held, key = [], None
        done = lambda: link_group(np.concatenate(held), bits, pivots) if held else []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("key").to_numpy()
            v = b.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                if k[lo] != key:
                    out += done()
                    held, key = [], k[lo]
                held.append(v[lo:hi])
            yield _pairs(out)
        yield _pairs(done())

    small = keyed.join(sizes.filter(F.col("n") <= group), "key").select("key", "fp")
    small = small.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(
        run, "a long, b long")
    big = keyed.join(sizes.filter(F.col("n") > group), "key").select("fp").distinct()
    return small.union(_links_by_point(big, bits))


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])


def _links_by_point(fps: DataFrame, bits: int) -> DataFrame:
    """The same links by meeting points, for fingerprints of keys that are too large to gather.

    Whatever is within ``bits // 2`` bits of a point is linked to whatever is within
    ``bits - bits // 2`` bits of it.
    """
    near = bits // 2
    # flips of up to two bits: the pairs (i, j) of 0..64, where 64 flips nothing
    bit = lambda c: F.when(F.col(c) < 64, F.expr(f"shiftleft(1L, {c})")).otherwise(F.lit(0))
    flips = (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
             .select("fp", "i", F.explode(F.sequence("i", F.lit(64))).alias("j"))
             .filter("i < j OR i = 64"))
    points = flips.select(
        F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("p"), "fp",
        F.when(F.col("i") == 64, 0).when(F.col("j") == 64, 1).otherwise(2).alias("n")).filter(F.col("n") <= bits - near)
    points = points.withColumn("close", F.col("n") <= near)
    hubs = points.filter("close").groupBy("p").agg(F.min("fp").alias("hub"))
    return points.join(hubs, "p").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS, group: int = GROUP) -> DataFrame:
    """``(doc_id, fp, component_id, row_key, root)`` per input row.

    ``root`` tells classes apart (two classes may hold the same smallest id, where an id
    has several texts), ``row_key`` rows of one id.
    """
    rows = stage(fingerprints(docs, doc_id, text, shingle), "simhash-docs")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    roots = stage(components(links(fps.select("fp"), bits, group)), "simhash-roots")
    tied = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = stage(tied.join(least, "root").select(F.col("fp").alias("c_fp"), "root", "component_id"), "simhash-classes")
    return rows.join(ids, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id", "row_key", "root")


def keep_first(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class that has an id: the smallest id, of its texts the one with the smallest key.

    Equal rows count as copies, so one of them stays; rows that share an id with another
    text belong to their own texts' classes.  Rows without an id stay.
    """
    one = (classes.filter("doc_id IS NOT NULL").groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("n"))
           .groupBy("root").agg(F.min(F.struct("doc_id", "row_key", "n")).alias("m"))
           .select(F.col("m.doc_id").alias("__first"), F.col("m.row_key").alias("__key"), F.col("m.n").alias("__n")))
    d = docs.withColumn("__row_key", row_key(F.col(text)))
    same = (d[doc_id].cast("long") == F.col("__first")) & (d["__row_key"] == F.col("__key"))
    once = d.join(one.filter("__n = 1"), same, "left_semi")
    # of equal rows, which are rare, one stays: only these are compared
    several = d.join(one.filter("__n > 1"), same, "left_semi").dropDuplicates([doc_id, "__row_key"])
    return once.unionByName(several).drop("__row_key").unionByName(docs.filter(docs[doc_id].isNull()))
