"""Hard-negative mining: rows of another label that score almost as high as a positive.

The score of two rows is the inner product of their integer vectors.  All scores of the
anchors against all rows are computed in full by the method of the Four Russians: an
anchor's components are taken eight at a time, and a table holds the sums of all 256
subsets of each eight.  A candidate is packed into bit planes (two's complement), eight
dimensions a byte; the byte picks the subset's sum, the sums of a plane are added, shifted
by the plane's weight and added up.  No product is formed, and the scores are exact.

An anchor's positives are its best rows of the same label; for each positive, the negatives
are the best rows of other labels with ``low * positive <= 100 * score <= high * positive``.
Higher scores come first, ties by the smaller id.

Shape: anchors are a stated query set, scored in blocks of at most as many as fit
``TABLE_BYTES``; a block is small, goes to every task, and meets each candidate once (rows
of its labels for the positives, the others for the negatives).  Tasks return the best few
per anchor and positive, which a window reduces.  Candidates are packed once and written;
each block's result is written too, so a lost executor costs part of one block.

Defined results: rows without id, label or vector, or with a NULL or non-finite component,
take no part; shorter vectors end in zeros; repeated rows count once, and of different rows
with one id the smallest by label (as text), then vector, counts; anchors without a positive and
positives without a negative return no row; an empty table gives an empty result.  Components so large that
scores could leave 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import release_memory, shuffle_partitions, stage
from cohortlab.session import scratch_path

#: subset-sum tables of one block of anchors, at most
TABLE_BYTES = 16 << 20
#: candidates and anchors scored at a time
TILE, STRIP = 1024, 256
ROWS_PER_FILE = 1 << 15
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integer_vectors(rows: DataFrame, vec_id: Column, vector: Column, label: Column, scale: int = 256) -> DataFrame:
    """``(id, label, code)``: rows that take part, components ``floor(scale * x)``."""
    d = rows.select(vec_id.cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("v"))
    d = d.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    d = d.filter(whole).select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("code"))
    return (d.groupBy("id").agg(F.min(F.struct("label", "code")).alias("m"))
            .select("id", "m.label", "m.code"))


def pack(codes: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of integer rows: ``(rows, planes, ceil(dims / 8))`` bytes."""
    n, dims = codes.shape
    bits = (codes[:, None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(codes: np.ndarray, dtype) -> np.ndarray:
    """``(groups, 256, rows)``: sums of every subset of each eight components."""
    n, dims = codes.shape
    eights = np.zeros((n, -(-dims // 8) * 8), dtype)
    eights[:, :dims] = codes
    eights = eights.T.reshape(-1, 8, n)
    sums = np.zeros((len(eights), 256, n), dtype)
    for bit in range(8):  # each subset with a further element is one without it, plus the element
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + eights[:, bit, None]
    return sums


def scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """``(candidates, anchors)`` inner products from tables and bit planes."""
    rows, planes, groups = packed.shape
    total = np.zeros((rows, sums.shape[2]), sums.dtype)
    part, got = np.empty_like(total), np.empty_like(total)
    for k in range(planes):
        part[:] = 0
        for g in range(groups):
            np.take(sums[g], packed[:, k, g], axis=0, out=got, mode="clip")
            part += got
        if k == planes - 1:  # the sign's plane counts down
            total -= part << k
        else:
            total += part << k
    return total


class Best:
    """The ``k`` best ``(score, id)`` of each group so far."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group = self.score = self.id = np.zeros(0, np.int64)
        #: a score below a group's floor is no longer among its best
        self.floor = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        new = np.append(True, g[1:] != g[:-1])
        rank = np.arange(len(g)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.group, self.score, self.id = (x[rank < self.k] for x in (g, s, i))
        full = rank == self.k - 1
        self.floor[g[full]] = s[full]


class Block:
    """Anchors of one block with their tables; scores batches of candidates against them."""

    def __init__(self, ids: np.ndarray, labels: list[str], codes: np.ndarray, planes: int, wide: bool):
        self.ids, self.codes, self.planes = ids, codes, planes
        self.names = sorted(set(labels))
        self.label = np.searchsorted(np.array(self.names, object), np.array(labels, object)) if labels else np.zeros(0, int)
        self.dtype = np.int64 if wide else np.int32

    def tiles(self, batches, same: bool):
        """``(anchor numbers, candidate ids, scores)`` for pairs of one label (or of different ones)."""
        sums = subset_sums(self.codes, self.dtype)
        groups = sums.shape[0]
        names = pa.array(self.names, pa.string())
        for b in batches:
            label = pc.fill_null(pc.index_in(b.column("label"), value_set=names), -1).to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy()
            packed = np.frombuffer(b"".join(b.column("planes").to_pylist()), np.uint8).reshape(len(ids), self.planes, groups)
            for x in np.unique(label):
                rows = np.flatnonzero(label == x)
                anchors = np.flatnonzero((self.label == x) == same)
                for s in range(0, len(anchors), STRIP):
                    strip = anchors[s:s + STRIP]
                    table = np.ascontiguousarray(sums[:, :, strip])
                    for r in range(0, len(rows), TILE):
                        tile = rows[r:r + TILE]
                        yield strip, ids[tile], scores(table, packed[tile]).astype(np.int64, copy=False)

    def positives(self, batches, k: int) -> Best:
        best = Best(len(self.ids), k)
        for strip, ids, got in self.tiles(batches, True):
            floor = best.floor[strip]
            if len(ids) > k + 1:  # the anchor itself may be among them
                floor = np.maximum(floor, np.partition(got, len(ids) - k - 1, axis=0)[len(ids) - k - 1])
            c, a = np.nonzero((got >= floor) & (ids[:, None] != self.ids[strip]))
            best.add(strip[a], got[c, a], ids[c])
        return best

    def negatives(self, batches, positive: np.ndarray, known: np.ndarray, k: int, low: int, high: int) -> Best:
        """Best of each band; ``positive`` and ``known``: (anchors, positives) scores and which of them there are."""
        wide = positive.shape[1]
        best = Best(positive.size, k)
        least = np.where(known, positive * low, np.iinfo(np.int64).max)
        most = np.where(known, positive * high, np.iinfo(np.int64).min)
        for strip, ids, got in self.tiles(batches, False):
            got *= 100
            c, a = np.nonzero((got >= least[strip].min(axis=1)) & (got <= most[strip].max(axis=1)))
            score, row = got[c, a], strip[a]
            for j in range(wide):
                band = row * wide + j
                # a score is hundredfold here, a floor is not
                fits = (score >= least[row, j]) & (score <= most[row, j]) & (score // 100 >= best.floor[band])
                best.add(band[fits], score[fits] // 100, ids[c[fits]])
        return best


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors among ``vectors``.

    ``vectors``: ``(id, label, code)`` with one row per id, as ``integer_vectors`` gives; ``is_anchor``: a
    condition on them.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "negatives-vectors")
    n, dims, top = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("code")), F.lit(0)), F.coalesce(
        F.max(F.array_max(F.transform("code", lambda x: F.greatest(x, -x - 1)))), F.lit(0))).first()
    planes = int(top).bit_length() + 1
    if dims * 2 ** (2 * planes - 2) * max(100, low, high) >= 2 ** 63:
        raise ValueError("components are too large for scores of 64 bits")
    wide = dims * 2 ** (2 * planes - 2) >= 2 ** 31
    groups = max(1, -(-dims // 8))

    def dense(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), groups * 8), np.int64)
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
        return out

    def packed(batches):
        for b in batches:
            bits = pack(dense(b.column("code")), planes).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x.tobytes() for x in bits], pa.binary())],
                                             names=["id", "label", "planes"])

    files = max(shuffle_partitions(spark), n // ROWS_PER_FILE)
    candidates = stage(vectors.repartition(files, "id").mapInArrow(packed, "id long, label string, planes binary"), "negatives-planes")
    size = max(1, TABLE_BYTES // (256 * groups * (8 if wide else 4)))
    anchors = vectors.filter(is_anchor)
    parts = -(-anchors.count() * 5 // (4 * size))
    if not parts:
        return spark.createDataFrame([], OUT)
    # (partition, number in it): no block is larger than ``size``
    at = F.monotonically_increasing_id()
    anchors = stage(anchors.repartition(parts).withColumn("at", at).withColumn(
        "block", F.struct(F.shiftright("at", 33).alias("part"), F.floor((F.col("at") % 2**33) / size).alias("k"))), "negatives-anchors")
    path = scratch_path(spark, "negatives")
    for r in sorted(anchors.select("block").distinct().collect()):
        got = anchors.filter((F.col("block.part") == r["block"]["part"]) & (F.col("block.k") == r["block"]["k"])).select(
            "id", "label", "code").toArrow().combine_chunks()
        ids = got["id"].to_numpy()
        block = Block(ids, got["label"].to_pylist(), dense(pa.chunked_array(got["code"].chunks).combine_chunks()), planes, wide)
        _score_block(candidates, block, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)


def _score_block(candidates: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def best_positives(batches):
        best = shared.value.positives(batches, positives)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.score), pa.array(best.id)], names=["anchor", "score", "id"])

    rows = _top(candidates.mapInArrow(best_positives, "anchor long, score long, id long"), ["anchor"], positives).collect()
    score = np.zeros((len(block.ids), positives), np.int64)
    known, other = np.zeros(score.shape, bool), np.zeros(score.shape, np.int64)
    for r in rows:  # at most ``positives`` an anchor of the block
        at = r["anchor"], r["rank"] - 1
        score[at], other[at], known[at] = r["score"], r["id"], True
    bands = spark.sparkContext.broadcast((score, known, other))

    def best_negatives(batches):
        b, (score, known, other) = shared.value, bands.value
        best = b.negatives(batches, score, known, negatives, low, high)
        release_memory()
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.ids[best.group // score.shape[1]]), pa.array(other.ravel()[best.group]), pa.array(score.ravel()[best.group]),
             pa.array(best.score), pa.array(best.id)], names=["anchor_id", "positive_id", "positive_score", "score", "id"])

    found = candidates.mapInArrow(best_negatives, "anchor_id long, positive_id long, positive_score long, score long, id long")
    return _top(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
