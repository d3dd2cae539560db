"""Best-fit packing of documents into fixed-length token sequences by bin completion.

A document is its token ids and an end id; only documents longer than a sequence are
cut, into full pieces and a rest.  Which piece goes where depends on lengths alone,
and there are at most ``capacity`` different ones, so the search runs on the counts
per length (a bounded table) and yields fillings with multiplicities, however many
documents there are:

- around the largest remaining length it enumerates fillings of the free space,
  largest lengths first, and drops dominated ones (a longer available document fits
  in place of a chosen one, or another one still fits); where the first ones hold none
  within the waste bound, the fillings of least waste are found by the sums that the
  lengths can reach, so a branch without a filling is proven to have none;
- a filling is repeated while its documents last (branching: as often as possible, or once);
- a branch ends when its waste exceeds what an improvement on the incumbent allows;
- the first incumbent is best fit decreasing; the search stops at the bound
  ``ceil(tokens / capacity)`` or after ``NODES`` nodes, with the best packing so far.
  A node that is deeper than all before it isn't counted, so the way down to a first
  packing, about a step per length, is always open.

Spark then ranks the pieces of each length (buckets whose number grows with the
square root of its count, with prefix counts, so no length is gathered in a task) and looks each rank up in the fillings.

Defined results: NULL and empty texts are one end id; repeated rows are packed each;
ties are broken by id, piece and checksum; an empty table packs nothing; columns
other than the id and text are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import release_memory, slices, stage
from cohortlab.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
NODES = 4000
WIDTH = 8
RANK_BUCKET = 128

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           keep_space: bool = False, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        enc = encoder(tokenizer, keep_space)
        for b in batches:
            for lo, hi in slices(b.column("t"), 8 << 20):
                ids, at = enc.encode_documents(b.column("t").slice(lo, hi - lo), END_ID)
                n = np.diff(at)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                begin = at[doc] + start
                raw = memoryview(ids).cast("B")
                parts = [raw[4 * x:4 * (x + y)] for x, y in zip(begin.tolist(), length.tolist())]
                cols = [b.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(x) for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)
            release_memory()

    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                        + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing over counts: fillings and how often each is used."""
    left = Counter({n: c for n, c in counts.items() if c})
    out = []
    while lengths := [n for n in sorted(left, reverse=True) if left[n]]:
        # fillings keep their shape until one of their lengths runs out
        while left[lengths[0]]:
            out.append(_use(left, next(_fillings(left, lengths, capacity)), None))
            lengths = [n for n in lengths if left[n] or n == lengths[0]]
    return out


def _use(left: Counter, filling: Filling, times: int | None) -> tuple[Filling, int]:
    t = times or min(left[n] // k for n, k in filling)
    for n, k in filling:
        left[n] -= t * k
    return filling, t


def _fillings(left: Counter, lengths: list[int], capacity: int):
    """Fillings around the first of ``lengths`` (descending, all available), the greedy one first."""
    largest = lengths[0]
    keys = [-n for n in lengths]
    chosen = [[0, 1]]  # (position in lengths, copies), the largest at least once
    free = capacity - largest
    i = 0
    while True:
        # fill what is free with the longest that fit
        while i < len(lengths):
            i = max(i, bisect_left(keys, -free)) if free else len(lengths)
            if i == len(lengths):
                break
            k = min(free // lengths[i], left[lengths[i]] - (i == 0))
            if k:
                chosen.append([i, k])
                free -= k * lengths[i]
            i += 1
        yield _merged(lengths, chosen)
        # take one copy of the last choice back and go on behind it
        if len(chosen) == 1:
            return
        i, k = chosen[-1]
        free += lengths[i]
        chosen[-1][1] -= 1
        if k == 1:
            chosen.pop()
        i += 1


def _merged(lengths: list[int], chosen: list[list[int]]) -> Filling:
    own = Counter()
    for i, k in chosen:
        own[lengths[i]] += k
    return tuple(own.items())


def _fullest(left: Counter, lengths: list[int], capacity: int) -> tuple[int, Iterator[Filling]]:
    """Least waste around the first of ``lengths``, and the fillings that have it, longest lengths first."""
    largest, room = lengths[0], capacity - lengths[0]
    mask = (1 << room + 1) - 1
    usable = [(n, min(left[n] - (n == largest), room // n)) for n in lengths if n <= room]
    reach = [1]  # per position: the sums of the lengths from there on, as bits
    for n, copies in reversed(usable):
        sums, k = reach[-1], 1
        while copies:
            k = min(k, copies)
            sums |= sums << k * n & mask
            copies -= k
            k *= 2
        reach.append(sums)
    reach.reverse()

    def go(i: int, need: int, chosen: Filling):
        if not need:
            own = Counter({largest: 1})
            for n, k in chosen:
                own[n] += k
            yield tuple(own.items())
            return
        for j in range(i, len(usable)):
            n, copies = usable[j]
            for k in range(min(copies, need // n), 0, -1):
                if reach[j + 1] >> need - k * n & 1:
                    yield from go(j + 1, need - k * n, (*chosen, (n, k)))
            if not reach[j + 1] >> need & 1:
                return

    most = reach[0].bit_length() - 1
    return room - most, go(0, most, ())


def undominated(left: Counter, lengths: list[int], capacity: int, waste_left: int,
                width: int = WIDTH) -> list[Filling]:
    """Up to ``width`` undominated fillings within the waste bound, least waste first."""
    out = []
    for f in itertools.islice(_fillings(left, lengths, capacity), 8 * width):
        used = dict(f)
        waste = capacity - sum(n * k for n, k in f)
        if waste > waste_left:
            continue
        if waste:
            spare = [n for n in lengths if left[n] > used.get(n, 0)]
            if spare and spare[-1] <= waste:
                continue
            if any(n < u <= n + waste for n in used if n != lengths[0] for u in spare):
                continue
        out.append((waste, f))
        if len(out) >= width:
            break
    if not out:  # fillings of least waste are dominated by none
        waste, fullest = _fullest(left, lengths, capacity)
        if waste <= waste_left:
            return list(itertools.islice(fullest, width))
    return [f for _, f in sorted(out, key=lambda x: x[0])]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings of all documents in as few sequences as the search finds."""
    counts = {int(n): int(c) for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    least = -(-total // capacity)
    size = sum(t for _, t in best)
    lengths = sorted(counts, reverse=True)
    left = Counter(counts)
    path: list[tuple[Filling, int]] = []
    waste = [0]

    def options():
        allowed = (size - 1) * capacity - total - waste[-1]
        open_ = [n for n in lengths if left[n]]
        if not open_ or allowed < 0:
            return iter(())
        tries = []
        for f in undominated(left, open_, capacity, allowed):
            most = min(left[n] // k for n, k in f)
            tries += [(f, most), (f, 1)] if most > 1 else [(f, 1)]
        return iter(tries)

    todo = [options()] if size > least else []
    deepest = 0
    while todo and nodes:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            if path:
                f, t = path.pop()
                waste.pop()
                for n, k in f:
                    left[n] += t * k
            continue
        f, t = step
        own = t * (capacity - sum(n * k for n, k in f))
        if waste[-1] + own > (size - 1) * capacity - total:
            continue
        _use(left, f, t)
        path.append(step)
        waste.append(waste[-1] + own)
        if len(path) > deepest:
            deepest = len(path)
        else:
            nodes -= 1
        if not any(left.values()):
            best, size = list(path), sum(t for _, t in path)
            if size == least:
                break
        todo.append(options())
    return best


class Places:
    """Sequence and offset by (length, rank within the length)."""

    def __init__(self, fillings: list[tuple[Filling, int]]):
        at: Counter = Counter()
        rows, seq = [], 0
        for f, t in fillings:
            off = 0
            for n, k in f:
                rows.append((n, at[n], k, seq, off))
                at[n] += t * k
                off += n * k
            seq += t
        rows.sort()
        self.n, self.first, self.copies, self.seq, self.off = np.array(rows, np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # rows are sorted by (length, first rank): pairs are compared by position in the length's own run
        lo, hi = np.searchsorted(self.n, length, "left"), np.searchsorted(self.n, length, "right")
        while (open_ := lo + 1 < hi).any():
            mid = (lo + hi) // 2
            below = self.first[np.minimum(mid, len(self.n) - 1)] <= rank
            lo, hi = np.where(open_ & below, mid, lo), np.where(open_ & ~below, mid, hi)
        r = rank - self.first[lo]
        return self.seq[lo] + r // self.copies[lo], self.off[lo] + r % self.copies[lo] * length


def place(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``parts`` (written table with ``length``) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    fillings = complete({n: c for n, c in counts.items() if n < capacity}, capacity, nodes)
    if counts.get(capacity):
        fillings.append((((capacity, 1),), counts[capacity]))
    shared = spark.sparkContext.broadcast(Places(fillings))
    key = [c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns]
    buckets = F.lit(1)
    # as many buckets as rows in one, and at least RANK_BUCKET rows: both grow with the square root
    big = {n: -(-c // max(RANK_BUCKET, math.isqrt(c))) for n, c in counts.items() if c > RANK_BUCKET}
    if big:
        by_len = F.create_map(*[F.lit(x) for n, b in sorted(big.items()) for x in (n, b)])
        buckets = F.coalesce(F.try_element_at(by_len, F.col("length")), F.lit(1))
    p = parts.withColumn("__b", F.pmod(F.xxhash64(*key), buckets).cast("long"))
    starts = p.groupBy("length", "__b").agg(F.count("*").alias("__n")).select(
        F.col("length").alias("__l"), F.col("__b").alias("__k"),
        (F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")).alias("__from"))
    own = F.row_number().over(Window.partitionBy("length", "__b").orderBy(*key)) - 1
    ranked = (p.withColumn("__r", own).join(starts, (F.col("length") == F.col("__l")) & (F.col("__b") == F.col("__k")))
              .select(*parts.columns, (F.col("__from") + F.col("__r")).alias("__rank")))

    names = parts.columns

    def run(batches):
        places = shared.value
        for b in batches:
            seq, off = places.find(b.column("length").to_numpy(), b.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pieces of all documents with their places."""
    return place(stage(pieces(docs, tokenizer, capacity, **options), "packing-pieces"), capacity)
