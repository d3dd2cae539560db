"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

The benchmark's n-grams (``n`` consecutive words; a shorter item is one n-gram of
its length) are held as arrays, in parts that are closed when they take
``PART_BYTES`` bytes in memory; each part is broadcast and every document is
scanned against it in one pass without a shuffle.  With more than one part the
documents and their hits so far are a written table between the passes, so memory
stays bounded and no n-gram is left out.

A scan maps words to the part's vocabulary, looks the rolling hash of every window
of known words up in the sorted hashes, and verifies each hit by its word ids.

Defined results: NULL and word-free texts have no words and no hits; NULL, empty or
word-free items have no n-grams; items without an id mark words but are not listed;
repeated items count once, repeated documents are judged alike; an empty benchmark
hits nothing; other columns pass through untouched.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import release_memory, slices, stage

NGRAM = 10
#: memory of one broadcast part
PART_BYTES = 128 << 20
HITS = "array<struct<start:int,end:int>>"

#: lower-cases A-Z and blanks every ASCII character but digits and letters
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class GramSet:
    """N-grams of one part as arrays: the items' word ids, and per length sorted hashes with their places.

    Some 20 bytes a word and 150 a distinct word; ``nbytes`` is what the part takes.
    """

    def __init__(self, n: int):
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.names: list[str | None] = []
        self.pieces: list[np.ndarray] = []
        self.n_words = self.vocab_bytes = 0
        rng = np.random.default_rng(9)
        self.mult = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)

    @property
    def nbytes(self) -> int:
        return 20 * self.n_words + self.vocab_bytes

    def add(self, item: str | None, ws: list[bytes]) -> None:
        """An item's words (or a stretch of a long item's)."""
        before = len(self.vocab)
        ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws), np.uint32, len(ws))
        self.vocab_bytes += 150 * (len(self.vocab) - before)
        self.names.append(item)
        self.pieces.append(ids)
        self.n_words += len(ids)

    def close(self) -> GramSet:
        sizes = np.array([len(x) for x in self.pieces], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.ids = np.concatenate([*self.pieces, np.zeros(0, np.uint32)])
        self.pieces = []
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.minimum(sizes, self.n)
        for k in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == k)
            count = sizes[own] - k + 1
            place = np.repeat(self.at[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            h = self._hash(self.ids, place, k)
            order = np.argsort(h, kind="stable")
            self.grams[k] = h[order], place[order]
        return self

    def _hash(self, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += ids[at + j].astype(np.uint64) * self.mult[j]
        return h

    def find(self, ids: np.ndarray):
        """``(position, length, item ids)`` of every verified hit; id 0 is a word no n-gram has."""
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for k, (known, place) in self.grams.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(gaps[k:] == gaps[:-k])
            if not len(at):
                continue
            h = self._hash(ids, at, k)
            lo = np.searchsorted(known, h)
            hit = known[np.minimum(lo, len(known) - 1)] == h
            words_of = np.arange(k)
            for p, a, b in zip(at[hit].tolist(), lo[hit].tolist(), np.searchsorted(known, h[hit], "right").tolist()):
                # the words themselves are compared: equal hashes are no proof
                same = (self.ids[place[a:b, None] + words_of] == ids[p:p + k]).all(axis=1)
                if same.any():
                    items = np.unique(np.searchsorted(self.at, place[a:b][same], "right") - 1).tolist()
                    yield p, k, {self.names[i] for i in items if self.names[i] is not None}


def gram_parts(bench: DataFrame, item_id: str = "item_id", text: str = "text", n: int = NGRAM,
               part_bytes: int = PART_BYTES):
    """The benchmark's n-gram sets, each closed as soon as it takes ``part_bytes``.

    Items pass by one at a time; an item of many words is cut into stretches that share
    ``n - 1`` words, so no n-gram is lost between two parts.
    """
    b = bench.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    part, any_part = GramSet(n), False
    step = max(1, part_bytes // 40)
    for r in b.toLocalIterator():
        ws = words(r["t"])
        for lo in range(0, max(1, len(ws) - n + 1), step):
            part.add(r["i"], ws[lo:lo + step + n - 1])
            if part.nbytes >= part_bytes:
                yield part.close()
                part, any_part = GramSet(n), True
    if part.n_words or not any_part:  # without an n-gram, a set that hits nothing
        yield part.close()


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", n: int = NGRAM, item_id: str = "item_id",
         item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``__hit_words`` (long), ``__hit_spans`` (word ranges) and ``__hit_items`` (ids, sorted)."""
    spark = docs.sparkSession
    out = docs.withColumns({"__hit_words": F.lit(0).cast("long"), "__hit_spans": F.lit(None).cast(HITS),
                            "__hit_items": F.lit(None).cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    for k, grams in enumerate(gram_parts(bench, item_id, item_text, n, part_bytes)):
        if k:  # the documents and their hits so far
            out = stage(out, f"decontam-part{k}")
        out = out.mapInArrow(_scanner(spark, grams, text), schema)
    return out


def _scanner(spark: SparkSession, grams: GramSet, text: str):
    shared = spark.sparkContext.broadcast(grams)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        g = shared.value
        for batch in batches:
            texts = batch.column(text)
            counts, spans, items = [], [], []
            for lo, hi in slices(texts):
                ws = [words(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                # one id array for the slice, a zero after every document
                ids = np.fromiter(
                    map(g.vocab.get, itertools.chain.from_iterable([*w, b" "] for w in ws), itertools.repeat(0)),
                    np.int64)
                starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in ws])])
                found = defaultdict(list)
                for p, k, of in g.find(ids):
                    d = int(np.searchsorted(starts, p, side="right")) - 1
                    found[d].append((p - int(starts[d]), k, of))
                for d, w in enumerate(ws):
                    hits = found.get(d, [])
                    counts.append(len(w))
                    spans.append(_merge([(p, p + k) for p, k, _ in hits]))
                    items.append({i for *_, of in hits for i in of})
            before_s, before_i = batch.column("__hit_spans").to_pylist(), batch.column("__hit_items").to_pylist()
            spans = [_merge([(x["start"], x["end"]) for x in old or []] + new) for old, new in zip(before_s, spans)]
            items = [sorted(new.union(old or [])) for old, new in zip(before_i, items)]
            new = {"__hit_words": pa.array(counts, pa.int64()),
                   "__hit_spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_type),
                   "__hit_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names],
                                             names=batch.schema.names)
            release_memory()
    return run


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_count() -> Column:
    return F.aggregate("__hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def remove_documents(scanned: DataFrame) -> DataFrame:
    """Documents without a hit."""
    return scanned.filter(F.size("__hit_spans") == 0).drop("__hit_words", "__hit_spans", "__hit_items")


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Every document, its hit spans cut from the text (words as in ``words``)."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    schema = scanned.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, spans in enumerate(batch.column("__hit_spans").to_pylist()):
                if spans:
                    at = [m.span() for m in word.finditer(texts[i])]
                    out, end = [], 0
                    for s in spans:
                        out.append(texts[i][end:at[s["start"]][0]])
                        end = at[s["end"] - 1][1]
                    texts[i] = "".join([*out, texts[i][end:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in batch.schema.names],
                names=batch.schema.names)

    return scanned.mapInArrow(run, schema).drop("__hit_words", "__hit_spans", "__hit_items")
