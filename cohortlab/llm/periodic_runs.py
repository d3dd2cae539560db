"""Periodic runs of words: maximal stretches that repeat with a smallest period.

A run is a stretch of consecutive words in which words one period apart are the same,
which no neighbouring word extends, and which is at least ``max(MIN_WORDS, MIN_COPIES *
period)`` words long.  Block convolution finds them all:

* At each scale ``B = 1, 2, 4, ...`` a text is cut into aligned blocks of ``B`` words.  A
  run whose period ``q`` lies in ``[B, 2B)`` holds a whole block that comes again ``q``
  words later.  The sum of squared differences of word numbers between a block and each
  stretch of the ``2B - 1`` words that start ``B`` behind it is 0 exactly where the block
  comes again.  Its products are one cyclic convolution per block, by number-theoretic
  transforms over as many primes as the largest possible sum needs: the sums are exact.
* Neighbouring blocks that come again at one distance form a seed.  It is extended word by
  word, on each side by less than a block, because the next block does not come again.
* A seed inside a run found at a smaller scale whose period divides the distance repeats
  that run and is left out; so every remaining run has its smallest period.

Work per text is O(words * log² words), memory a multiple of the longest text.  Texts
don't meet each other, so nothing is shuffled and a lost executor costs its own batches.

Defined results: a NULL, empty or blank text has no words and no runs and collapses to an
empty text; repeated rows get the same result each; an empty table gives an empty result;
columns of the names this module adds are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm import ntt
from cohortlab.llm.common import release_memory, slices, word_array

MIN_WORDS = 6
MIN_COPIES = 4
#: array elements worked on at a time
AT_ONCE = 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _again(codes: np.ndarray, block: int, starts: np.ndarray, ends: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by number) and distances in ``[block, 2 * block)`` at which they come again.

    ``codes`` are above 0 and at most ``top``; ``ends``: the end of each block's text.
    """
    near, lags = np.arange(block)[:, None], np.arange(2 * block)[:, None]
    at, lag = [], []
    step = max(1, AT_ONCE // (2 * block))
    for lo in range(0, len(starts), step):
        p, end = starts[lo:lo + step], ends[lo:lo + step]
        own = codes[p + near]
        where = p + block + lags
        other = np.where(where < end, codes[np.minimum(where, end - 1)], 0)
        same, proven = None, 1
        for prime, generator, power in ntt.PRIMES:
            if 2 * block > 1 << power:
                continue
            x, y = np.zeros((2 * block, len(p)), np.uint64), other.astype(np.uint64)
            x[0], x[block + 1:] = own[0], own[:0:-1]
            product = ntt.convolve(x, y, prime, generator)[:block]
            upto = np.zeros((2 * block + 1, len(p)), np.uint64)
            np.cumsum(ntt.reduce(y * y, prime), axis=0, out=upto[1:])
            squares = upto[block:2 * block] - upto[:block] + ntt.reduce(own.astype(np.uint64) ** 2, prime).sum(axis=0)
            zero = ntt.reduce(squares, prime) == ntt.reduce(product * np.uint64(2), prime)
            same = zero if same is None else same & zero
            proven *= prime
            if block * top * top < proven:  # a sum that is 0 modulo the primes is 0
                break
        else:
            raise ValueError("a text has too many different words for exact sums")
        d, k = np.nonzero(same)
        at.append(k + lo)
        lag.append(d + block)
    return np.concatenate(at), np.concatenate(lag)


def _matching(codes: np.ndarray, first: np.ndarray, step: int, room: np.ndarray, lag: np.ndarray, width: int) -> np.ndarray:
    """How many words from ``first`` on, in direction ``step``, equal the word ``lag`` behind (at most ``room``)."""
    out = np.zeros(len(first), np.int64)
    many = max(1, AT_ONCE // width)
    j = np.arange(width)
    for lo in range(0, len(first), many):
        hi = lo + many
        inside = j < room[lo:hi, None]
        a = np.where(inside, first[lo:hi, None] + step * j, 0)
        b = np.where(inside, a + lag[lo:hi, None], 0)
        differs = ~inside | (codes[a] != codes[b])
        out[lo:hi] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return out


def find_runs(codes: np.ndarray, at: np.ndarray, min_words: int = MIN_WORDS, min_copies: int = MIN_COPIES) -> np.ndarray:
    """Runs of several texts: rows ``(text, start, length, period)`` by text, start and period.

    ``codes``: word numbers from 1 on, those of text ``i`` at ``at[i]:at[i + 1]``.
    ``min_copies`` is at least 3.
    """
    if min_copies < 3:
        raise ValueError("min_copies must be at least 3")
    size = np.diff(at)
    found = np.zeros((0, 3), np.int64)  # start, length, period
    block = 1
    while (docs := np.flatnonzero(size >= max(min_words, min_copies * block))).size:
        count = size[docs] // block - 1  # blocks with room for another behind them
        text = np.repeat(docs, count)
        starts = at[text] + block * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        order = np.argsort(size[text], kind="stable")  # texts of like size together: their sums need like primes
        n, lag = _blocks(codes, block, starts[order], at[text[order] + 1], size[text[order]])
        n = order[n]
        order = np.lexsort((n, lag))
        n, lag = n[order], lag[order]
        head = np.ones(len(n), bool)
        head[1:] = (np.diff(lag) != 0) | (np.diff(n) != 1) | (np.diff(text[n]) != 0)
        first, last = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(n)) - 1
        text, lag, lo, hi = text[n[first]], lag[first], starts[n[first]], starts[n[last]] + block if len(n) else first
        fresh = np.ones(len(lo), bool)
        for q in np.unique(found[:, 2]):
            own = found[found[:, 2] == q]
            own = own[np.argsort(own[:, 0])]
            k = np.searchsorted(own[:, 0], lo, "right") - 1
            inside = (k >= 0) & (own[k, 0] + own[k, 1] >= hi + lag)
            fresh &= ~(inside & (lag % q == 0))
        text, lag, lo, hi = text[fresh], lag[fresh], lo[fresh], hi[fresh]
        left = _matching(codes, lo - 1, -1, np.minimum(lo - at[text], block), lag, block)
        right = _matching(codes, hi, 1, np.minimum(at[text + 1] - lag - hi, block), lag, block)
        length = hi + right - lo + left + lag
        long = length >= np.maximum(min_words, min_copies * lag)
        found = np.concatenate([found, np.stack([lo - left, length, lag], axis=1)[long]])
        block *= 2
    text = np.searchsorted(at, found[:, 0], "right") - 1
    rows = np.column_stack([text, found[:, 0] - at[text], found[:, 1], found[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _blocks(codes, block, starts, ends, size):
    """``_again`` for blocks ordered by the size of their text, a part of like sizes at a time."""
    parts = np.searchsorted(size, 1 << np.arange(64, dtype=np.uint64))
    cuts = np.unique(np.concatenate([[0], parts, [len(size)]]))
    got = [(lo, *_again(codes, block, starts[lo:hi], ends[lo:hi], int(size[hi - 1]))) for lo, hi in zip(cuts, cuts[1:])]
    return np.concatenate([lo + n for lo, n, _ in got]), np.concatenate([d for _, _, d in got])


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers (from 1, by text) and each text's offset."""
    words = [t.split() for t in texts]  # bytes split at ASCII white space
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    codes = np.empty(at[-1], np.int64)
    for w, lo, hi in zip(words, at.tolist(), at[1:].tolist()):
        number = {x: i for i, x in enumerate(dict.fromkeys(w), 1)}
        codes[lo:hi] = np.fromiter(map(number.__getitem__, w), np.int64, hi - lo)
    return words, codes, at


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run ``(start, length, period)`` holds behind its first period, one space between."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_copies: int = MIN_COPIES) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words, by start, then period) and ``collapsed``.

    ``collapsed`` keeps of each run its first period only.
    """
    docs = docs.drop(*[c for c in ("runs", "collapsed") if c != text])
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType, True) for c in names],
                           T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
                           T.StructField("collapsed", T.StringType())])
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches):
        for b in batches:
            whole = b.column(text).cast(pa.large_binary())
            for lo, hi in slices(whole):
                words, codes, at = numbered([t or b"" for t in whole.slice(lo, hi - lo).to_pylist()])
                rows = find_runs(codes, at, min_words, min_copies)
                cuts = np.searchsorted(rows[:, 0], np.arange(hi - lo + 1))
                kept = [collapse(w, rows[i:j, 1:]) if j > i else b" ".join(w) for w, i, j in zip(words, cuts.tolist(), cuts[1:].tolist())]
                runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(kind)))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], runs, pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*names, "runs", "collapsed"])
        release_memory()

    return docs.mapInArrow(run, schema)


def cycle_words(text: Column, start: Column, period: Column) -> Column:
    """The text's words up to ``start``, then its next ``period`` words over and over up to its length; one space between."""
    w = word_array(text)
    rest = F.greatest(F.size(w) - start, F.lit(0)).cast("int")
    start, period = start.cast("int"), period.cast("int")
    turn = F.array_repeat(F.slice(w, start + 1, period), F.ceil(rest / period).cast("int"))
    return F.array_join(F.concat(F.slice(w, F.lit(1), start), F.slice(F.flatten(turn), F.lit(1), rest)), " ")
