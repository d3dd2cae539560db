"""Language identification by multilingual mixture inference.

Each learned language has a distribution over hashed byte trigrams of lower-cased,
space-padded words.  A word's likelihood under a language is the product over its
trigrams; a document is a mixture of languages whose proportions expectation
maximisation estimates over its words.  The language set grows from the best single
language, one language at a time, as long as the likelihood gains more than
``PENALTY / 2 * log(words)``; the prediction is the set's largest proportion.

The model is fitted on at most about ``SAMPLE`` documents of each language (a
documented bound, drawn by a hash of the row); the counts are summed by Spark, and
the table has ``2**BITS`` cells per language, with at most ``MAX_LANGS`` languages.
Prediction is one pass without a shuffle, a slice of some megabytes at a time.

Defined results: a NULL text or one without a letter is ``und`` with score 0, as is
every text when nothing was learned; rows without a language are not learned from;
repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import slices

BITS = 16
SAMPLE = 3000
MAX_LANGS = 1000
PENALTY = 6.0
ROUNDS = 10
SMOOTH = 0.2
#: scale of a word's log likelihood: its trigrams overlap, so they say the same thing up to three times
SCALE = 1 / 3
#: ASCII that is no letter becomes a space
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells, the first trigram of each word, and each text's first word."""
    parts = [b" " + (t or "").lower().encode().translate(_FOLD) + b" " for t in texts]
    b = np.frombuffer(b"".join([*parts, b"  "]), np.uint8)
    space = b == 32
    n = len(b) - 2
    h = (b[:n].astype(np.uint32) << 16) | (b[1:n + 1].astype(np.uint32) << 8) | b[2:n + 2]
    cell = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    # a word owns the trigrams from its leading space up to the one that ends in its trailing space
    mid = ~space[1:n + 1]
    first = space[:n] & mid
    ends = np.cumsum([0, *map(len, parts)])
    return cell[mid], np.flatnonzero(first[mid]), np.searchsorted(np.flatnonzero(first), ends)


class LanguageModel:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: trigram cells by language."""
        self.langs = langs
        c = counts + SMOOTH
        self.table = np.ascontiguousarray((np.log(c) - np.log(c.sum(axis=0, keepdims=True))).astype(np.float32))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood per word and language, and each text's first word."""
        cell, first, at = grams(texts)
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32), at
        return np.add.reduceat(self.table[cell], first, axis=0) * np.float32(SCALE), at

    def mixtures(self, texts: list[str | None], penalty: float = PENALTY) -> np.ndarray:
        """Proportions per text and language (rows of zeros where there is no word)."""
        lw, at = self.words(texts)
        out = np.zeros((len(texts), len(self.langs)))
        docs = np.flatnonzero(np.diff(at))
        if not len(docs) or not self.langs:
            return out
        n = np.diff(at)[docs]
        single = np.add.reduceat(lw.astype(np.float64), at[docs], axis=0)
        best = single.argmax(axis=1)
        members = np.zeros((len(docs), len(self.langs)), bool)
        members[np.arange(len(docs)), best] = True
        out[docs, best] = 1.0
        score = single.max(axis=1)
        # responsibilities under equal proportions rank the languages to add
        like = np.exp(lw - lw.max(axis=1, keepdims=True))
        share = np.add.reduceat(like / like.sum(axis=1, keepdims=True), at[docs], axis=0)
        open_ = np.arange(len(docs))
        for _ in range(1, len(self.langs)):
            trial = members[open_].copy()
            rest = np.where(trial, -1.0, share[open_])
            trial[np.arange(len(open_)), rest.argmax(axis=1)] = True
            pi, ll = self._fit(lw, like, at[docs[open_]], n[open_], trial)
            better = ll - score[open_] > penalty / 2 * np.log(n[open_] + 1)
            open_, pi, ll, trial = open_[better], pi[better], ll[better], trial[better]
            if not len(open_):
                break
            members[open_], score[open_] = trial, ll
            out[docs[open_]] = pi
        return out

    @staticmethod
    def _fit(lw, like, begin, n, members) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood of each text restricted to its member languages."""
        doc = np.repeat(np.arange(len(n)), n)
        starts = np.cumsum(n) - n
        row = np.arange(len(doc)) - np.repeat(starts - begin, n)
        x = like[row]
        pi = members / members.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = x * pi[doc]
            total = joint.sum(axis=1, keepdims=True) + 1e-300
            pi = np.add.reduceat(joint / total, starts, axis=0) / n[:, None]
        ll = np.log((x * pi[doc]).sum(axis=1) + 1e-300) + lw[row].max(axis=1)
        return pi, np.add.reduceat(ll, starts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_model(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on up to about ``sample`` rows of each language."""
    d = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = {r["lang"]: r["n"] for r in d.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
         .orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(n) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(n)
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0)))
    size = F.create_map(*[F.lit(x) for pair in n.items() for x in pair])[F.col(lang)]
    d = d.filter(F.pmod(F.xxhash64(*labelled.columns), size) < sample).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def count(batches):
        own = np.zeros((len(langs), 1 << BITS), np.int64)
        where = {x: i for i, x in enumerate(langs)}
        for b in batches:
            labels = b.column("l").to_pylist()
            for lo, hi in slices(b.column("t")):
                texts = b.column("t").slice(lo, hi - lo).to_pylist()
                for x in set(labels[lo:hi]):
                    cell, _, _ = grams([t for t, y in zip(texts, labels[lo:hi]) if y == x])
                    own[where[x]] += np.bincount(cell, minlength=1 << BITS)
        k, cell = np.nonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(own[k, cell], pa.int64())], names=["k", "cell", "n"])

    total = d.mapInArrow(count, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BITS, len(langs)))
    counts[total["cell"].to_numpy(), total["k"].to_numpy()] = total["n"].to_numpy()
    return LanguageModel(langs, counts)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``mixture`` (languages and proportions of the chosen set).

    Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "mixture")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields],
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    names = docs.columns

    def run(batches):
        m = shared.value
        for b in batches:
            lettered = pc.fill_null(pc.match_substring_regex(b.column(text), r"\p{L}"), False).to_pylist()
            pred, score, mix = [], [], []
            for lo, hi in slices(b.column(text), 2 << 20):
                p = m.mixtures(b.column(text).slice(lo, hi - lo).to_pylist())
                top = p.argmax(axis=1) if m.langs else np.zeros(len(p), int)
                for i, k, ok in zip(range(len(p)), top.tolist(), lettered[lo:hi]):
                    known = ok and m.langs and p[i, k] > 0
                    pred.append(m.langs[k] if known else "und")
                    score.append(min(1.0, float(p[i, k])) if known else 0.0)
                    mix.append([(m.langs[j], float(p[i, j])) for j in np.flatnonzero(p[i] > 0).tolist()] if known else [])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=[*names, "lang_pred", "score", "mixture"])

    return docs.mapInArrow(run, schema)
