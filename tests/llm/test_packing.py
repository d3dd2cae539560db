import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlab.llm import packing as p
from cohortlab.llm import tokens


def fewest(lengths, capacity):
    """Fewest bins by search over all assignments."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1:]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_few_documents_are_packed_optimally(lengths):
    f = p.complete(Counter(lengths), 20)
    used = Counter()
    for filling, t in f:
        assert sum(n * k for n, k in filling) <= 20
        for n, k in filling:
            used[n] += k * t
    assert used == Counter(lengths)
    assert sum(t for _, t in f) == fewest(sorted(lengths, reverse=True), 20)


def test_search_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 3, 3: 1, 2: 1}  # best fit needs one more
    cap = 11
    assert sum(t for _, t in p.complete(counts, cap)) <= sum(t for _, t in p.best_fit(counts, cap))


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_ids_equal_the_library(name, space, monkeypatch):
    texts = [None, "", " ", "  a", "a  b", "a \n b\tc ", "É́té Σας ΣΑΣ", "don't I'll '  s", "\x1c x \x1d", "a\xa0 b", "x" * 500,
             "a <|endoftext|> b<|endoftext|>", "end. Next, one,two ... 3,4 ,, .", "\x01 q", "日本 語 text"] * 3
    for cache in (10**6, 8):
        monkeypatch.setattr(tokens, "CACHE", cache)
        e = tokens.Encoder(public_tokenizers.path(name), space)
        for lo in range(0, len(texts), 10):
            ids, at = e.encode(pa.array(texts[lo:lo + 10], pa.string()))
            want = [e.lib.encode(t or "", add_special_tokens=False).ids for t in texts[lo:lo + 10]]
            assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == want
        ids, at = e.encode_documents(pa.array(["a b", None], pa.string()), 0)
        assert ids[at[1] - 1] == 0 and ids[at[1]:].tolist() == [0]


def check(out, capacity):
    seq = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"),
                                         F.count_distinct("offset").alias("d"), F.count("*").alias("c"), F.min("offset").alias("o"))
    assert seq.filter("n <> end OR d <> c OR o <> 0").count() == 0
    assert seq.filter(F.col("n") > capacity).count() == 0
    return seq.count()


def test_places_fill_sequences_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(p, "RANK_BUCKET", 7)
    r = np.random.default_rng(4)
    rows = [(i, 0, int(n), 0) for i, n in enumerate([*r.integers(1, 64, 400), *[5] * 300, *[64] * 20])]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long").repartition(5)
    out = p.place(parts, 64)
    assert out.count() == len(rows)
    assert check(out, 64) <= -(-sum(x[2] for x in rows) // 64) + 2


def test_edges(edge, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = p.pack(edge, path)
    check(out, 2048)
    whole = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()
    by = {r["doc_id"]: (r["n"], r["ids"]) for r in whole}
    assert by[3] == by[4] == by[5] == (1, 1) and by[7][0] == 2 and by[6][0] > 10
    long = out.filter("doc_id = 6").orderBy("piece").collect()
    assert [r["start"] for r in long] == [2048 * i for i in range(len(long))] and all(r["length"] == 2048 for r in long[:-1])
    assert p.pack(none, path).count() == 0


def test_search_of_many_lengths_beats_best_fit():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.3, 0.6, 400_000).astype(int), 1, 2047)
    counts = Counter(lengths.tolist())
    f = p.complete(counts)
    used = Counter()
    for filling, t in f:
        assert sum(n * k for n, k in filling) <= 2048
        for n, k in filling:
            used[n] += k * t
    assert used == counts
    assert sum(t for _, t in f) < sum(t for _, t in p.best_fit(counts, 2048))


def test_fillings_within_the_waste_bound_are_found_behind_many_others():
    # only two lengths fill it up exactly, behind more fillings than are listed first
    left = Counter({1001: 1, 691: 1, 308: 1, **{n: 1 for n in range(8, 700, 8)}})
    assert p.undominated(left, sorted(left, reverse=True), 2000, 0) == [((1001, 1), (691, 1), (308, 1))]
    assert p.undominated(Counter({100: 1, 60: 1, 30: 2}), [100, 60, 30], 195, 4) == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 4), min_size=1, max_size=7), st.integers(25, 40))
def test_fullest_fillings_equal_enumeration(counts, capacity):
    lengths = sorted(counts, reverse=True)
    waste, found = p._fullest(Counter(counts), lengths, capacity)
    every = {}
    for copies in itertools.product(*[range(counts[n] + 1) for n in lengths]):
        total = sum(n * k for n, k in zip(lengths, copies))
        if copies[0] and total <= capacity:
            every.setdefault(capacity - total, set()).add(tuple((n, k) for n, k in zip(lengths, copies) if k))
    found = list(found)
    assert waste == min(every) and len(found) == len(set(found)) and set(found) == every[waste]
