import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = WORD.findall(fold(t))
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[p:p + k]), set()).add(i)
    out = []
    for t in docs:
        w, hit, got = WORD.findall(fold(t)), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in grams:
                    hit |= set(range(p, p + k))
                    got |= grams[tuple(w[p:p + k])]
        out.append((len(w), len(hit), sorted(x for x in got if x is not None)))
    return out


TEXT = st.lists(st.sampled_from(["a", "B", "c", "é", "a,b", "1"]), max_size=25).map(" ".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=12), st.lists(TEXT, min_size=1, max_size=4))
@pytest.mark.parametrize("part_bytes", [1 << 20, 16])
def test_scan_equals_brute_force(spark, part_bytes, texts, items):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    s = d.scan(docs, bench, n=4, part_bytes=part_bytes)
    got = [(r["__hit_words"], r["n"], r["__hit_items"]) for r in
           s.withColumn("n", d.hit_count()).orderBy("doc_id").collect()]
    assert got == brute(texts, [(str(i), t) for i, t in enumerate(items)], 4)


def test_edges(spark, edge, none):
    bench = spark.createDataFrame([
        ("i1", "QUICK brown fox jumps over the lazy dog near the river"), ("i1", "QUICK brown fox jumps over the lazy dog near the river"),
        (None, "one"), ("i2", None), ("i3", " ..."), ("i4", "")], "item_id string, text string")
    s = d.scan(edge, bench)
    got = {r["doc_id"]: (r["n"], r["__hit_items"]) for r in s.withColumn("n", d.hit_count()).collect()}
    assert got[1] == got[2] == (11, ["i1"]) and got[7] == (1, []) and got[3] == (0, [])
    clean = d.remove_documents(s)
    assert clean.columns == edge.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6, 8, None}
    cut = d.remove_spans(s)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == edge.columns and texts[1] == "The  bank, and then it sleeps." and texts[3] is None
    assert d.scan(none, bench).count() == 0
    assert d.scan(edge, bench.limit(0)).filter("size(__hit_spans) > 0").count() == 0


def test_parts_take_what_they_say_and_long_items_are_cut():
    import pickle
    import random
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(20_000)]
    part = d.GramSet(10)
    for i in range(400):
        part.add(str(i), [r.choice(vocab).encode() for _ in range(500)])
    part.close()
    size = len(pickle.dumps(part))
    assert part.n_words == 200_000 and size <= part.nbytes <= 10 * 1024 * 1024
    # 16 MB of text, some 2.7 million words, takes less than 300 MB
    assert 2_700_000 * 20 + 150 * 500_000 < 300 << 20


def test_a_long_item_over_several_parts_loses_no_ngram(spark):
    text = " ".join(f"w{i}" for i in range(300))
    bench = spark.createDataFrame([("long", text), ("short", "only three words")], "item_id string, text string")
    sets = list(d.gram_parts(bench, n=10, part_bytes=2000))
    assert len(sets) > 3
    docs = spark.createDataFrame([(1, text), (2, "x " + " ".join(f"w{i}" for i in range(95, 105)) + " y"), (3, "these only three words")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["__hit_items"]) for r in
           d.scan(docs, bench, part_bytes=2000).withColumn("n", d.hit_count()).collect()}
    assert got == {1: (300, ["long"]), 2: (10, ["long"]), 3: (3, ["short"])}
