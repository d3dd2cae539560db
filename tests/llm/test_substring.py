import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import substring as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i if i is not None else s.NO_ID, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((None if i == s.NO_ID else i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def run(df, window=13):
    return sorted((tuple(r) for r in s.remove_repeats(df, window=window).collect()), key=str)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab\tc"), max_size=40).map(" ".join), min_size=2, max_size=25))
def test_equals_brute_force(spark, texts):
    rows = [(i // 2, t) if i % 5 == 0 else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old, s.SLICE_BYTES = s.SLICE_BYTES, 60
    try:
        assert run(df, window=5) == brute(rows, 5)
    finally:
        s.SLICE_BYTES = old


def test_passages_across_documents(spark):
    body = lambda k: " ".join(f"own{k}_{j}" for j in range(30))
    shared = " ".join(f"shared{j}" for j in range(60))
    rows = [(k, f"{body(k)} {shared if k % 3 == 0 else ''} {body(k + 1000)}") for k in range(40)]
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, rows[5][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows, 13)


def test_edges(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert run(edge) == brute(rows, 13)
    assert s.remove_repeats(none).count() == 0
