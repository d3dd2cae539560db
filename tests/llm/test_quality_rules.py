import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlab.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def counts(df):
    return [tuple(r) for r in df.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]


def test_signals_equal_brute_force_on_edge_rows(edge):
    s = edge.select("text", "doc_id", "lang", "source")
    got = sorted(counts(q.signals(s)))
    assert got == sorted(brute(r["text"]) for r in s.collect())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b#|é", max_size=60), min_size=1, max_size=30))
def test_signals_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = [tuple(r)[1:] for r in q.signals(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                      "n_repeat_words").orderBy("doc_id").collect()]
    assert got == [brute(t) for t in texts]


def test_buckets_are_within_their_error(spark):
    v = [0, 1, 127, 128, 129, 1000, 12345, 10**9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v long").select(q.bucket_low(F.col("v"))).collect()]
    assert got[:4] == v[:4]
    assert all(b <= x < b * (1 + 2.0 ** (1 - q.SKETCH_BITS)) + 1 for b, x in zip(got, v))


def test_sketches_merge(spark, edge):
    sig = q.signals(edge)
    whole = {tuple(r) for r in q.sketches(sig).collect()}
    a, b = sig.filter("n_words % 2 = 0"), sig.filter("n_words % 2 = 1")
    parts = q.sketches(a).union(q.sketches(b)).groupBy("lang", "source", "signal", "low").agg(F.sum("n").alias("n"))
    assert whole == {tuple(r) for r in parts.collect()}


def test_fences_follow_the_group_and_fall_back(spark):
    rows = [(i, " ".join(["word"] * (20 + i % 5) + [f"u{i}x{j}" for j in range(40)]), "en", "big") for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{i}y{j}" for j in range(60)) + " ### ### ### ###" * (i == 0), "en", "small") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in q.quality_rules(docs).collect()}
    assert not out[1000]["kept"] and out[1001]["kept"]
    assert len(out) == 305


def test_edges(edge, none):
    out = q.quality_rules(edge)
    assert out.count() == edge.count()
    assert out.filter("n_words < 10 AND NOT base_failed").count() == 0
    assert out.filter("kept AND base_failed").count() == 0
    kept = q.keep_documents(edge, out)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2}
    assert q.quality_rules(none).count() == 0 and q.keep_documents(none, q.quality_rules(none)).count() == 0
