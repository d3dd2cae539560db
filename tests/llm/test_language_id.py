import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import language_id as l

SYL = {"aa": "ka to mi ra ne su", "bb": "bru gla fent ost werk", "cc": "ció ñan ez lla que", "dd": "при вет дом мир"}


def text(lang, seed, n=60):
    r = np.random.default_rng(seed)
    s = SYL[lang].split()
    return " ".join("".join(r.choice(s, r.integers(1, 4))) for _ in range(n))


def corpus(spark, n=60):
    rows = [(k, text(x, k), x) for k, x in enumerate(list(SYL) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_mixtures(spark):
    docs = corpus(spark)
    out = l.held_out(F.col("doc_id"))
    model = l.fit_model(docs.filter(~out))
    got = l.predict(docs, model).filter(out).collect()
    assert len(got) > 20 and all(r["lang_pred"] == r["lang"] and 0.9 < r["score"] <= 1 for r in got)
    both = model.mixtures([text("aa", 900, 80) + " " + text("bb", 901, 40), text("cc", 902)])
    a, b = model.langs.index("aa"), model.langs.index("bb")
    assert abs(both[0, a] - 2 / 3) < 0.08 and abs(both[0, b] - 1 / 3) < 0.08 and np.count_nonzero(both[0]) == 2
    assert np.count_nonzero(both[1]) == 1


def test_expectation_maximisation_does_not_lose_likelihood(spark):
    model = l.fit_model(corpus(spark, 10))
    lw, at = model.words([text("aa", 1) + " " + text("cc", 2)])
    like = np.exp(lw - lw.max(axis=1, keepdims=True))
    members = np.ones((1, 4), bool)
    old, last = l.ROUNDS, -np.inf
    try:
        for n in range(1, 8):
            l.ROUNDS = n
            pi, ll = model._fit(lw, like, at[:1], np.diff(at), members)
            assert ll[0] >= last - 1e-9 and abs(pi.sum() - 1) < 1e-9
            last = ll[0]
    finally:
        l.ROUNDS = old


def test_edges(spark, edge, none):
    model = l.fit_model(edge)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in l.predict(edge, model).collect() if r["doc_id"] is not None}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "de" and got[1] == got[2]
    odd = spark.createDataFrame([(1, "123 !!"), (2, "x²"), (3, "日本")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in l.predict(odd, model).collect()} == {1: True, 2: False, 3: False}
    assert l.predict(none, model).count() == 0
    nothing = l.fit_model(none)
    assert {r["lang_pred"] for r in l.predict(edge, nothing).collect()} == {"und"}
    assert l.predict(edge.withColumn("score", F.lit(5)), model).columns.count("score") == 1
