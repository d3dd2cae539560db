import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.operators import metrics, models, profile
from cohortlab.operators.ranking import descending_cumulative


def scores_df(spark, labels, scores, model="m"):
    return spark.createDataFrame([(model, int(y), float(s)) for y, s in zip(labels, scores)],
                                 "model string, label int, score double")


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_ap_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 300)
    s = (rng.integers(0, 40, 300) / 40.0)
    g = metrics.score_groups(scores_df(spark, y, s))
    auc = metrics.auc_roc(g).first().auc_roc
    ap = metrics.average_precision(g).first().average_precision
    assert abs(auc - brute_auc(y, s)) < 1e-12 and abs(ap - brute_ap(list(y), list(s))) < 1e-12
    g2 = metrics.score_groups(scores_df(spark, y, 1 - s))
    assert abs(metrics.auc_roc(g2).first().auc_roc - (1 - auc)) < 1e-12


def test_one_class(spark):
    d = scores_df(spark, [0, 0, 0], [0.2, 0.7, 0.9])
    assert metrics.auc_roc(metrics.score_groups(d)).first().auc_roc is None
    t = metrics.threshold_metrics(d).first()
    assert (t.precision, t.recall, t.f1) == (0.0, 0.0, 0.0)


def test_calibration_bin_edges(spark):
    d = scores_df(spark, [0, 1, 0, 1], [0.0, 0.1, 0.3, 1.0])
    bins = sorted(r.bin for r in metrics.calibration(d).collect())
    assert bins == [0, 2, 9] and metrics.calibration(d).filter("bin = 0").first().n == 2


def test_descending_cumulative_equals_window(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", float(rng.random()), int(rng.integers(0, 5))) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, score double, pos long").dropDuplicates(["model", "score"])
    got = descending_cumulative(df, ["model"], "score", ["pos"])
    w = Window.partitionBy("model").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("w", F.sum("pos").over(w))
    j = got.join(want, ["model", "score"])
    assert j.count() == df.count() and j.filter(F.col("w") != F.col("cum_pos")).count() == 0


def test_confusion_and_report(spark):
    d = scores_df(spark, [1, 1, 0, 0, 0], [0.9, 0.2, 0.6, 0.1, 0.3])
    cm = {(r.label, r.predicted): r.n for r in metrics.confusion_matrix(d).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r.row: r for r in metrics.classification_report(d).collect()}
    assert rep["accuracy"].f1_score == 0.6 and rep["BIC"].precision == 0.5 and rep["Not BIC"].support == 3


def test_logistic_matches_newton_on_weighted_l2_objective(spark):
    rng = np.random.default_rng(0)
    n = 400
    x1, x2 = rng.normal(size=n), rng.exponential(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x1 - 0.5 * x2 - 1.0)))).astype(int)
    df = spark.createDataFrame([(f"h{i}", "p", float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))],
                               "COMMIT_HASH string, PROJECT_ID string, f1 double, f2 double, BIC int")
    fit = models.fit_logistic(df, ["f1", "f2"], "lr", projects=[])
    X = np.column_stack([x1, x2])
    Z = (X - X.mean(0)) / X.std(0)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    A = np.column_stack([np.ones(n), Z])
    beta = np.zeros(3)
    for _ in range(50):     # Newton on  sum w_i loss_i + 0.5 |b|^2  (intercept unpenalised)
        p = 1 / (1 + np.exp(-A @ beta))
        grad = A.T @ (w * (p - y)) + np.r_[0, beta[1:]]
        H = (A * (w * p * (1 - p))[:, None]).T @ A + np.diag([0, 1, 1])
        beta -= np.linalg.solve(H, grad)
    got = np.r_[fit.model.intercept, fit.model.coefficients.toArray()]
    assert np.allclose(got, beta, atol=1e-5)


def test_vif_matches_regression(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    b = a * 0.7 + rng.normal(size=300) * 0.5
    c = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    got = {r.Variable: r.VIF for r in profile.vif(df, ["a", "b", "c"]).collect()}
    X = np.column_stack([a, b, c])
    for i, name in enumerate("abc"):
        others = np.column_stack([np.ones(300), np.delete(X, i, axis=1)])
        coef, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
        resid = X[:, i] - others @ coef
        r2 = 1 - resid.var() / X[:, i].var()
        assert abs(got[name] - 1 / (1 - r2)) < 1e-8


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    r = {(x.var1, x.var2): x.r for x in profile.corr_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] is None and r[("b", "b")] == 1.0


def test_inventory_empty_table(spark):
    e = spark.createDataFrame([], "a int, b string")
    r = profile.inventory({"e": e}).first()
    assert (r.Rows, r.Cols, r.Missing_Cells, r.Missing_pct) == (0, 2, 0, 0.0)


def test_hash_sample_stable_under_repartition(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("COMMIT_HASH"))
    a = [r[0] for r in models.hash_sample(df, 50).collect()]
    b = [r[0] for r in models.hash_sample(df.repartition(13), 50).collect()]
    assert a == b and len(set(a)) == 50


def test_vif_survives_large_means_and_constants(spark):
    rng = np.random.default_rng(4)
    rows = [(1e8 + float(x), 1e8 + float(y), 3.0) for x, y in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.Variable: r.VIF for r in profile.vif(df, ["a", "b", "c"]).collect()}
    r2 = np.corrcoef(np.array(rows)[:, :2].T - 1e8)[0, 1] ** 2
    assert abs(got["a"] - 1 / (1 - r2)) < 1e-6 and abs(got["b"] - got["a"]) < 1e-9 and got["c"] is None
    same = spark.createDataFrame([(x, 2 * x + 1) for x, _, _ in rows], "a double, b double")
    assert min(r.VIF for r in profile.vif(same, ["a", "b"]).collect()) > 1e8


def _project_data(spark, projects, n):
    rng = np.random.default_rng(1)
    p = rng.integers(0, projects, n)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x + (p % 3) - 1)))).astype(int)
    return p, x, y, spark.createDataFrame(
        [(f"h{i}", f"p{k:05d}", float(a), int(b)) for i, (k, a, b) in enumerate(zip(p, x, y))],
        "COMMIT_HASH string, PROJECT_ID string, f1 double, BIC int")


def test_indicators_match_newton_and_a_saved_model_scores_alone(spark, tmp_path):
    p, x, y, df = _project_data(spark, 4, 400)
    fit = models.fit_logistic(df, ["f1"], "lr")
    X = np.column_stack([x, *[(p == k).astype(float) for k in range(1, 4)]])
    Z, n = (X - X.mean(0)) / X.std(0), len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    A, beta = np.column_stack([np.ones(n), Z]), np.zeros(5)
    for _ in range(50):
        q = 1 / (1 + np.exp(-A @ beta))
        beta -= np.linalg.solve((A * (w * q * (1 - q))[:, None]).T @ A + np.diag([0, 1, 1, 1, 1]),
                                A.T @ (w * (q - y)) + np.r_[0, beta[1:]])
    assert np.allclose(fit.model.coefficients.toArray(), beta[1:], atol=1e-5)
    other = spark.createDataFrame([("z1", "unseen", 0.3, 0), ("z2", "p00002", None, 1)], df.schema)
    test = df.union(other)
    models.save(fit, str(tmp_path / "m"))
    back = models.load(str(tmp_path / "m"))
    key = lambda d: {r.COMMIT_HASH: r.score for r in d.collect()}
    assert key(back.score(test)) == key(fit.score(test))
    want = 1 / (1 + np.exp(-(A @ beta)))
    assert np.allclose([key(fit.score(df))[f"h{i}"] for i in range(n)], want, atol=1e-5)


def test_thousands_of_projects_fit(spark):
    _, _, _, df = _project_data(spark, 5000, 12_000)
    fit = models.fit_logistic(df, ["f1"], "lr", max_iter=10)
    assert len(fit.design.projects) > 4000 and fit.model.coefficients.size == len(fit.design.columns)


def test_forest_and_boosted_models_rank(spark):
    _, _, _, df = _project_data(spark, 5, 1500)
    forest = models.fit_forest(df, ["f1"], num_trees=10, max_depth=5, min_leaf=5)
    boosted = models.fit_boosted(df, ["f1"], rounds=8, max_depth=3)
    for f in (forest, boosted):
        row = metrics.model_comparison(f.score(df).withColumnRenamed("BIC", "label")).first().asDict()
        assert next(v for k, v in row.items() if "roc" in k.lower()) > 0.7


def test_pair_complete_correlations_equal_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e8
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 7.0
    frame = pd.DataFrame(x, columns=list("abcde"))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double").repartition(3)
    got = {(r.var1, r.var2): r.r for r in profile.corr_matrix(df, list("abcde"), digits=9).collect()}
    want = frame.corr()
    assert len(got) == 25
    for (a, b), r in got.items():
        assert (r is None) == (a == "e" or b == "e") and (r is None or abs(r - want.loc[a, b]) < 1e-6)
    empty = profile.corr_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r.r is None for r in empty)


def test_240_columns_and_one_exact_dependency(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 240))
    x[:, 1] = 3 * x[:, 0] - 5
    names = [f"c{i}" for i in range(240)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = {r.Variable: r.VIF for r in profile.vif(df, names).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(np.delete(x, [0, 1], axis=1).T)))
    assert got["c0"] == got["c1"] == float("inf")
    finite = np.array([got[n] for n in names[2:]])
    assert np.isfinite(finite).all()
    # the others are regressed on the one direction of the pair too
    both = np.diag(np.linalg.inv(np.corrcoef(np.delete(x, 1, axis=1).T)))[1:]
    assert np.allclose(finite, both, rtol=1e-8) and not np.allclose(finite, want, rtol=1e-8)


def test_compared_models_are_scored_once(spark, monkeypatch):
    """Table 3 computes each score once, however many aggregates read it, and is that of the scores themselves."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from cohortlab.operators import metrics
    from cohortlab.plans import queries_models as q
    from cohortlab.session import materialize
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        asked.add(1)
        return (i * 37 % 101) / 101.0

    plain = spark.range(200).select(F.lit("M5_xgboost").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("label"), "id")
    monkeypatch.setattr(q, "_scores", lambda s, names: plain.withColumn("score", score("id")).drop("id"))
    got = q._compared(SimpleNamespace(stage=materialize), ["M5_xgboost"]).collect()
    assert asked.value == 200
    assert got == metrics.model_comparison(plain.withColumn("score", F.col("id") * 37 % 101 / 101.0).drop("id")).collect()
