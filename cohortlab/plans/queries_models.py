"""Model-stage queries (I1-I13, A12, A14, J6 on fitted scores, J14, D20, F5, F6).

Training results are not SQL-expressible, so these are checked rows-only
here and by closed-form tests in ``tests/``.  Fits are kept on the study they
belong to, so several queries over one study do not retrain a model; the tree
ensembles are kept for all studies of one session and the same input files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators import attribution, metrics, models, profile, split
from cohortlab.plans.registry import register
from cohortlab.session import scratch_path

def _split_tables(s):
    if "split" not in s.fits:
        sp = s.stage(split.chrono_split(s.modeling), "split")
        train = sp.filter(F.col("split") == "train")
        s.fits["split"] = (sp, train, sp.filter(F.col("split") == "test"), models.vocabulary(train))
    return s.fits["split"]


#: fitted tree ensembles by session, inputs and parameters: minutes to fit, the same for every study of one input
_ENSEMBLES: dict[tuple[int, str, str], models.Fitted] = {}


def _fit(s, name):
    shared = (id(s.spark), s.fingerprint(), name) if name.startswith(("M4", "M5")) and name not in s.fits else None
    if shared in _ENSEMBLES:
        s.fits[name] = _ENSEMBLES[shared]
    if name not in s.fits:
        _, train, _, proj = _split_tables(s)
        feats = config.MODEL_FEATURES[name]
        if name.startswith(("M1", "M2", "M3")):
            s.fits[name] = models.fit_logistic(train, feats, name, proj)
        elif name.startswith("M4"):
            s.fits[name] = models.fit_forest(train, feats, name, proj)
        elif name.startswith("M5"):
            s.fits[name] = models.fit_boosted(train, feats, name, proj)
        else:
            raise KeyError(name)
    if shared:
        _ENSEMBLES[shared] = s.fits[name]
    return s.fits[name]


def _scores(s, names):
    _, train, test, _ = _split_tables(s)
    parts = []
    for n in names:
        parts.append(models.dummy_scores(train, test, n) if n.startswith("M0") else _fit(s, n).score(test))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed(config.TARGET, "label")


def _compared(s, names):
    """Table 3 of models; their scores are computed and grouped once, and written, as several aggregates read them."""
    scores = s.stage(_scores(s, names), "scores")
    return metrics.model_comparison(scores, groups=s.stage(metrics.score_groups(scores), "score-groups"))


@register("fit_logistic", ops="I6 I11 I2 I4 I5 I13 H2 H4 G2")
def fit_logistic(s):
    out = None
    for n in ["M1_lr_baseline", "M2_lr_tdr_rq1", "M3_lr_tdr_ref_rq2"]:
        t = models.coefficient_table(_fit(s, n))
        out = t if out is None else out.unionByName(t)
    return out


@register("odds_ratios", ops="K4 B17 B18")
def odds_ratios(s):
    t = fit_logistic(s)
    core = ["SQALE_DEBT_RATIO", "log_churn", "log_ncloc", "DUPLICATED_LINES_DENSITY", "HAS_REFACTORING", "TDR_x_REF"]
    return t.filter(F.col("Model").isin("M2_lr_tdr_rq1", "M3_lr_tdr_ref_rq2") & F.col("Feature").isin(*core)
                    & ~F.col("Feature").startswith("proj_"))


@register("fit_forest", ops="I7")
def fit_forest(s):
    return _compared(s, ["M4_random_forest"])


@register("fit_boosted", ops="I8 S17")
def fit_boosted(s):
    return _compared(s, ["M5_xgboost"])


def _draw(seed=config.RANDOM_STATE):
    return f"CAST(concat('0x', substr(md5(concat(COMMIT_HASH, ':', '{seed}')), 1, 8)) AS BIGINT)"


@register("dummy_scores", f"""
  SELECT 'M0_dummy' AS model, PROJECT_ID, COMMIT_HASH, BIC AS label,
         CASE WHEN {_draw()} / 4294967296.0 < (SELECT avg(BIC) FROM mtrain)
              THEN 1.0 ELSE 0.0 END AS score
  FROM msplit WHERE split = 'test'""", doubles=["score"], ops="I9")
def dummy_scores(s):
    return _scores(s, ["M0_dummy"])


@register("model_comparison_fitted", ops="J6 I10 J13 K5")
def model_comparison_fitted(s):
    return _compared(s, config.MODEL_ORDER)


@register("sensitivity_models", ops="I12")
def sensitivity_models(s):
    _, train, _, proj = _split_tables(s)
    out = None
    for key, feats in config.SENSITIVITY_FEATURES.items():
        t = models.coefficient_table(models.fit_logistic(train, feats, f"sens_{key}", proj))
        out = t if out is None else out.unionByName(t)
    return out


@register("persisted_evaluation", ops="A12 A14 I10")
def persisted_evaluation(s):
    _, _, test, _ = _split_tables(s)
    f = _fit(s, "M2_lr_tdr_rq1")
    path = scratch_path(s.spark, "model-M2")
    models.save(f, path)
    back = models.load(path)
    return metrics.model_comparison(back.score(test).withColumnRenamed(config.TARGET, "label"))


@register("attribution_linear", ops="J14 F4")
def attribution_linear(s):
    _, train, test, _ = _split_tables(s)
    return attribution.linear_attribution(_fit(s, "M3_lr_tdr_ref_rq2"), test, background=train)


@register("vif", ops="D20 B10 G4")
def vif_q(s):
    return profile.vif(s.imputed, config.VIF_VARIABLES)


@register("hash_sample", f"SELECT * FROM modeling ORDER BY {_draw()}, COMMIT_HASH LIMIT 3000", ops="F5 F6")
def hash_sample(s):
    return models.hash_sample(s.modeling, 3000)


@register("attribution", ops="J14 F4 F6 H3")
def attribution_boosted(s):
    """Mean |SHAP| (log-odds) of the six core features of the boosted model over all test rows."""
    from cohortlab.operators import treeshap
    _, _, test, _ = _split_tables(s)
    f = _fit(s, "M5_xgboost")
    x = models.assemble(test, f.design, False, keep=("COMMIT_HASH",))
    trees = f.model.node_tables()
    phi = treeshap.attribution_frame(x, "features", trees, [1.0] * len(trees), f.design.columns, margin_scale=1.0)
    return treeshap.summarize(phi, [c for c in config.ATTRIBUTION_FEATURES if c in f.design.columns])
