"""Split, training statistics and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators import metrics, split
from cohortlab.plans.registry import register
from cohortlab.sources.fixtures import fixture_scores


def _split(s):
    return split.chrono_split(s.modeling)


def _train(s):
    return _split(s).filter(F.col("split") == "train")


@register("chrono_split", "SELECT PROJECT_ID, COMMIT_HASH, TIME_IDX, project_n, split FROM msplit", ops="E6 H5")
def chrono_split(s):
    return _split(s).select("PROJECT_ID", "COMMIT_HASH", "TIME_IDX", "project_n", "split")


@register("split_summary", "SELECT split, count(*) AS n, avg(BIC) * 100 AS bic_pct FROM msplit GROUP BY split",
          doubles=["bic_pct"], ops="D22")
def split_summary(s):
    return split.split_summary(_split(s))


@register("class_weights", """
  SELECT count(*) AS n, count(*) FILTER (WHERE BIC = 0) AS neg, count(*) FILTER (WHERE BIC = 1) AS pos,
         round(CAST(count(*) FILTER (WHERE BIC = 0) AS DOUBLE) / count(*) FILTER (WHERE BIC = 1), 2) AS scale_pos_weight,
         CAST(count(*) AS DOUBLE) / (2 * count(*) FILTER (WHERE BIC = 0)) AS weight_neg,
         CAST(count(*) AS DOUBLE) / (2 * count(*) FILTER (WHERE BIC = 1)) AS weight_pos
  FROM mtrain""", doubles=["scale_pos_weight", "weight_neg", "weight_pos"], ops="I5 D21")
def class_weights(s):
    return split.class_weights(_train(s))


_STD = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(coalesce(CAST({f} AS DOUBLE), 0)) AS mean, "
    f"stddev_pop(coalesce(CAST({f} AS DOUBLE), 0)) AS sd, "
    f"CASE WHEN stddev_pop(coalesce(CAST({f} AS DOUBLE), 0)) = 0 THEN 1.0 "
    f"ELSE stddev_pop(coalesce(CAST({f} AS DOUBLE), 0)) END AS scale FROM mtrain" for f in config.FEATURES_M3)


@register("standardize", _STD, doubles=["mean", "sd", "scale"], ops="I4 S15")
def standardize(s):
    return split.standardize_params(_train(s), config.FEATURES_M3)


@register("project_dummies", """
  SELECT m.PROJECT_ID, m.COMMIT_HASH, m.split, v.dummy_index, v.dummy_col
  FROM msplit m LEFT JOIN (
    SELECT PROJECT_ID, CAST(row_number() OVER (ORDER BY PROJECT_ID) - 2 AS INTEGER) AS dummy_index,
           'proj_' || PROJECT_ID AS dummy_col
    FROM (SELECT DISTINCT PROJECT_ID FROM mtrain)
    QUALIFY row_number() OVER (ORDER BY PROJECT_ID) > 1) v USING (PROJECT_ID)""", ops="I1 G3 S16")
def project_dummies(s):
    sp = _split(s)
    vocab = split.project_vocabulary(sp.filter(F.col("split") == "train"))
    return split.project_dummies(sp.select("PROJECT_ID", "COMMIT_HASH", "split"), vocab)


_MED = " UNION ALL ".join(f"SELECT '{f}' AS feature, median({f}) AS train_median FROM mtrain"
                          for f in config.FEATURES_M3)


@register("null_fill_train_median", _MED, doubles=["train_median"], ops="I3")
def null_fill_train_median(s):
    return split.train_medians(_train(s), config.FEATURES_M3)


_FILLED = ", ".join(f"coalesce(CAST({f} AS DOUBLE), (SELECT median({f}) FROM mtrain)) AS {f}" for f in config.FEATURES_M3)


@register("fill_train_median", f"SELECT PROJECT_ID, COMMIT_HASH, split, {_FILLED} FROM msplit",
          doubles=list(config.FEATURES_M3), ops="I3")
def fill_train_median(s):
    sp = _split(s)
    filled = split.fill_train_median(sp, sp.filter(F.col("split") == "train"), config.FEATURES_M3)
    return filled.select("PROJECT_ID", "COMMIT_HASH", "split", *[F.col(f).cast("double") for f in config.FEATURES_M3])


def _scores(s):
    return fixture_scores(s.cohort)


@register("auc_roc", "SELECT * FROM m_auc", doubles=["auc_roc"], ops="J1 E7")
def auc_roc(s):
    return metrics.auc_roc(metrics.score_groups(_scores(s)))


@register("average_precision", "SELECT * FROM m_ap", doubles=["average_precision"], ops="J2 E7")
def average_precision(s):
    return metrics.average_precision(metrics.score_groups(_scores(s)))


@register("threshold_metrics", "SELECT * FROM m_thr", doubles=["precision", "recall", "f1", "brier", "base_rate"],
          ops="J3 J4 J5 J13 B20")
def threshold_metrics(s):
    return metrics.threshold_metrics(_scores(s))


@register("brier", "SELECT model, brier FROM m_thr", doubles=["brier"], ops="J4")
def brier(s):
    return metrics.threshold_metrics(_scores(s)).select("model", "brier")


@register("model_comparison", "SELECT * FROM m_cmp",
          doubles=["AUC_ROC", "AUC_PR", "F1", "Precision", "Recall", "Brier", "BIC_rate_test"], ops="J6 C12 F3")
def model_comparison(s):
    return metrics.model_comparison(_scores(s))


@register("uplift", """
  SELECT max(CASE WHEN Model = 'M1_lr_baseline' THEN AUC_PR END) AS ap_base,
         max(CASE WHEN Model = 'M5_xgboost' THEN AUC_PR END) AS ap_best,
         max(CASE WHEN Model = 'M5_xgboost' THEN AUC_PR END) - max(CASE WHEN Model = 'M1_lr_baseline' THEN AUC_PR END) AS delta,
         (max(CASE WHEN Model = 'M5_xgboost' THEN AUC_PR END) - max(CASE WHEN Model = 'M1_lr_baseline' THEN AUC_PR END))
           * 100 / max(CASE WHEN Model = 'M1_lr_baseline' THEN AUC_PR END) AS delta_pct
  FROM m_cmp""", doubles=["ap_base", "ap_best", "delta", "delta_pct"], ops="J12 C11")
def uplift(s):
    return metrics.uplift(metrics.model_comparison(_scores(s)))


@register("roc_points", """
  SELECT model, score AS threshold, CAST(cum_neg AS DOUBLE) / N AS fpr, CAST(cum_pos AS DOUBLE) / P AS tpr FROM sgc
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM sgc""",
          doubles=["threshold", "fpr", "tpr"], ops="J7 K5")
def roc_points(s):
    return metrics.roc_points(metrics.score_groups(_scores(s)))


@register("pr_points", """
  SELECT model, score AS threshold, CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg) AS precision,
         CAST(cum_pos AS DOUBLE) / P AS recall FROM sgc WHERE cum_pos - pos < P
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM sgc""",
          doubles=["threshold", "precision", "recall"], ops="J8 K5")
def pr_points(s):
    return metrics.pr_points(metrics.score_groups(_scores(s)))


@register("confusion_matrix", """
  SELECT s.model, CAST(l.label AS INTEGER) AS label, CAST(p.predicted AS INTEGER) AS predicted,
         count(x.model) AS n
  FROM (SELECT DISTINCT model FROM scores_long) s CROSS JOIN (VALUES (0), (1)) l(label)
       CROSS JOIN (VALUES (0), (1)) p(predicted)
  LEFT JOIN scores_long x ON x.model = s.model AND x.label = l.label
       AND CAST(x.score >= 0.5 AS INTEGER) = p.predicted
  GROUP BY 1, 2, 3""", ops="J9 K6")
def confusion_matrix(s):
    return metrics.confusion_matrix(_scores(s))


@register("classification_report", """
  WITH c AS (
    SELECT model,
      count(*) FILTER (WHERE label = 0 AND score < 0.5) AS c00, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS c01,
      count(*) FILTER (WHERE label = 1 AND score < 0.5) AS c10, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS c11
    FROM scores_long GROUP BY model),
  k AS (
    SELECT model, c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS n,
      coalesce(CAST(c00 AS DOUBLE) / nullif(c00 + c10, 0), 0) AS p0, coalesce(CAST(c00 AS DOUBLE) / nullif(c00 + c01, 0), 0) AS r0,
      coalesce(CAST(c11 AS DOUBLE) / nullif(c11 + c01, 0), 0) AS p1, coalesce(CAST(c11 AS DOUBLE) / nullif(c11 + c10, 0), 0) AS r1,
      coalesce(CAST(2 * c00 AS DOUBLE) / nullif(2 * c00 + c01 + c10, 0), 0) AS f0,
      coalesce(CAST(2 * c11 AS DOUBLE) / nullif(2 * c11 + c01 + c10, 0), 0) AS f1,
      coalesce(CAST(c00 + c11 AS DOUBLE) / nullif(c00 + c01 + c10 + c11, 0), 0) AS acc
    FROM c)
  SELECT model, 'Not BIC' AS "row", round(p0, 4) AS precision, round(r0, 4) AS recall, round(f0, 4) AS f1_score, s0 AS support FROM k
  UNION ALL SELECT model, 'BIC', round(p1, 4), round(r1, 4), round(f1, 4), s1 FROM k
  UNION ALL SELECT model, 'accuracy', NULL, NULL, round(acc, 4), n FROM k
  UNION ALL SELECT model, 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), n FROM k
  UNION ALL SELECT model, 'weighted avg', round((p0 * s0 + p1 * s1) / n, 4), round((r0 * s0 + r1 * s1) / n, 4),
                   round((f0 * s0 + f1 * s1) / n, 4), n FROM k""",
          doubles=["precision", "recall", "f1_score"], ops="J10")
def classification_report(s):
    return metrics.classification_report(_scores(s))


_EDGES = " + ".join(f"CASE WHEN score > CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in metrics.CALIB_EDGES)


@register("calibration", f"""
  SELECT model, CAST({_EDGES} AS INTEGER) AS bin, avg(score) AS mean_predicted,
         avg(CAST(label AS DOUBLE)) AS fraction_positive, count(*) AS n
  FROM scores_long GROUP BY 1, 2""", doubles=["mean_predicted", "fraction_positive"], ops="J11")
def calibration(s):
    return metrics.calibration(_scores(s))
