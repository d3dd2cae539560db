"""Feature attribution tables.

Linear models: with the standardised design, the Shapley value of feature j
for one row is ``beta_j * (z_j - mean(z_j))`` (independent features), a pure
column expression; the table is one aggregate over *all* scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab import config
from cohortlab.operators.models import Fitted


def linear_attribution(fitted: Fitted, df: DataFrame, features: Sequence[str] = tuple(config.ATTRIBUTION_FEATURES),
                       background: DataFrame | None = None) -> DataFrame:
    """Mean |SHAP| and the sign of the mean SHAP per feature, ascending by magnitude."""
    coefs = fitted.model.coefficients.toArray()
    d = fitted.design
    feats = [f for f in features if f in d.features]
    z = {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(d.means[f])) / F.lit(d.scales[f]) for f in feats}
    bg = background if background is not None else df
    bmean = bg.agg(*[F.avg(z[f]).alias(f) for f in feats])
    phi = {f: F.lit(float(coefs[d.features.index(f)])) * (z[f] - bmean.select(f).scalar()) for f in feats}
    wide = df.agg(*[F.avg(F.abs(phi[f])).alias(f"a_{f}") for f in feats],
                  *[F.avg(phi[f]).alias(f"m_{f}") for f in feats])
    stack = ", ".join(f"'{f}', `a_{f}`, `m_{f}`" for f in feats)
    long = wide.selectExpr(f"stack({len(feats)}, {stack}) AS (Feature, Mean_SHAP, mean_signed)")
    return (long.select("Feature", F.round("Mean_SHAP", 4).alias("Mean_SHAP"),
                        F.when(F.col("mean_signed") > 0, F.lit("positive")).otherwise(F.lit("negative"))
                         .alias("Mean_SHAP_dir"))
                .orderBy("Mean_SHAP", "Feature"))
