"""Exact path-dependent TreeSHAP for Spark tree ensembles.

The Shapley values of Lundberg, Erion and Lee, "Consistent Individualized Feature
Attribution for Tree Ensembles" (2018), evaluated for a whole Arrow batch at
once.  A leaf's part depends on a row only through which of the k columns on its
path the row follows: the values of all 2^k patterns are tabled once per leaf, and
rows look theirs up.  Trees with a path of more than ``TABLED`` columns take
Algorithm 2 of that paper, where every path quantity is a numpy vector over the batch.

The tree tables come from the saved Spark model (one row per node, with the
training count reaching the node as cover); they are model-sized, not
data-sized, and shipped to the tasks as a broadcast variable.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab import config


TABLED = 10


class _Tree:
    __slots__ = ("left", "right", "feat", "thr", "value", "cover", "tables")

    def __init__(self, nodes: pd.DataFrame):
        n = int(nodes["id"].max()) + 1
        self.left = np.full(n, -1, dtype=np.int64)
        self.right = np.full(n, -1, dtype=np.int64)
        self.feat = np.full(n, -1, dtype=np.int64)
        self.thr = np.zeros(n)
        self.value = np.zeros(n)
        self.cover = np.zeros(n)
        for r in nodes.itertuples(index=False):
            i = int(r.id)
            self.left[i], self.right[i] = int(r.leftChild), int(r.rightChild)
            self.value[i], self.cover[i] = float(r.prediction), float(r.rawCount)
            if r.leftChild >= 0:
                self.feat[i] = int(r.featureIndex)
                self.thr[i] = float(r.threshold)
        self.tables = _tables(self)


def _tables(tree: _Tree):
    """Per leaf ``(columns, conditions, table)``: of each column its (node, goes left) pairs, and its values by pattern.

    ``None`` if some path has too many columns.
    """
    out, todo = [], [(0, {}, {})]
    while todo:
        node, conds, share = todo.pop()
        lc, rc, f = int(tree.left[node]), int(tree.right[node]), int(tree.feat[node])
        if lc >= 0:
            c = tree.cover[node]
            for child, left in ((lc, True), (rc, False)):
                z = tree.cover[child] / c if c > 0 else 0.0
                todo.append((child, conds | {f: [*conds.get(f, []), (node, left)]}, share | {f: share.get(f, 1.0) * z}))
            continue
        k = len(conds)
        if k > TABLED:
            return None
        if not k:
            continue
        z = np.array(list(share.values()))
        follows = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
        # sum over sets S of the other columns: |S|! (k - |S| - 1)! / k! times S's ones and the others' shares
        weight = np.array([math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)])
        table = np.empty((k, 1 << k))
        for i in range(k):
            poly = np.zeros((k, 1 << k))
            poly[0] = 1.0
            for j in range(k):
                if j != i:
                    poly[1:] = poly[1:] * z[j] + poly[:-1] * follows[:, j]
                    poly[0] *= z[j]
            table[i] = (weight @ poly) * (follows[:, i] - z[i]) * tree.value[node]
        out.append((list(conds), list(conds.values()), table))
    return out


def _extend(pw, fi, zf, of, depth, z, o, f):
    fi[depth], zf[depth], of[depth] = f, z, o
    pw[depth] = np.ones_like(o) if depth == 0 else np.zeros_like(o)
    for i in range(depth - 1, -1, -1):
        pw[i + 1] = pw[i + 1] + o * pw[i] * (i + 1) / (depth + 1)
        pw[i] = z * pw[i] * (depth - i) / (depth + 1)


def _unwind(pw, fi, zf, of, depth, k):
    o, z = of[k], zf[k]
    nz = o != 0
    safe_o = np.where(nz, o, 1.0)
    nxt = pw[depth].copy()
    for i in range(depth - 1, -1, -1):
        tmp = pw[i]
        a = nxt * (depth + 1) / ((i + 1) * safe_o)
        b = pw[i] * (depth + 1) / (z * (depth - i)) if z != 0 else np.zeros_like(tmp)
        new = np.where(nz, a, b)
        nxt = np.where(nz, tmp - new * z * (depth - i) / (depth + 1), nxt)
        pw[i] = new
    for i in range(k, depth):
        fi[i], zf[i], of[i] = fi[i + 1], zf[i + 1], of[i + 1]


def _unwound_sum(pw, zf, of, depth, k):
    o, z = of[k], zf[k]
    nz = o != 0
    safe_o = np.where(nz, o, 1.0)
    nxt = pw[depth].copy()
    total = np.zeros_like(nxt)
    for i in range(depth - 1, -1, -1):
        tmp = nxt * (depth + 1) / ((i + 1) * safe_o)
        alt = (pw[i] / z) / ((depth - i) / (depth + 1)) if z != 0 else np.zeros_like(tmp)
        total = total + np.where(nz, tmp, alt)
        nxt = np.where(nz, pw[i] - tmp * z * ((depth - i) / (depth + 1)), nxt)
    return total


def tree_shap(tree: _Tree, X: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """Add ``scale`` x the SHAP values of one tree for every row of ``X`` into ``phi``."""
    if tree.tables is None:
        return _tree_shap_deep(tree, X, phi, scale)
    left = {int(i): (X[:, tree.feat[i]] <= tree.thr[i]).astype(np.uint16) for i in np.flatnonzero(tree.left >= 0)}
    right = {i: np.uint16(1) - x for i, x in left.items()}
    sums: dict[int, np.ndarray] = {}
    for columns, conds, table in tree.tables:
        code = None
        for j, pairs in enumerate(conds):
            one = None
            for node, goes_left in pairs:
                x = left[node] if goes_left else right[node]
                one = x if one is None else one & x
            code = one if code is None else code | (one << np.uint16(j))
        for f, row in zip(columns, table):
            if f in sums:
                sums[f] += row[code]
            else:
                sums[f] = row[code]
    for f, x in sums.items():
        phi[:, f] += scale * x


def _tree_shap_deep(tree: _Tree, X: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """The same for paths of any length."""
    n = X.shape[0]

    def rec(node, depth, pw, fi, zf, of, pz, po, pf):
        pw, fi, zf, of = list(pw), list(fi), list(zf), list(of)
        for lst in (pw, fi, zf, of):
            lst.extend([None] * (depth + 1 - len(lst)))
        _extend(pw, fi, zf, of, depth, pz, po, pf)
        if tree.left[node] < 0:
            v = tree.value[node] * scale
            for i in range(1, depth + 1):
                w = _unwound_sum(pw, zf, of, depth, i)
                phi[:, fi[i]] += w * (of[i] - zf[i]) * v
            return
        f, t = tree.feat[node], tree.thr[node]
        go_left = (X[:, f] <= t).astype(np.float64)
        iz, io = 1.0, np.ones(n)
        k = next((i for i in range(depth + 1) if fi[i] == f), -1)
        if k >= 0:
            iz, io = zf[k], of[k]
            _unwind(pw, fi, zf, of, depth, k)
            depth -= 1
        c = tree.cover[node]
        lc, rc = tree.left[node], tree.right[node]
        rec(lc, depth + 1, pw[:depth + 1], fi[:depth + 1], zf[:depth + 1], of[:depth + 1],
            iz * tree.cover[lc] / c, io * go_left, f)
        rec(rc, depth + 1, pw[:depth + 1], fi[:depth + 1], zf[:depth + 1], of[:depth + 1],
            iz * tree.cover[rc] / c, io * (1.0 - go_left), f)

    rec(0, 0, [], [], [], [], 1.0, np.ones(n), -1)


def expected_value(tree: _Tree) -> float:
    """Cover-weighted mean leaf value (the tree's base value)."""
    leaves = tree.left < 0
    used = tree.cover > 0
    m = leaves & used
    return float((tree.value[m] * tree.cover[m]).sum() / tree.cover[0])


def load_trees(spark: SparkSession, model_path: str) -> list[pd.DataFrame]:
    """Node tables of a saved Spark tree ensemble (one pandas frame per tree; model-sized)."""
    d = spark.read.parquet(f"{model_path.rstrip('/')}/data")
    flat = d.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
                    F.col("nodeData.rawCount").alias("rawCount"),
                    F.col("nodeData.leftChild").alias("leftChild"), F.col("nodeData.rightChild").alias("rightChild"),
                    F.col("nodeData.split.featureIndex").alias("featureIndex"),
                    F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
    pdf = flat.toPandas()
    return [g.drop(columns="treeID") for _, g in pdf.sort_values("treeID").groupby("treeID", sort=True)]


def attribution_frame(df: DataFrame, features_col: str, trees: list[pd.DataFrame], weights: list[float],
                      names: list[str], margin_scale: float = 2.0) -> DataFrame:
    """Per-row SHAP values (log-odds scale) of the named design columns, plus base and margin.

    ``margin_scale`` is 2 for Spark boosted trees (probability = 1/(1+exp(-2F))).
    """
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((trees, list(weights)))
    idx = list(range(len(names)))
    schema = ", ".join([f"`phi_{n}` double" for n in names] + ["base double", "margin double"])
    x = df.select(vector_to_array(F.col(features_col)).alias("x"))

    def fn(batches):
        tr, ws = bc.value
        built = [_Tree(t) for t in tr]
        base = sum(margin_scale * w * expected_value(t) for t, w in zip(built, ws))
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf["x"].to_numpy())
            phi = np.zeros((X.shape[0], X.shape[1]))
            margin = np.zeros(X.shape[0])
            for t, w in zip(built, ws):
                tree_shap(t, X, phi, margin_scale * w)
                node = np.zeros(X.shape[0], dtype=np.int64)
                for _ in range(64):
                    inner = t.left[node] >= 0
                    if not inner.any():
                        break
                    go = X[np.arange(len(node)), np.maximum(t.feat[node], 0)] <= t.thr[node]
                    node = np.where(inner, np.where(go, t.left[node], t.right[node]), node)
                margin += margin_scale * w * t.value[node]
            out = {f"phi_{n}": phi[:, i] for n, i in zip(names, idx)}
            out["base"] = np.full(X.shape[0], base)
            out["margin"] = margin
            yield pd.DataFrame(out)

    return x.mapInPandas(fn, schema)


def summarize(phi: DataFrame, names: list[str]) -> DataFrame:
    """Mean |SHAP| and direction of the mean per feature, ascending by magnitude."""
    wide = phi.agg(*[F.avg(F.abs(F.col(f"phi_{n}"))).alias(f"a_{n}") for n in names],
                   *[F.avg(F.col(f"phi_{n}")).alias(f"m_{n}") for n in names])
    stack = ", ".join(f"'{n}', `a_{n}`, `m_{n}`" for n in names)
    long = wide.selectExpr(f"stack({len(names)}, {stack}) AS (Feature, Mean_SHAP, mean_signed)")
    return (long.select("Feature", F.round("Mean_SHAP", 4).alias("Mean_SHAP"),
                        F.when(F.col("mean_signed") > 0, F.lit("positive")).otherwise(F.lit("negative"))
                         .alias("Mean_SHAP_dir"))
                .orderBy("Mean_SHAP", "Feature"))


CORE = config.ATTRIBUTION_FEATURES

# the batch function and its helpers travel to the executors by value, so the
# package does not have to be installed there
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: rely on the package being importable
    pass
